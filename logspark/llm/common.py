"""Helpers shared by the operators: scratch storage, word hashes, components, distributed ranks."""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows per Arrow batch: texts may be long, so batches stay far below the default of 10,000 rows.
BATCH_ROWS = 1_000
#: Words remembered per Python worker; the table is emptied when full.
WORD_CACHE = 1 << 20

_U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and a checkpoint folder where the session has none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else a folder of the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared storage."""
    return f"{shared_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to shared storage and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: its cleaner waits for the driver's garbage collection.

    Listeners hold the plan of a step that has just ended for a moment, hence the second round.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(2)
        spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection), element by element."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class WordHasher:
    """64-bit hashes of the ASCII-white-space separated words of UTF-8 text, with a bounded cache."""

    def __init__(self, lower: bool = False):
        self.lower = lower
        self.seen: dict[bytes, int] = {}

    def words(self, text: str | None) -> list[bytes]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return (raw.lower() if self.lower else raw).split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(seen) > WORD_CACHE:
                seen.clear()
            for w in set(words).difference(seen):
                seen[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


# -- connected components -------------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is its smallest node.

    Every round each node moves to the neighbour of least random priority (or stays), one
    pointer jump follows, and the edges are rewritten to the moved nodes; loops and repeats
    vanish, so the graph shrinks by a constant factor whatever its shape and a hub disappears in
    the first rounds. Each round ends in shared storage. Nothing is collected.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves: list[DataFrame] = []
    current, turn = edges, 0
    while not current.isEmpty():
        ends = current.union(current.select("b", "a"))
        best = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("p"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("p"), F.col("a").alias("n"))
        step = stored(best.select(F.col("a").alias("node"), F.least("m", own)["n"].alias("to")), "parents")
        after = step.select(F.col("node").alias("to"), F.col("to").alias("end"))
        moved = stored(step.join(after, "to").select("node", F.col("end").alias("to")), "moves")
        moves.append(moved)
        for end in ("a", "b"):
            current = current.join(moved.select(F.col("node").alias(end), F.col("to").alias("_to")), end).drop(end).withColumnRenamed("_to", end)
        current = current.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        current = stored(current, "edges")
        turn += 1
    if not moves:
        return spark.createDataFrame([], "node long, component long")
    labels = moves[0].select("node", F.col("to").alias("root"))
    for moved in moves[1:]:
        nxt = moved.select(F.col("node").alias("root"), F.col("to").alias("_next"))
        labels = labels.join(nxt, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    labels = stored(labels, "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")


# -- ranks without one task per group ---------------------------------------------------------------


def rank_bucket(order: list[str], total: Column, rows: int) -> Column:
    """The hash bucket in which ``ranked`` puts a row of a group of ``total`` rows (or sizes)."""
    return F.pmod(F.xxhash64(*order, F.lit(7)), F.greatest(F.ceil(total / rows), F.lit(1)).cast("long"))


def ranked(df: DataFrame, keys: list[str], order: list[str], size: Column | None = None, rows: int = 50_000) -> DataFrame:
    """Adds ``_rank``: the running number of a row among those of its keys, from 0.

    ``df`` is evaluated three times: pass a table that is cheap to read.

    With ``size`` it adds the sum of the sizes before the row instead. Rows of a group are
    spread over hash buckets of about ``rows`` rows (with ``size``: of about that size), each bucket is ordered in a task of its own,
    and the buckets' totals (one small row each) give the offsets. The order is by bucket, then
    ``order``; the caller makes ``order`` total where it must be stable.
    """
    size = F.lit(1).cast("long") if size is None else size.cast("long")
    counts = df.groupBy(*keys).agg(F.sum(size).alias("_n"))
    marked = _null_safe_join(df.withColumn("_size", size), counts, keys)
    marked = marked.withColumn("_bucket", rank_bucket(order, F.col("_n"), rows)).drop("_n")
    totals = marked.groupBy(*keys, "_bucket").agg(F.sum("_size").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    out = _null_safe_join(local, offsets, [*keys, "_bucket"])
    return out.withColumn("_rank", F.col("_offset") + F.col("_before")).drop("_bucket", "_size", "_before", "_offset")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        here = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = here if on is None else on & here
    return left.join(right, on).drop(*[f"_r_{k}" for k in keys])


def frequency_ranks(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """``df`` with the place of each row in the order given, from 0, without one task for all rows.

    Rows are dealt by ranges of the order and stored with their range; sizes of ranges (one small
    row each) give the offsets.
    """
    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranks")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_part").alias("_range"), F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    out = parts.withColumn("_inside", inside).join(offsets, F.col("_part") == F.col("_range"))
    return out.withColumn(name, (F.col("_inside") + F.col("_offset")).cast("int")).drop("_part", "_range", "_inside", "_offset")


def file_order(df: DataFrame) -> Column:
    """The place of a row in Parquet files as Spark numbers them, 0 for a table that isn't read from files."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return F.lit(0).cast("long")
    part = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).try_cast("long")
    return F.coalesce(part, F.lit(0)) * (1 << 36) + F.col("_metadata.row_index")
