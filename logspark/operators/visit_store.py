"""Visits kept up to date batch by batch, without the history of their events.

Visits (see ``sessions.visits``) are stored by the day they begin on and a hash bucket of their
visitor. A batch of events, however late, is cut into visits of its own; only stored partitions that
hold a visit within the gap of one of these are read, combined with them and rewritten.

``index`` holds one row per partition: where its newest files are and how far its visits reach, so a
visit that began days before a late event is found without looking at the days in between. A
partition has three places it is written to in turn, an index three as well, and a mark names the
newest complete index. So a batch never touches files that the index before it, or the one before that,
points to; a batch that failed anywhere is simply applied again; and nothing older stays.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logspark.operators import sessions
from logspark.operators.sessions import GAP_SECONDS, SLOT, VISITOR
from logspark.plans.skew import salted_join

BUCKETS = 64
PLACES = 3
PARTITION = ["part_day", "part_bucket"]
INDEX_DDL = "part_day date, part_bucket int, place int, n long, reach_s long"


def day_of(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def cut(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """The visits of these events alone."""
    return sessions.visits(sessions.numbered(sessions.slots(events, gap_seconds), gap_seconds)).drop("g")


def placed(visits: DataFrame, buckets: int) -> DataFrame:
    """Visits with the partition they belong to."""
    bucket = F.pmod(F.xxhash64(*VISITOR), F.lit(buckets)).cast("int")
    return visits.withColumns({"part_day": day_of(F.col("first_s")), "part_bucket": bucket})


# -- index -------------------------------------------------------------------


def newest(spark: SparkSession, root: str, below: int = 1 << 62) -> int | None:
    """The newest complete version under ``below``."""
    try:
        marks = spark.read.schema("version long").parquet(f"{root}/marks")
        return marks.filter(F.col("version") < below).agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_index(spark: SparkSession, root: str, below: int = 1 << 62) -> DataFrame:
    version = newest(spark, root, below)
    if version is None:
        return spark.createDataFrame([], INDEX_DDL)
    return spark.read.schema(INDEX_DDL).parquet(f"{root}/index/ring={version % PLACES}")


def read_parts(spark: SparkSession, root: str, parts: list) -> DataFrame | None:
    """Visits of the partitions named by rows of the index, and of no others."""
    paths = [f"{root}/visits/place={p['place']}/part_day={p['part_day']}/part_bucket={p['part_bucket']}" for p in parts if p["n"]]
    return spark.read.option("basePath", f"{root}/visits").parquet(*paths) if paths else None


def touched(index: DataFrame, fresh: DataFrame, gap_seconds: int) -> DataFrame:
    """Index rows of the partitions that hold, or will hold, a visit within the gap of a fresh one."""
    reach = fresh.groupBy(
        F.col("part_bucket").alias("_bucket"),
        day_of(F.col("first_s") - gap_seconds).alias("_from"), day_of(F.col("last_s") + gap_seconds).alias("_to"),
    ).agg(F.min(F.col("first_s") - gap_seconds).alias("_first_s"))
    near = (
        (F.col("part_bucket") == F.col("_bucket")) & (F.col("part_day") <= F.col("_to"))
        & ((F.col("part_day") >= F.col("_from")) | (F.col("reach_s") >= F.col("_first_s")))
    )
    return index.join(reach, near, "left_semi")


# -- a batch -----------------------------------------------------------------


def apply_batch(
    events: DataFrame, root: str, version: int, gap_seconds: int = GAP_SECONDS, buckets: int = BUCKETS
) -> tuple[DataFrame, list]:
    """Brings the store from the newest version below ``version`` to ``version``.

    Returns the visits that hold an event of the batch, as they are now, and the index rows read.
    Applying a batch again gives the same store.
    """
    spark, ring = events.sparkSession, version % PLACES
    fresh = _kept(placed(cut(events, gap_seconds), buckets), f"{root}/fresh/ring={ring}")
    index = read_index(spark, root, version)
    parts = touched(index, fresh, gap_seconds).collect()  # a row per partition, not per visit
    old = read_parts(spark, root, parts)
    rows = fresh.withColumn("_changed", F.lit(True))
    rows = rows if old is None else rows.unionByName(old.drop("place").withColumn("_changed", F.lit(False)))
    # A visit has changed when one of the batch's visits lies inside it.
    merged = sessions.combine_visits(rows, gap_seconds, F.max("_changed").alias("_changed"))
    merged = _kept(placed(merged.drop("g"), buckets), f"{root}/merged/ring={ring}")

    was = spark.createDataFrame([(p["part_day"], p["part_bucket"], p["place"]) for p in parts], "part_day date, part_bucket int, was int")
    sizes = merged.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("n"), F.max("last_s").alias("reach_s"))
    now = sizes.join(was, PARTITION, "full").select(
        *PARTITION, F.coalesce(F.pmod(F.col("was") + 1, F.lit(PLACES)), F.lit(0)).cast("int").alias("place"),
        F.coalesce("n", F.lit(0)).alias("n"), "reach_s",
    )
    (
        merged.drop("_changed").join(now.select(*PARTITION, "place"), PARTITION)
        .repartition(*PARTITION)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("place", *PARTITION).parquet(f"{root}/visits")
    )
    rest = index.join(was, PARTITION, "left_anti")
    rest.select(*now.columns).unionByName(now).write.mode("overwrite").parquet(f"{root}/index/ring={ring}")
    mark = spark.range(1).select(F.lit(version).cast("long").alias("version"))
    mark.write.mode("overwrite").parquet(f"{root}/marks/ring={ring}")
    return merged.filter("_changed").drop("_changed"), parts


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- reading -----------------------------------------------------------------


def read_visits(spark: SparkSession, root: str, below: int = 1 << 62, first_day=None, last_day=None) -> DataFrame | None:
    """All visits, or those that may cover a day from ``first_day`` to ``last_day``."""
    index = read_index(spark, root, below).filter("n > 0")
    if last_day is not None:
        index = index.filter(F.col("part_day") <= F.lit(last_day))
    if first_day is not None:
        index = index.filter(day_of(F.col("reach_s")) >= F.lit(first_day))
    return read_parts(spark, root, index.collect())


def read_sessions(spark: SparkSession, root: str, below: int = 1 << 62) -> DataFrame | None:
    """Session rows of a version of the store; None before the first event."""
    visits = read_visits(spark, root, below)
    return None if visits is None else sessions.session_rows(visits)


def stamp_from_visits(events: DataFrame, visits: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Events with the ``session_id`` of the visit they belong to, as ``stamp_sessions`` gives it.

    A slot is a second longer than the gap, so a visit has an event in every slot it covers, and all
    events of a visitor in one slot belong to one visit: the join is by equality.
    """
    slots = F.sequence(F.floor(F.col("first_s") / (gap_seconds + 1)), F.floor(F.col("last_s") / (gap_seconds + 1)))
    number = F.when(F.col("start_ts").isNull(), F.lit(sessions.NO_SESSION).cast("long")).otherwise(
        sessions.session_key(F.col("site_id"), F.col("visitor_id"), F.col("start_ts"))
    )
    lookup = visits.select(*VISITOR, F.explode(slots).alias("slot"), number.alias("session_id"))
    keyed = events.drop("session_id").withColumn(
        "slot", F.when(~F.coalesce("is_bot", F.lit(False)) & (F.col("visitor_id") != 0), sessions.slot(gap_seconds))
    )
    return salted_join(keyed, lookup, SLOT, F.col("event_key"), "left").drop("slot")
