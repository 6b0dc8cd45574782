"""Reading and writing the recent (hot) and archived (cold) tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logspark import schemas
from logspark.functions import json as J
from logspark.functions.text import blank_to_null, strip_space
from logspark.operators.retention import safe_partition_name, safe_site_name
from logspark.plans.ranges import first_rows

ARCHIVE_PARTITIONS = ["date", "hour", "service_part"]
WEB_ARCHIVE_PARTITIONS = ["date", "site"]
MAX_RECORDS_PER_FILE = 20_000_000
ROW_GROUP_ROWS = 100_000


def union_tiers(
    hot: DataFrame, cold: DataFrame | None, promoted: dict[str, T.DataType] | None = None
) -> DataFrame:
    """Recent and archived log rows as one table, matched by name, absent columns NULL."""
    return _union(hot, cold, schemas.LOGS, promoted or {})


def union_web_tiers(hot: DataFrame, cold: DataFrame | None) -> DataFrame:
    """As ``union_tiers`` for web events, which live under their own root."""
    return _union(hot, cold, schemas.WEB_EVENTS, {})


def _union(hot, cold, schema, promoted):
    full = T.StructType(
        schema.fields + [T.StructField(n, t, True) for n, t in promoted.items()]
    )
    rows = schemas.conform(hot, full)
    if cold is None:
        return rows
    return rows.unionByName(schemas.conform(cold, full), allowMissingColumns=True)


def read_archive(spark: SparkSession, path: str) -> DataFrame | None:
    """Archived rows, or None when nothing has been archived yet.

    The partition columns stay in the table, so filters on ``date`` prune directories.
    """
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def archive_rows(logs: DataFrame, cutoff: datetime | Column) -> DataFrame:
    """Rows older than ``cutoff`` with their archive partition columns."""
    before = F.lit(cutoff) if isinstance(cutoff, datetime) else cutoff
    return logs.filter(F.col("ts") < before).withColumns(
        {
            "date": F.to_date("ts"),
            "hour": F.hour("ts"),
            "service_part": safe_partition_name(F.coalesce(F.col("service"), F.lit(""))),
        }
    )


def archive_logs(
    logs: DataFrame,
    path: str,
    cutoff: datetime,
    promoted_text: tuple[str, ...] = (),
    compression: str = "zstd",
) -> None:
    """Append rows older than ``cutoff`` to ``date=/hour=/service_part=`` Parquet.

    Tasks hold ranges of (partition, time), so one service holding most rows is written by
    many tasks, each sorted by time and service.
    """
    rows = archive_rows(logs, cutoff)
    writer = (
        _sliced(rows, ARCHIVE_PARTITIONS, ["ts", "service"])
        .write.mode("append")
        .option("compression", compression)
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
    )
    for name in promoted_text:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.partitionBy(*ARCHIVE_PARTITIONS).parquet(path)


def archive_web(
    events: DataFrame,
    path: str,
    cutoff: datetime,
    compression: str = "zstd",
) -> None:
    """Append web events older than ``cutoff`` to ``date=/site=`` Parquet."""
    rows = events.filter(F.col("ts") < F.lit(cutoff)).withColumns(
        {"date": F.to_date("ts"), "site": safe_site_name(F.col("site_id"))}
    )
    (
        _sliced(rows, WEB_ARCHIVE_PARTITIONS, ["ts", "site_id"])
        .write.mode("append")
        .option("compression", compression)
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
        .partitionBy(*WEB_ARCHIVE_PARTITIONS)
        .parquet(path)
    )


def _sliced(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range-partition on the partition keys and time, then sort inside each task.

    Range partitioning samples the data, so a heavy partition directory spreads over as many
    tasks as its share of the rows.
    """
    return rows.repartitionByRange(*keys, "ts").sortWithinPartitions(*keys, *order)


def cold_footprint(
    archive: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None
) -> DataFrame:
    """Files, rows and bytes per archive date, newest dates first.

    Only the file metadata column and the partition column are read.
    """
    per_file = (
        archive.select(
            F.col("date").cast("string").alias("date"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
        )
        .groupBy("date", "path")
        .agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    )
    if start is not None:
        per_file = per_file.filter(F.col("date") >= start)
    if end is not None:
        per_file = per_file.filter(F.col("date") <= end)
    per_date = (
        per_file.groupBy("date")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("n").alias("rows"),
            F.sum("size").alias("bytes"),
        )
        .orderBy(F.col("date").desc())
    )
    return first_rows(per_date, limit)


def store_state(
    logs: DataFrame, error_groups: DataFrame | None = None, rules: DataFrame | None = None
) -> DataFrame:
    """One row: log count, oldest, newest and last inserted time, group and rule counts."""
    state = logs.agg(
        F.count(F.lit(1)).alias("hot_rows"),
        F.min("ts").alias("oldest_hot_ts"),
        F.max("ts").alias("newest_hot_ts"),
        F.max("insert_ts").alias("last_insert_ts"),
    )
    if error_groups is not None:
        state = state.withColumn(
            "error_groups", error_groups.agg(F.count(F.lit(1))).scalar()
        )
    if rules is not None:
        active = rules.filter(F.col("status") == "active")
        state = state.withColumn("alerts_active", active.agg(F.count(F.lit(1))).scalar())
    return state


EXPORT_EVENTS = [
    "ts", "event", "name", "path", "source", "medium", "country", "region", "city",
    "device", "browser", "os", "visitor_id", "session_id", "trace_id",
]
EXPORT_SESSIONS = [
    "session_id", "start_ts", "end_ts", "entry_path", "exit_path", "pageviews", "events",
    "engaged_ms", "is_bounce", "source", "medium", "country", "region", "city", "device",
]


def export_rows(rows: DataFrame, view: str, limit: int | None = None) -> DataFrame:
    """Events or sessions, oldest first, with the export's columns; the oldest ``limit`` if it is given."""
    if view == "events":
        columns, order = EXPORT_EVENTS, ["ts"]
        keys = [c for c in ("event_key",) if c in rows.columns]
    elif view == "sessions":
        rows = rows.filter(F.col("pageviews") >= 1)
        columns, order, keys = EXPORT_SESSIONS, ["start_ts", "session_id"], []
    else:
        raise ValueError("view must be events or sessions")
    return first_rows(rows.orderBy(*order, *keys), limit).select(*columns)


def export_csv(rows: DataFrame, view: str, path: str, limit: int | None = None) -> None:
    """Write ``export_rows`` as CSV files with headers, in order of their names; NULL is an empty cell."""
    times = ["ts"] if view == "events" else ["start_ts", "end_ts"]
    out = export_rows(rows, view, limit)
    stamped = out.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for c in times}
    )
    (
        stamped.write.mode("overwrite")
        .option("header", True)
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("escape", '"')
        .csv(path)
    )


def append_once(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch under its own ``batch_id=`` directory, replacing a failed try."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def commit_batch(logs: DataFrame | None, web: DataFrame | None, root: str, batch_id: int) -> None:
    """Log and web rows of one batch, followed by a marker that makes both visible.

    Readers use ``read_committed``; a batch that died between the two writes is rewritten on
    retry and is never half visible.
    """
    spark = (logs if logs is not None else web).sparkSession
    if logs is not None:
        append_once(logs, f"{root}/logs", batch_id)
    if web is not None:
        append_once(web, f"{root}/web_events", batch_id)
    spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).write.mode(
        "overwrite"
    ).parquet(f"{root}/commits/batch={batch_id}")


def read_committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of committed batches only."""
    commits = spark.read.parquet(f"{root}/commits").select(F.col("batch_id").cast("long"))
    rows = spark.read.option("mergeSchema", True).parquet(f"{root}/{table}")
    return rows.withColumn("batch_id", F.col("batch_id").cast("long")).join(
        commits.distinct(), "batch_id", "left_semi"
    )


def read_landed_bodies(spark: SparkSession, path: str, receive_ts: datetime | None = None,
                       source_addr: str = "", protocol: str = "http_json") -> DataFrame:
    """Landed request bodies, one file per body, as raw records.

    A body is bounded by the size of one request; the split into records is distributed by file.
    """
    bodies = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("body"),
        (F.lit(receive_ts) if receive_ts else F.col("_metadata.file_modification_time"))
        .cast("timestamp")
        .alias("receive_ts"),
    )
    return split_bodies(bodies, source_addr, protocol)


def split_bodies(bodies: DataFrame, source_addr: str = "", protocol: str = "http_json") -> DataFrame:
    """Columns ``body``, ``receive_ts`` to one raw record per array element, object or line."""
    body = F.regexp_replace(F.col("body"), r"(?U)^\s+", "")
    whole = J.parse(F.when(body.rlike(r"^[\[{]"), body))
    is_array = F.schema_of_variant(whole).startswith("ARRAY")
    items = F.transform(
        F.try_variant_get(whole, "$", "array<variant>"),
        lambda v: F.when(F.schema_of_variant(v) != "VOID", F.to_json(v)),
    )
    lines = F.filter(
        F.transform(F.split(F.col("body"), r"\r?\n"), strip_space),
        lambda line: (line != "") & (line != "null"),
    )
    records = (
        F.when(is_array, items).when(whole.isNotNull(), F.array(F.to_json(whole))).otherwise(lines)
    )
    return (
        bodies.select("receive_ts", F.explode(records).alias("raw"))
        .filter(blank_to_null(F.col("raw")).isNotNull())
        .select(
            "receive_ts",
            F.lit(source_addr).alias("source_addr"),
            F.lit(protocol).alias("protocol"),
            "raw",
        )
    )
