"""Streaming forms of the batch jobs.

Stateless work runs per micro-batch with the batch code. Windowed counts use watermarks.
Results that must be exact under late data (sessions, uniques, error groups, alert state) are
versioned snapshots: a batch reads the newest version below its id and writes its own, so a
retried batch gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from logspark.normalise.common import Promoted
from logspark.normalise.logs import normalise
from logspark.normalise.shippers import MAX_CHUNKED_BYTES, MAX_CHUNKS
from logspark.operators import alerts, errors, realtime, sessions, visit_store
from logspark.operators.rollups import duration_ms, percentiles
from logspark.operators.web_reports import human
from logspark.operators.web_rollups import daily_values_of_visits, fold_tail, web_rollup_daily, web_rollup_minute
from logspark.sources.tiers import append_once, commit_batch

WIDTHS = {"1m": "1 minute", "1h": "1 hour"}
LOG_LATENESS = "10 minutes"
WEB_LATENESS = "10 minutes"


# -- snapshots ---------------------------------------------------------------


def newest_version(spark: SparkSession, path: str, below: int) -> int | None:
    """The highest committed version under ``below``."""
    try:
        marks = spark.read.parquet(f"{path}/marks")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return marks.filter(F.col("version") < below).agg(F.max("version")).first()[0]


def read_snapshot(spark: SparkSession, path: str, below: int = 1 << 62) -> DataFrame | None:
    version = newest_version(spark, path, below)
    return None if version is None else spark.read.parquet(f"{path}/data/version={version}")


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """The data first, then the mark that makes it visible."""
    df.write.mode("overwrite").parquet(f"{path}/data/version={version}")
    mark = df.sparkSession.range(1).select(F.lit(version).cast("long").alias("version"))
    mark.write.mode("overwrite").parquet(f"{path}/marks/mark={version}")


def _per_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)


# -- R1: records -------------------------------------------------------------


def normalise_stream(
    raw: DataFrame, root: str, checkpoint: str, promoted: tuple[Promoted, ...] = (), drop_keys=(),
    web: Callable[[DataFrame], DataFrame] | None = None,
) -> DataStreamWriter:
    """Raw records to log rows (and with ``web`` beacon envelopes to web rows), one commit per batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        is_web = F.col("protocol") == "web_event"
        rows = normalise(batch.filter(~is_web), promoted, drop_keys)
        commit_batch(rows, web(batch.filter(is_web)) if web else None, root, batch_id)

    return _per_batch(raw, step, checkpoint)


# -- R2, R3, R4: windows -----------------------------------------------------


def rollup_stream(logs: DataFrame, width: str = "1m", lateness: str = LOG_LATENESS) -> DataFrame:
    """Tumbling rollup per (bucket, service, level); rows later than the watermark are dropped."""
    return (
        logs.withWatermark("ts", lateness)
        .withColumn("duration_ms", duration_ms())
        .groupBy(
            F.window("ts", WIDTHS[width]).alias("w"),
            F.coalesce("service", F.lit("")).alias("service"),
            F.coalesce("level", F.lit("")).alias("level"),
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            *percentiles(F.col("duration_ms")),
            F.coalesce(F.sum(F.col("raw_len").cast("long")), F.lit(0)).alias("bytes"),
        )
        .select(
            F.col("w.start").alias("bucket"), "service", "level", "n",
            *[F.coalesce(p, F.lit(0.0)).alias(p) for p in ("p50", "p95", "p99")], "bytes",
        )
    )


def realtime_stream(web: DataFrame, lateness: str = WEB_LATENESS) -> DataFrame:
    """Approximate visitors of the last five minutes, every minute and site."""
    return (
        web.filter(human())
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), "site_id")
        .agg(F.approx_count_distinct("visitor_id").alias("visitors"), F.count(F.lit(1)).alias("events"))
        .select(F.col("w.end").alias("as_of"), "site_id", "visitors", "events")
    )


def realtime_exact_stream(web: DataFrame, root: str, checkpoint: str, width: int = realtime.WIDTH) -> DataStreamWriter:
    """Exact visitors of the last ``width`` minutes by minute, corrected by late events.

    Under ``root``: ``minutes`` (visitor minutes by day and batch) and ``live`` (rows by day of
    ``as_of``). A batch adds its visitor minutes and rebuilds the days these reach, from the
    minutes of those days and the days before them; run again, it writes the same files.
    """

    def keep(rows: DataFrame, path: str, *keys: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = realtime.visitor_minutes(batch).withColumns({"part_day": F.to_date("minute"), "batch_id": F.lit(batch_id)})
        keep(fresh, f"{root}/minutes", "part_day", "batch_id")
        minutes = batch.sparkSession.read.schema(fresh.schema).parquet(f"{root}/minutes").filter(F.col("batch_id") <= batch_id)
        ends = F.array(*[F.to_date(F.col("minute") + F.make_interval(mins=F.lit(m))) for m in (1, width)])
        reached = minutes.filter(F.col("batch_id") == batch_id).select(F.explode(ends).alias("day")).distinct()
        days = [r["day"] for r in reached.collect()]  # a row per day
        if not days:
            return
        near = minutes.filter(F.col("part_day").isin([*days, *[d - timedelta(days=1) for d in days]]))
        live = realtime.sliding_visitors(near, width).withColumn("part_day", F.to_date("as_of"))
        keep(live.filter(F.col("part_day").isin(days)), f"{root}/live", "part_day")

    return _per_batch(web, step, checkpoint)


def session_count_stream(web: DataFrame, gap: str = "30 minutes", lateness: str = WEB_LATENESS) -> DataFrame:
    """Event counts per visit window; full session rows come from ``session_stream``."""
    return (
        sessions.eligible(web)
        .withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("w"), "site_id", "visitor_id")
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event") == "pageview").alias("pageviews"))
        .select("site_id", "visitor_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "events", "pageviews")
    )


# -- R4, R5: exact web tables under late data ----------------------------------


def session_stream(
    web: DataFrame, events_path: str, sessions_path: str, checkpoint: str,
    gap_seconds: int = sessions.GAP_SECONDS, buckets: int = visit_store.BUCKETS,
) -> DataStreamWriter:
    """Appends each batch's events and brings the visits they touch up to date.

    ``visit_store.read_sessions(spark, sessions_path)`` gives the session rows.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        append_once(batch, events_path, batch_id)
        rows = batch.sparkSession.read.parquet(f"{events_path}/batch_id={batch_id}")
        visit_store.apply_batch(rows, sessions_path, batch_id, gap_seconds, buckets)

    return _per_batch(web, step, checkpoint)


def web_rollup_stream(
    web: DataFrame, root: str, checkpoint: str, gap_seconds: int = sessions.GAP_SECONDS,
    buckets: int = visit_store.BUCKETS, top: int = 100,
) -> DataStreamWriter:
    """Web rollups that late events correct: a batch rebuilds the days it makes dirty, and no others.

    Under ``root``: ``events`` by day and batch, ``visits`` (a visit store), ``minute`` and ``daily`` by
    ``part_day``, and ``dirty``, the days each batch rebuilt. A batch's dirty days are those of its events
    and those of every visit that its events lengthen or join. A batch that is run again writes the same files.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        days = batch.withColumns({"part_day": F.to_date("ts"), "batch_id": F.lit(batch_id)})
        (  # files by day: their number grows with the rows, not with tasks times days
            days.hint("rebalance", "part_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("part_day", "batch_id").parquet(f"{root}/events")
        )
        events = spark.read.schema(days.schema).parquet(f"{root}/events").filter(F.col("batch_id") <= batch_id)
        fresh = events.filter(F.col("batch_id") == batch_id)
        changed, _ = visit_store.apply_batch(fresh, f"{root}/visits", batch_id, gap_seconds, buckets)
        first, last = (visit_store.day_of(F.col(c)) for c in ("first_s", "last_s"))
        dirty = changed.select(F.explode(F.sequence(first, last)).alias("day")).union(fresh.select("part_day")).distinct()
        dirty.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/dirty/batch={batch_id}")
        rebuild_days(spark, root, [r["day"] for r in dirty.collect()], batch_id, gap_seconds, top)

    return _per_batch(web, step, checkpoint)


def rebuild_days(spark: SparkSession, root: str, days: list, batch_id: int, gap_seconds: int = sessions.GAP_SECONDS, top: int = 100) -> None:
    """Replaces the rollups of these days (dates) by those of the events and visits up to a batch."""
    if not days:
        return
    events = spark.read.parquet(f"{root}/events").filter(F.col("part_day").isin(days) & (F.col("batch_id") <= batch_id))
    visits = visit_store.read_visits(spark, f"{root}/visits", batch_id + 1, min(days), max(days))
    if visits is None:
        visits = visit_store.cut(events.limit(0), gap_seconds)
    events = events.drop("part_day", "batch_id")
    replace_days(web_rollup_minute(events), f"{root}/minute", "bucket")
    replace_days(fold_tail(daily_values_of_visits(events, visits, gap_seconds), top), f"{root}/daily", "day")


def recompute_days(
    stamped: DataFrame, session_rows: DataFrame, minute_path: str, daily_path: str, first_day, last_day,
    top: int = 100,
) -> None:
    """Rebuilds the web rollups of whole days, so late events are counted exactly once."""
    day = F.to_date("ts")
    rows = stamped.filter(day.between(F.lit(first_day), F.lit(last_day)))
    write_days(rows, session_rows, minute_path, daily_path, top)


def write_days(stamped: DataFrame, session_rows: DataFrame, minute_path: str, daily_path: str, top: int = 100) -> None:
    """The rollups of all days of ``stamped`` in place of those days' old ones."""
    replace_days(web_rollup_minute(stamped), minute_path, "bucket")
    replace_days(web_rollup_daily(stamped, session_rows, top), daily_path, "day")


def replace_days(fresh: DataFrame, path: str, column: str) -> None:
    (
        fresh.withColumn("part_day", F.to_date(column))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part_day")
        .parquet(path)
    )


# -- R6, R7: state -----------------------------------------------------------


def error_group_stream(logs: DataFrame, groups_path: str, checkpoint: str, samples: int = errors.SAMPLES) -> DataStreamWriter:
    """Folds each batch into the error-group snapshot."""

    def step(batch: DataFrame, batch_id: int) -> None:
        old = read_snapshot(batch.sparkSession, groups_path, batch_id)
        fold = errors.fold_error_groups(batch, samples)
        merged = errors.new_groups(fold) if old is None else errors.merge_error_groups(old, fold, samples)
        write_snapshot(merged, groups_path, batch_id)

    return _per_batch(logs, step, checkpoint)


def alert_stream(
    ticks: DataFrame, rules: list[dict], tables: Callable[[SparkSession], dict], state_path: str,
    events_path: str, checkpoint: str,
) -> DataStreamWriter:
    """Evaluates all rules at the newest tick (``now``) of a batch and keeps their severities."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now: datetime | None = batch.agg(F.max("now")).first()[0]
        if now is None:
            return
        state = read_snapshot(spark, state_path, batch_id)
        if state is None:
            state = spark.createDataFrame([], alerts.STATE_SCHEMA)
        out = alerts.evaluate(spark, rules, now, state=state, **tables(spark))
        alerts.firing_rows(out).write.mode("overwrite").parquet(f"{events_path}/batch_id={batch_id}")
        write_snapshot(alerts.next_state(state, out), state_path, batch_id)

    return _per_batch(ticks, step, checkpoint)


# -- R8: chunks --------------------------------------------------------------


def chunk_stream(
    chunks: DataFrame, timeout: str = "5 seconds", lateness: str = "5 seconds",
    max_total: int = MAX_CHUNKS, max_bytes: int = MAX_CHUNKED_BYTES,
) -> DataFrame:
    """(receive_ts, msg_id, seq, total, payload) to whole messages in append mode.

    A message whose parts do not all arrive within ``timeout`` of each other is dropped.
    Repeated parts are removed first, so a message never holds more than ``max_total``.
    """
    good = chunks.filter(
        F.col("total").between(1, max_total) & (F.col("seq") >= 0) & (F.col("seq") < F.col("total"))
    )
    once = good.withWatermark("receive_ts", lateness).dropDuplicatesWithinWatermark(["msg_id", "seq"])
    parts = once.groupBy(F.session_window("receive_ts", timeout).alias("w"), "msg_id").agg(
        F.min("total").alias("t0"), F.max("total").alias("t1"), F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("payload")).alias("bytes"),
        F.collect_list(F.struct("seq", "payload")).alias("p"),
    )
    whole = (F.col("t0") == F.col("t1")) & (F.col("n") == F.col("t0")) & (F.col("bytes") <= max_bytes)
    return parts.filter(whole).select(
        "msg_id",
        F.array_join(F.transform(F.array_sort("p"), lambda x: x["payload"]), "").alias("payload"),
    )
