"""Streaming jobs drained over the driver tables; their results must equal the batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from logspark.operators.errors import GROUP_COLUMNS
from logspark.operators.realtime import sliding_visitors, visitor_minutes
from logspark.operators.visit_store import read_sessions
from logspark.sources import adapters as A, tiers
from logspark.streaming import jobs as S
from logspark.streaming.stateful import chunk_messages, severity_stream
from registry import records as R
from registry.core import EV, GAP, LOGS, R1H, WEB, check, sql_sessions
from registry.logs import sql_fold
from registry.series import _scratch
from registry.web import _ALL, sql_daily


class _Streamed:
    """A session whose reads are streams, so that the adapters build streaming frames."""

    def __init__(self, spark):
        self._spark = spark

    @property
    def read(self):
        spark = self._spark

        class Reader:
            @staticmethod
            def parquet(path):
                folder, _, name = path.rpartition("/")
                schema = spark.read.parquet(path).schema
                return spark.readStream.schema(schema).parquet(f"{folder}/{name.replace('.parquet', '*.parquet')}")

        return Reader()


def drain(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def settle(spark, stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregation to the end in complete mode and reads the last result."""
    root = _scratch(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        S.write_snapshot(batch, f"{root}/out", batch_id)

    drain(stream.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/cp").foreachBatch(keep))
    return S.read_snapshot(spark, f"{root}/out")


@check("R1_normalise_stream", f"""WITH {EV} SELECT 'svc-' || (user_id % 8) AS service, CASE k % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'debug' END AS level, count(*) AS n FROM ev GROUP BY 1, 2""")
def r1(spark, d):
    k = F.col("k") % 3
    level = F.when(k == 0, "ERR").when(k == 1, "Warning").otherwise("trace")
    body = R.text('{"service":"svc-', F.col("user_id") % 8, '","level":"', level, '","msg":"m"}')
    root = _scratch(spark, "normalise")
    raw = R.raw(A._events(_Streamed(spark), d), body).drop("event_key")
    drain(S.normalise_stream(raw, f"{root}/store", f"{root}/cp"))
    return tiers.read_committed(spark, f"{root}/store", "logs").groupBy("service", "level").agg(F.count("*").alias("n"))


@check("R2_rollup_stream", f"WITH {LOGS}, {R1H} SELECT bucket, service, level, n, p50, p95, p99, bytes FROM r1h")
def r2(spark, d):
    return settle(spark, S.rollup_stream(A.logs(_Streamed(spark), d), "1h"), "rollup")


@check("R3_realtime_stream", f"""WITH {WEB}, m AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS i FROM web WHERE NOT is_bot)
SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE * (i + 1) AS as_of, site_id, count(*) AS events FROM m GROUP BY 1, 2""")
def r3(spark, d):
    live = settle(spark, S.realtime_stream(A.web_events(_Streamed(spark), d).drop("utm")), "realtime")
    return live.drop("visitors")  # an estimate, so left out of the comparison


_LIVE = f"""WITH {WEB}, m AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS i FROM web WHERE NOT is_bot)
SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE * (i + 1) AS as_of, site_id, count(DISTINCT visitor_id) AS visitors, count(*) AS events FROM m GROUP BY 1, 2"""


@check("R3_sliding_visitors", _LIVE)
def r3b(spark, d):
    return sliding_visitors(visitor_minutes(A.web_events(spark, d)))


@check("R3_exact_stream", _LIVE)
def r3c(spark, d):
    root = _scratch(spark, "live")
    web = in_batches(spark, A.web_events(spark, d).drop("utm"), f"{root}/in", 3)
    drain(S.realtime_exact_stream(web, root, f"{root}/cp"))
    return spark.read.parquet(f"{root}/live").drop("part_day")


@check("R4_session_windows", f"""WITH {WEB}, s AS (SELECT *, lag(ts) OVER w AS p FROM web WHERE NOT is_bot AND visitor_id <> 0 WINDOW w AS (PARTITION BY site_id, visitor_id ORDER BY ts, event_key)),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY site_id, visitor_id ORDER BY ts, event_key ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT site_id, visitor_id, min(ts) AS start_ts, max(ts) + INTERVAL 12 HOUR AS end_ts, count(*) AS events, count(*) FILTER (WHERE event='pageview') AS pageviews FROM g GROUP BY site_id, visitor_id, g""")
def r4(spark, d):
    return settle(spark, S.session_count_stream(A.web_events(_Streamed(spark), d).drop("utm"), "12 hours"), "visits")


def in_batches(spark, df: DataFrame, path: str, batches: int = 5, files: int | None = None) -> DataFrame:
    """All rows of ``df`` as a stream of at most ``batches`` micro-batches, rows of all times in each.

    A micro-batch has ``files`` files, each written by a task of its own: by default a share of the
    session's shuffle partitions, so that no task writes or reads a whole batch.
    """
    files = files or max(4, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches))
    df.repartition(batches * files, F.xxhash64("event_key")).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@check("R4_session_stream", f"WITH {sql_sessions()} SELECT {_ALL} FROM ws")
def r4b(spark, d):
    root = _scratch(spark, "sessions")
    web = in_batches(spark, A.web_events(spark, d).drop("utm"), f"{root}/in")
    drain(S.session_stream(web, f"{root}/events", f"{root}/sessions", f"{root}/cp", GAP, buckets=4))
    return read_sessions(spark, f"{root}/sessions")


def late_rollups(spark, d):
    root = _scratch(spark, "late")
    web = in_batches(spark, A.web_events(spark, d).drop("utm"), f"{root}/in", 3)
    drain(S.web_rollup_stream(web, root, f"{root}/cp", GAP, buckets=4, top=5))
    return root


@check("R5_late_daily_rollup", sql_daily(5))
def r5(spark, d):
    return spark.read.parquet(f"{late_rollups(spark, d)}/daily").drop("part_day")


@check("R5_late_minute_rollup", f"""WITH {WEB} SELECT date_trunc('minute', ts) AS bucket, site_id, count(*) FILTER (WHERE event='pageview') AS pageviews, count(*) AS events
FROM web WHERE NOT is_bot GROUP BY 1, 2""")
def r5b(spark, d):
    return spark.read.parquet(f"{late_rollups(spark, d)}/minute").drop("part_day")


_FOLD, _ = sql_fold("true")


@check("R6_error_group_stream", f"WITH {LOGS}, f AS ({_FOLD}) SELECT fingerprint, service, level, title, first_seen, last_seen, n AS total_count, 'unresolved' AS status FROM f")
def r6(spark, d):
    root = _scratch(spark, "groups")
    drain(S.error_group_stream(A.logs(_Streamed(spark), d), f"{root}/groups", f"{root}/cp"))
    return S.read_snapshot(spark, f"{root}/groups").select(*[c for c in GROUP_COLUMNS[:9] if c != "exception_type"])


_STEPS = [{"comparator": ">=", "value": 0.2, "severity": "warning"}, {"comparator": ">=", "value": 0.3, "severity": "critical"}]


@check("R7_severity_stream", f"""WITH {LOGS}, h AS (SELECT CAST(substr(service, 5) AS BIGINT) AS rule_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, count(*) FILTER (WHERE level='error')::DOUBLE / count(*) AS value FROM logs GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN value >= 0.3 THEN 'critical' WHEN value >= 0.2 THEN 'warning' ELSE 'ok' END AS severity FROM h),
b AS (SELECT *, coalesce(lag(severity) OVER (PARTITION BY rule_id ORDER BY ts), 'ok') AS before FROM s)
SELECT rule_id, ts, round(value, 6) AS value, before, severity FROM b WHERE severity <> before""")
def r7(spark, d):
    """Ticks arrive out of order, in four batches; a last one moves the watermark past all others."""
    root = _scratch(spark, "severity")
    r = F.count_if(F.col("level") == "error") / F.count("*")
    ticks = A.logs(spark, d).groupBy(F.substring("service", 5, 9).cast("long").alias("rule_id"), F.date_trunc("day", "ts").alias("ts")).agg(r.alias("value"))
    last = spark.createDataFrame([(0, None, None)], "rule_id long, ts timestamp, value double").withColumn("ts", F.expr("TIMESTAMP '2030-01-01'"))
    observed = in_batches(spark, ticks.withColumn("event_key", F.xxhash64("rule_id", "ts")), f"{root}/in", 4, files=1)
    last.withColumn("event_key", F.lit(0).cast("long")).write.mode("append").parquet(f"{root}/in")
    rules = [{"rule_id": i, "condition": {"type": "threshold", "thresholds": _STEPS}} for i in range(8)]
    out = severity_stream(observed, rules, "400 days")
    drain(out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").outputMode("append"))
    return spark.read.parquet(f"{root}/out").withColumn("value", F.round("value", 6))


@check("R8_chunk_messages", """WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, l_orderkey, l_partkey, count(*) OVER w AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS seq FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
p AS (SELECT *, seq = total - 1 AND total > 1 AND l_orderkey % 7 = 0 AS late FROM l WHERE NOT (total % 5 = 0 AND seq = 0)),
g AS (SELECT msg_id, late, total, count(*) AS received, string_agg(l_partkey || ';', '' ORDER BY seq) AS payload FROM p GROUP BY 1, 2, 3)
SELECT msg_id, CASE WHEN received = total THEN payload END AS payload, received = total AS complete, received, total FROM g""")
def r8(spark, d):
    """Parts of orders in time order over three batches: some never come, some too late."""
    root = _scratch(spark, "messages")
    per = Window.partitionBy("l_orderkey")
    order = per.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    parts = A.table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_orderkey").cast("string").alias("msg_id"), (F.row_number().over(order) - 1).alias("seq"),
        F.count("*").over(per).cast("int").alias("total"), F.concat(F.col("l_partkey").cast("string"), F.lit(";")).alias("payload"),
    ).filter("NOT (total % 5 = 0 AND seq = 0)")
    late = F.expr("seq = total - 1 AND total > 1 AND l_orderkey % 7 = 0")
    at = F.col("l_orderkey") % 3 * 3600 + F.col("seq") % 5 * F.lit(0.5) + F.when(late, 30).otherwise(0)
    parts = parts.withColumn("receive_ts", F.expr("TIMESTAMP '2024-01-01'") + F.make_interval(secs=at.cast("decimal(18,6)")))
    parts.cache()
    batches = [parts.filter(F.col("l_orderkey") % 3 == hour) for hour in range(3)]
    batches.append(parts.limit(1).withColumns({"msg_id": F.lit("end"), "receive_ts": F.expr("TIMESTAMP '2030-01-01'")}))
    for batch in batches:  # any number of files: what has come since the last drain is one batch
        batch.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(parts.schema).parquet(f"{root}/in")
        out = chunk_messages(stream, 5, "10 seconds").filter("msg_id <> 'end'")
        drain(out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").outputMode("append"))
    parts.unpersist()
    return spark.read.parquet(f"{root}/out")
