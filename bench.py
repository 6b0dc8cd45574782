"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

from logspark.session import checkpoint_dir, local_session
from registry.core import END, GAP, START

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
def seconds(run, repeats: int = 3) -> float:
    """Median of ``repeats`` runs after a warm-up."""
    run()
    times = []
    for _ in range(repeats):
        begin = time.perf_counter()
        run()
        times.append(time.perf_counter() - begin)
    return round(statistics.median(times), 3)


def records_per_second(spark) -> tuple[int, float]:
    """JSON records normalised per second, from cached raw text to finished log rows."""
    from pyspark.sql import functions as F

    from logspark.normalise.logs import normalise
    from logspark.sources.adapters import table

    lines = table(spark, SF_DIR, "lineitem")
    level = F.element_at(F.array(*[F.lit(x) for x in ("INFO", "WARN", "error", "debug")]), F.col("l_linenumber") % 4 + 1)
    record = F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.concat(F.lit("svc-"), F.col("l_suppkey").cast("string")).alias("service"),
        level.alias("level"),
        F.concat(F.lit("GET /part/"), F.col("l_partkey").cast("string"), F.lit(" took "), F.col("l_quantity").cast("string")).alias("msg"),
        F.col("l_orderkey").alias("request_id"), F.col("l_extendedprice").alias("dur_ms"), F.col("l_returnflag").alias("status"),
    )
    raw = lines.select(
        F.lit(START).alias("receive_ts"), F.lit("10.0.0.1").alias("source_addr"), F.lit("http_json").alias("protocol"),
        F.to_json(record).alias("raw"),
    ).repartition(spark.sparkContext.defaultParallelism).cache()
    count = raw.count()
    took = seconds(lambda: normalise(raw).write.format("noop").mode("overwrite").save())
    raw.unpersist()
    return count, took


def stored_tables(spark) -> dict:
    """The tables an installation keeps on disk: logs, stamped web events, sessions, rollup."""
    from logspark.operators.rollups import rollup_logs
    from logspark.operators.sessions import sessionize, stamp_sessions
    from logspark.sources import adapters

    root = f"{checkpoint_dir(spark)}/bench-{uuid.uuid4().hex}"
    logs, web = adapters.logs(spark, SF_DIR), adapters.web_events(spark, SF_DIR)
    made = {
        "logs": logs,
        "rollup_1m": rollup_logs(logs, "1m"),
        "web_events": stamp_sessions(web, GAP),
        "web_sessions": sessionize(web, GAP),
    }
    for name, df in made.items():
        df.write.parquet(f"{root}/{name}")
    return {name: spark.read.parquet(f"{root}/{name}") for name in made}


def main() -> None:
    from logspark.operators import anomaly, errors, rollups, search, sessions, web_reports, web_rollups
    from logspark.plans.predicates import compile_predicate
    from logspark.sources import adapters

    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    t = stored_tables(spark)
    logs, web, visits = t["logs"], t["web_events"], t["web_sessions"]
    is_error = compile_predicate(["or", ["level", "=", "error"], ["level", "=", "fatal"]], logs.schema)
    steps = ["/p/*", "event:*u*", "outbound:ext*.example.com", "/p/1*"]
    headline = {
        "search_logs": lambda: search.search_logs(logs, is_error, START, END, 100, 50),
        "rollup_minute": lambda: rollups.rollup_logs(logs, "1m"),
        "web_rollup_daily": lambda: web_rollups.web_rollup_daily(web, visits),
        "sessionize": lambda: sessions.sessionize(adapters.web_events(spark, SF_DIR)),
        "stamp_sessions": lambda: sessions.stamp_sessions(adapters.web_events(spark, SF_DIR), GAP),
        "funnel": lambda: web_reports.funnel(web, steps, START, END),
        "web_summary": lambda: web_reports.web_summary(web, visits, START, END),
        "fold_error_groups": lambda: errors.fold_error_groups(logs),
        "anomaly_cycle": lambda: anomaly.anomaly_cycle(t["rollup_1m"]),
    }
    queries = {}
    for label, make in headline.items():
        queries[label] = seconds(lambda: make().write.format("noop").mode("overwrite").save())
        print(label, queries[label], file=sys.stderr)
    count, took = records_per_second(spark)
    queries["normalise_json"] = took
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "normalise_json_records_per_sec": round(count / took),
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
