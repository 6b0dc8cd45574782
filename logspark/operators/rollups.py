"""Minute and hour rollups, the service registry, and metrics answered from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions.timestamps import bucket
from logspark.plans.ranges import in_log_range, log_width

FRACTIONS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
ACCURACY = 10_000


def attribute(name: str) -> Column:
    """A top-level attribute as text."""
    return F.get_json_object("attributes", f"$['{name}']")


def duration_ms() -> Column:
    return attribute("duration_ms").try_cast("double")


def percentiles(value: Column, exact: bool = False) -> list[Column]:
    """p50, p95 and p99 with bounded memory per group; ``exact`` interpolates over all values.

    The exact form keeps every distinct value of a group in memory, so it is meant for small
    groups and for checks.
    """
    if exact:
        return [F.percentile(value, q).alias(name) for name, q in FRACTIONS.items()]
    return [F.percentile_approx(value, q, ACCURACY).alias(name) for name, q in FRACTIONS.items()]


def rollup_logs(logs: DataFrame, width: str = "1m", exact: bool = False) -> DataFrame:
    """Counts, bytes and latency percentiles per (bucket, service, level)."""
    blank, zero = F.lit(""), F.lit(0.0)
    grouped = (
        logs.select(
            bucket(F.col("ts"), width).alias("bucket"),
            F.coalesce("service", blank).alias("service"),
            F.coalesce("level", blank).alias("level"),
            "raw_len",
            duration_ms().alias("duration_ms"),
        )
        .groupBy("bucket", "service", "level")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *percentiles(F.col("duration_ms"), exact),
            F.coalesce(F.sum(F.col("raw_len").cast("long")), F.lit(0)).alias("bytes"),
        )
    )
    return grouped.withColumns({p: F.coalesce(p, zero) for p in FRACTIONS}).select(
        "bucket", "service", "level", "n", "p50", "p95", "p99", "bytes"
    )


def rollup_errors(logs: DataFrame) -> DataFrame:
    """Events per (minute, fingerprint)."""
    return (
        logs.filter(F.col("fingerprint").isNotNull() & (F.col("fingerprint") != ""))
        .groupBy(bucket(F.col("ts"), "1m").alias("bucket"), "fingerprint")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def replace_buckets(fresh: DataFrame, path: str, column: str = "bucket") -> None:
    """Replace the days that ``fresh`` covers in a rollup table partitioned by ``day``.

    ``fresh`` must hold whole days, so late rows are counted once and reruns change nothing.
    """
    (
        fresh.withColumn("day", F.to_date(column))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def service_totals(logs: DataFrame) -> DataFrame:
    return (
        logs.filter(F.col("service").isNotNull() & (F.col("service") != ""))
        .groupBy(F.col("service").alias("name"))
        .agg(
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.count(F.lit(1)).alias("total"),
        )
    )


def merge_services(registry: DataFrame | None, fresh_logs: DataFrame) -> DataFrame:
    """The registry after adding the services of ``fresh_logs``.

    Without a registry the caller passes all tiers, which backfills every service.
    """
    fresh = service_totals(fresh_logs)
    if registry is None:
        return fresh
    return (
        registry.select("name", "first_seen", "last_seen", "total")
        .unionByName(fresh)
        .groupBy("name")
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.sum("total").alias("total"),
        )
    )


def _pick(rollups: dict[str, DataFrame], width: str, start, end) -> DataFrame:
    return rollups[width].filter(in_log_range(F.col("bucket"), start, end))


def volume(
    start: datetime, end: datetime, *, logs: DataFrame | None = None,
    predicate: Column | None = None, rollups: dict[str, DataFrame] | None = None,
    bucket_choice: str | None = None,
) -> DataFrame:
    """Rows per bucket: from the rollup of the right width, or from the logs under a predicate."""
    width = log_width(start, end, bucket_choice)
    if predicate is None:
        return (
            _pick(rollups, width, start, end).groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket")
        )
    return (
        logs.filter(predicate & in_log_range(F.col("ts"), start, end))
        .groupBy(bucket(F.col("ts"), width).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("bucket")
    )


def error_rate(
    start: datetime, end: datetime, *, logs: DataFrame | None = None,
    predicate: Column | None = None, rollups: dict[str, DataFrame] | None = None,
    bucket_choice: str | None = None, by: tuple[str, ...] = (),
) -> DataFrame:
    """Errors, total and their ratio per bucket; only level ``error`` counts as an error."""
    width = log_width(start, end, bucket_choice)
    is_error = F.col("level") == "error"
    if predicate is None:
        grouped = (
            _pick(rollups, width, start, end)
            .groupBy("bucket", *by)
            .agg(
                F.coalesce(F.sum(F.when(is_error, F.col("n"))), F.lit(0)).alias("errors"),
                F.sum("n").alias("total"),
            )
        )
    else:
        grouped = (
            logs.filter(predicate & in_log_range(F.col("ts"), start, end))
            .groupBy(bucket(F.col("ts"), width).alias("bucket"), *by)
            .agg(F.count_if(is_error).alias("errors"), F.count(F.lit(1)).alias("total"))
        )
    rate = F.coalesce(F.try_divide(F.col("errors").cast("double"), F.col("total")), F.lit(0.0))
    return grouped.withColumn("rate", rate).orderBy("bucket", *by)


def latency(
    start: datetime, end: datetime, *, logs: DataFrame | None = None,
    predicate: Column | None = None, rollups: dict[str, DataFrame] | None = None,
    bucket_choice: str | None = None, exact: bool = False,
) -> DataFrame:
    """p50, p95 and p99 per (bucket, service); from rollups the worst level's value."""
    width = log_width(start, end, bucket_choice)
    if predicate is None:
        return (
            _pick(rollups, width, start, end)
            .filter(F.col("p95") > 0)
            .groupBy("bucket", "service")
            .agg(*[F.max(p).alias(p) for p in FRACTIONS])
            .orderBy("bucket", "service")
        )
    grouped = (
        logs.filter(predicate & in_log_range(F.col("ts"), start, end))
        .select(
            bucket(F.col("ts"), width).alias("bucket"),
            F.coalesce("service", F.lit("")).alias("service"),
            duration_ms().alias("duration_ms"),
        )
        .groupBy("bucket", "service")
        .agg(*percentiles(F.col("duration_ms"), exact))
    )
    return grouped.withColumns({p: F.coalesce(p, F.lit(0.0)) for p in FRACTIONS}).orderBy(
        "bucket", "service"
    )


LATENCY_METRICS = {"p50_latency": "p50", "p95_latency": "p95", "p99_latency": "p99"}
SITE_METRIC = "web_pageviews:"


def metric_columns(names: list[str], since: Column) -> dict[str, Column]:
    """One aggregate per log metric over a rollup, restricted to buckets from ``since``."""
    inside = F.col("bucket") >= since
    n = F.when(inside, F.col("n"))
    total = F.coalesce(F.sum(n), F.lit(0)).cast("double")
    out = {}
    for name in names:
        if name == "volume":
            out[name] = total
        elif name == "error_rate":
            errors = F.sum(F.when(inside & (F.col("level") == "error"), F.col("n"))).cast("double")
            out[name] = F.coalesce(F.try_divide(errors, total), F.lit(0.0))
        elif name in LATENCY_METRICS:
            weighted = F.sum(F.when(inside & (F.col("n") > 0), F.col(LATENCY_METRICS[name]) * F.col("n")))
            out[name] = F.coalesce(F.try_divide(weighted, total), F.lit(0.0))
        else:
            raise ValueError(f"unsupported metric '{name}'")
    return out


def metric_value(
    name: str, since: datetime, rollup: DataFrame | None = None, web_rollup: DataFrame | None = None
) -> DataFrame:
    """One row (metric, value) over the buckets from ``since`` on."""
    if name.startswith(SITE_METRIC):
        site = name.removeprefix(SITE_METRIC)
        if not site or len(site) > 64 or "'" in site:
            raise ValueError(f"unsupported metric '{name}'")
        rows = web_rollup.filter((F.col("bucket") >= F.lit(since)) & (F.col("site_id") == site))
        value = F.coalesce(F.sum("pageviews"), F.lit(0)).cast("double")
    else:
        rows = rollup.filter(F.col("bucket") >= F.lit(since))
        value = metric_columns([name], F.lit(since))[name]
    return rows.agg(value.alias("value")).select(F.lit(name).alias("metric"), "value")


def metric_series(
    logs: DataFrame, name: str, start: datetime, end: datetime, service: str | None = None,
    bucket_choice: str | None = None,
) -> DataFrame:
    """Mean value and point count per bucket of one metric."""
    rows = logs.filter(
        (F.col("protocol") == "otlp_metric")
        & (F.col("message") == name)
        & in_log_range(F.col("ts"), start, end)
    )
    if service is not None:
        rows = rows.filter(F.col("service") == service)
    return (
        rows.groupBy(bucket(F.col("ts"), log_width(start, end, bucket_choice)).alias("bucket"))
        .agg(
            F.avg(attribute("value").try_cast("double")).alias("value"),
            F.count(F.lit(1)).alias("n"),
        )
        .orderBy("bucket")
    )


def panel_number(kind: str, rows: DataFrame) -> DataFrame:
    """One number of a series: total volume, pooled error percent, worst p95, or a count."""
    if kind == "volume":
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("value"))
    if kind == "error_rate":
        ratio = F.try_divide(F.sum("errors").cast("double") * 100, F.sum("total"))
        return rows.agg(F.coalesce(ratio, F.lit(0.0)).alias("value"))
    if kind == "latency":
        return rows.agg(F.coalesce(F.max("p95"), F.lit(0.0)).alias("value"))
    if kind == "count":
        return rows.agg(F.count(F.lit(1)).cast("double").alias("value"))
    raise ValueError(f"unknown panel {kind!r}")
