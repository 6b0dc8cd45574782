"""Log search and summaries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions.json import FIELDS, as_json
from logspark.functions.text import contains_ci
from logspark.plans.ranges import first_rows, in_log_range

PAGE_COLUMNS = [
    "ts", "insert_ts", "source_host", "service", "level", "message", "fingerprint",
    "trace_id", "span_id", "attributes", "geo_country", "raw_len", "protocol",
]


def _newest(df: DataFrame) -> list[Column]:
    """Newest first; the event key settles ties where the table has one."""
    keys = [F.col(c).desc() for c in ("event_key",) if c in df.columns]
    return [F.col("ts").desc(), *keys]


def search_logs(
    logs: DataFrame, predicate: Column, start: datetime, end: datetime,
    limit: int | None = 100, offset: int = 0, promoted: tuple[str, ...] = (),
) -> DataFrame:
    """The newest page of matches with the total and a flag for more rows beyond it."""
    matches = logs.filter(predicate & in_log_range(F.col("ts"), start, end))
    page = first_rows(matches.orderBy(*_newest(matches)).offset(offset), limit).select(*PAGE_COLUMNS, *promoted)
    total = matches.agg(F.count(F.lit(1))).scalar()
    return page.withColumn("total_matched", total).withColumn(
        "truncated", F.lit(False) if limit is None else F.col("total_matched") > F.lit(offset + limit)
    )


def count_logs(logs: DataFrame, predicate: Column, start: datetime, end: datetime) -> DataFrame:
    return logs.filter(predicate & in_log_range(F.col("ts"), start, end)).agg(
        F.count(F.lit(1)).alias("count")
    )


def recent_messages(logs: DataFrame, text: str = "", limit: int | None = 100) -> DataFrame:
    rows = logs if not text.strip() else logs.filter(F.ilike("message", F.lit(f"%{text.strip()}%")))
    return first_rows(rows.orderBy(*_newest(rows)), limit).select("ts", "service", "level", "message")


def list_services(registry: DataFrame, text: str = "", limit: int = 100) -> DataFrame:
    """Services whose name contains ``text``, most recently seen first, with the registry size."""
    rows = registry.filter(contains_ci(F.col("name"), text)) if text else registry
    total = registry.agg(F.count(F.lit(1))).scalar()
    return (
        rows.orderBy(F.col("last_seen").desc_nulls_last(), "name")
        .limit(limit)
        .select("name", "last_seen", F.coalesce("total", F.lit(0)).alias("total"))
        .withColumn("registered", total)
    )


def query_all(all_tiers: DataFrame, condition: str, start: datetime, end: datetime, limit: int | None = None) -> DataFrame:
    """Rows of both tiers under a SQL condition, newest first."""
    rows = all_tiers.filter(F.expr(condition) & in_log_range(F.col("ts"), start, end))
    return first_rows(rows.orderBy(*_newest(rows)), limit)


def level_counts(rollup: DataFrame, now: datetime, hours: int = 1) -> DataFrame:
    since = now - timedelta(hours=max(hours, 1))
    return (
        rollup.filter(F.col("bucket") >= F.lit(since)).groupBy("level").agg(F.sum("n").alias("n"))
    )


def top_services(
    logs: DataFrame, now: datetime, hours: int = 1, predicate: Column | None = None, limit: int = 10
) -> DataFrame:
    since = now - timedelta(hours=max(hours, 1))
    keep = F.col("ts") >= F.lit(since)
    return (
        logs.filter(keep if predicate is None else keep & predicate)
        .groupBy(F.coalesce("service", F.lit("")).alias("service"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == "error").alias("errors"))
        .orderBy(F.col("n").desc(), "service")
        .limit(limit)
    )


def pulse(minute_rollup: DataFrame, hour_rollup: DataFrame, now: datetime) -> DataFrame:
    """One row: logs in the last minute and services active in the last day."""
    services = (
        hour_rollup.filter(F.col("bucket") >= F.lit(now - timedelta(hours=24)))
        .agg(F.countDistinct("service"))
        .scalar()
    )
    return (
        minute_rollup.filter(F.col("bucket") >= F.lit(now - timedelta(seconds=60)))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("logs_per_minute"))
        .withColumn("active_services_24h", services)
    )


def window_summary(logs: DataFrame, start: datetime, end: datetime, top: int = 5) -> DataFrame:
    """One row: totals, error rate, the busiest services and hints.

    The logs are counted once per service; everything else works on those few rows.
    """
    per_service = (
        logs.filter(in_log_range(F.col("ts"), start, end))
        .groupBy(F.coalesce("service", F.lit("")).alias("service"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == "error").alias("errors"))
    )
    busiest = (
        per_service.orderBy(F.col("n").desc(), "service")
        .limit(top)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "service"))),
                lambda e: F.struct(e["service"].alias("service"), (-e["rank"]).alias("n")),
            )
        )
        .scalar()
    )
    rate = F.coalesce(F.try_divide(F.col("errors").cast("double"), F.col("total")), F.lit(0.0))
    hints = F.filter(
        F.array(
            F.when(
                F.col("error_rate") > 0.05,
                F.concat(F.format_string("%.2f", F.col("error_rate") * 100), F.lit(" % of all rows are errors")),
            ),
            F.when(F.col("total") == 0, F.lit("no rows between the given times")),
        ),
        lambda h: h.isNotNull(),
    )
    return (
        per_service.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
            F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        )
        .withColumn("error_rate", rate)
        .withColumn("top_services", busiest)
        .withColumn("hints", hints)
    )


def top_services_by_rollup(rollup: DataFrame, limit: int = 20) -> DataFrame:
    return (
        rollup.groupBy("service")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), "service")
        .limit(limit)
    )


def attribute_paths(rows: DataFrame, key: str) -> DataFrame:
    """Attribute leaves as (key, path, value) rows; arrays stay JSON text.

    One level of nesting is unfolded at a time until no object is left.
    """
    level = rows.select(
        key,
        F.lit("").alias("path"),
        F.try_parse_json("attributes").alias("v"),
    ).filter(F.schema_of_variant("v").startswith("OBJECT"))
    done = None
    while True:
        members = level.select(
            key, "path", F.explode(F.try_variant_get("v", "$", FIELDS)).alias("name", "member")
        ).select(
            key,
            F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "name").alias("path"),
            F.col("member").alias("v"),
        )
        deeper = F.schema_of_variant("v").rlike("^OBJECT<.+>$")
        leaves = members.filter(~deeper).select(key, "path", as_json(F.col("v")).alias("value"))
        done = leaves if done is None else done.unionByName(leaves)
        level = members.filter(deeper)
        if level.isEmpty():
            return done


def flatten_attributes(
    logs: DataFrame, predicate: Column, start: datetime, end: datetime,
    limit: int | None = None, key: str = "event_key",
) -> DataFrame:
    """The newest matches with one ``attr.<dot.path>`` column per attribute leaf.

    A table this wide is for exports: its columns are the different paths of the exported rows,
    which go to the driver. ``attribute_paths`` gives the same leaves as rows for any number of
    paths.
    """
    matches = logs.filter(predicate & in_log_range(F.col("ts"), start, end))
    page = first_rows(matches.orderBy(*_newest(matches)), limit)
    paths = attribute_paths(page, key)
    names = [r["path"] for r in paths.select("path").distinct().orderBy("path").collect()]
    if not names:
        return page.drop("attributes")
    bare = page.select(key, F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("value"))
    wide = paths.unionByName(bare).groupBy(key).pivot("path", names).agg(F.first("value", True))
    renamed = wide.select(key, *[F.col(f"`{n}`").alias(f"attr.{n}") for n in names])
    return page.drop("attributes").join(renamed, key)
