"""Archive and retention jobs."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logspark.functions.text import glob_regex

MAX_NAME = 96


def safe_partition_name(name: Column) -> Column:
    """A directory-safe name; a checksum suffix keeps changed names apart.

    Letters, digits, ``_``, ``.`` and ``-`` are kept, everything else becomes ``_``.
    """
    mapped = F.regexp_replace(name, r"(?s)[^A-Za-z0-9_.-]", "_")
    trimmed = F.regexp_replace(F.substring(mapped, 1, MAX_NAME), r"[._ ]+$", "")
    filled = F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("unknown"))
    suffix = F.lower(F.lpad(F.hex(F.crc32(F.encode(name, "UTF-8"))), 8, "0"))
    changed = (filled != name) | (F.length(mapped) > MAX_NAME)
    return F.when(changed, F.concat(filled, F.lit("--"), suffix)).otherwise(filled)


def safe_site_name(site: Column) -> Column:
    return F.regexp_replace(site, r"(?s)[^A-Za-z0-9_-]", "_")


def split_hot(logs: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """(rows to archive, rows that stay) around a cutoff."""
    old = F.col("ts") < F.lit(cutoff)
    return logs.filter(old), logs.filter(~old)


def compact(logs: DataFrame, archive_path: str, hot_path: str, cutoff, **options) -> None:
    """Archive rows older than ``cutoff`` and write the rest as the new hot table.

    ``hot_path`` must differ from the table that ``logs`` reads; the caller swaps it in.
    """
    from logspark.sources.tiers import archive_logs

    archive_logs(logs, archive_path, cutoff, **options)
    _, stay = split_hot(logs, cutoff)
    stay.write.mode("overwrite").parquet(hot_path)


def hot_cap_steps(logs: DataFrame, cap_bytes: int, max_steps: int | None = None) -> DataFrame:
    """Hour steps that must leave the hot table, oldest first, to bring it under a byte cap.

    Steps are hours counted from the oldest row; empty hours take no step. Rows are summed per
    hour before the running total, so the window sees one row per hour. Without ``max_steps``
    as many steps are taken as the cap needs.
    """
    origin = logs.agg(F.min(F.unix_micros("ts"))).scalar()
    hour = F.floor((F.unix_micros("ts") - F.col("_origin")) / 3_600_000_000)
    hours = (
        logs.select("ts", "raw_len")
        .withColumn("_origin", origin)
        .groupBy(hour.alias("step"))
        .agg(
            F.sum(F.coalesce("raw_len", F.lit(0)).cast("long")).alias("bytes"),
            F.count(F.lit(1)).alias("rows"),
            F.min("_origin").alias("_origin"),
        )
    )
    newest_first = W.orderBy(F.col("step").desc()).rowsBetween(W.unboundedPreceding, 0)
    ranked = hours.withColumns(
        {
            "left_bytes": F.sum("bytes").over(newest_first),
            "nth": F.row_number().over(W.orderBy("step")),
        }
    )
    cutoff = F.timestamp_micros(F.col("_origin") + (F.col("step") + 1) * 3_600_000_000)
    over = F.col("left_bytes") > cap_bytes
    return ranked.filter(over if max_steps is None else over & (F.col("nth") <= max_steps)).select(
        F.col("step").cast("long"), cutoff.alias("cutoff"), "rows", "bytes",
        (F.col("left_bytes") - F.col("bytes")).alias("bytes_after"),
    )


def enforce_hot_cap(logs: DataFrame, cap_bytes: int, max_steps: int | None = None) -> DataFrame:
    """One row: the cutoff below which rows move to the archive, with rows and bytes moved."""
    return hot_cap_steps(logs, cap_bytes, max_steps).agg(
        F.max("cutoff").alias("cutoff"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("moved_rows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("moved_bytes"),
    )


def retention_days(service: Column, rules: list[tuple[str, int]], default_days: int) -> Column:
    """Days to keep a service's partitions; the first matching glob wins."""
    out = None
    for pattern, days in rules:
        safe = re.sub(r"[^A-Za-z0-9_.*?-]", "_", pattern)
        hit = service.rlike(glob_regex(safe))
        out = F.when(hit, F.lit(days)) if out is None else out.when(hit, F.lit(days))
    return F.lit(default_days) if out is None else out.otherwise(F.lit(default_days))


def expired_partitions(
    parts: DataFrame, rules: list[tuple[str, int]], default_days: int, today: date
) -> DataFrame:
    """Archive partitions (date, hour, service_part) past their retention."""
    days = retention_days(F.col("service_part"), rules, default_days)
    return parts.withColumn("keep_days", days).filter(
        F.to_date("date") < F.date_sub(F.lit(today), F.col("keep_days"))
    )


def expired_web(parts: DataFrame, days: int, today: date) -> DataFrame:
    """Web archive dates past their retention; sessions and rollups are kept."""
    return parts.filter(F.to_date("date") < F.lit(today - timedelta(days=max(days, 0))))
