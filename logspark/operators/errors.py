"""Error groups: folding error rows by fingerprint, merging, transitions, lists."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logspark.functions.levels import level_rank, rank_of
from logspark.functions.text import message_fingerprint, variant_hash
from logspark.functions.timestamps import bucket
from logspark.operators.rollups import attribute

SAMPLES = 3
SAMPLES_TYPE = "array<struct<variant_hash:string,first_seen:timestamp,stack:string>>"
GROUP_COLUMNS = [
    "fingerprint", "service", "level", "title", "exception_type", "first_seen", "last_seen",
    "total_count", "status", "resolved_at", "samples", "variant_hashes",
]


def with_fingerprint(logs: DataFrame) -> DataFrame:
    """Error and fatal rows without a fingerprint get one from service and message."""
    missing = F.col("level").isin("error", "fatal") & (F.coalesce("fingerprint", F.lit("")) == "")
    return logs.withColumn(
        "fingerprint",
        F.when(missing, message_fingerprint(F.coalesce("service", F.lit("")), F.col("message"))).otherwise(
            F.col("fingerprint")
        ),
    )


def _level(rank: Column) -> Column:
    return F.when(rank >= 3, "fatal").otherwise("error")


def fold_error_groups(batch: DataFrame, samples: int = SAMPLES, key: str = "event_key") -> DataFrame:
    """One row per fingerprint of a batch, with at most ``samples`` distinct stack variants.

    Rows are folded per (fingerprint, variant) before any window, so an error storm on one
    fingerprint moves one row per variant and task. The order of rows is (ts, ``key``).
    """
    rows = batch.filter(
        F.col("level").isin("error", "fatal") & (F.coalesce("fingerprint", F.lit("")) != "")
    ).select(
        "fingerprint", "service", "level", "ts", key,
        F.col("message").alias("title"),
        attribute("stack").alias("stack"),
        attribute("exception_type").alias("exception_type"),
    )
    first = F.struct("ts", key, "service", "title", "exception_type", "stack")
    variants = (
        rows.withColumn("variant", F.when(F.col("stack").isNotNull(), variant_hash(F.col("stack"))))
        .groupBy("fingerprint", "variant")
        .agg(
            F.min(first).alias("first"),
            F.max("ts").alias("last_seen"),
            F.count(F.lit(1)).alias("count"),
            F.max(level_rank(F.col("level"))).alias("rank"),
        )
    )
    groups = variants.groupBy("fingerprint").agg(
        F.min("first").alias("first"),
        F.max("last_seen").alias("last_seen"),
        F.sum("count").alias("count"),
        F.max("rank").alias("rank"),
    )
    arrival = W.partitionBy("fingerprint").orderBy("first")
    picked = (
        variants.withColumn("nth", F.row_number().over(arrival))
        .filter(F.col("nth") <= max(samples, 1))
        .groupBy("fingerprint")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "variant", "first"))).alias("picked"))
    )
    title = F.col("first.title")
    return (
        groups.join(picked, "fingerprint")
        .withColumn("title_hash", variant_hash(title))
        .select(
            "fingerprint",
            F.col("first.service").alias("service"),
            _level(F.col("rank")).alias("level"),
            title.alias("title"),
            F.col("first.exception_type").alias("exception_type"),
            F.col("first.ts").alias("first_seen"),
            "last_seen",
            "count",
            F.transform(
                "picked",
                lambda p: F.struct(
                    F.coalesce(p["variant"], F.col("title_hash")).alias("variant_hash"),
                    p["first"]["ts"].alias("first_seen"),
                    p["first"]["stack"].alias("stack"),
                ),
            )
            .cast(SAMPLES_TYPE)
            .alias("samples"),
        )
    )


def rotate_samples(old: Column, new: Column, most: int = SAMPLES) -> Column:
    """Samples after new variants: slot 0 stays, the oldest other slot makes room."""

    def add(kept: Column, s: Column) -> Column:
        known = F.exists(kept, lambda k: k["variant_hash"] == s["variant_hash"])
        grown = F.concat(kept, F.array(s))
        turned = F.concat(F.slice(kept, 1, 1), F.slice(kept, 3, most), F.array(s))
        return (
            F.when(known, kept)
            .when(F.size(kept) < most, grown)
            .when(F.size(kept) >= 2, turned)
            .otherwise(kept)
        )

    empty = F.array().cast(SAMPLES_TYPE)
    start = F.coalesce(old.cast(SAMPLES_TYPE), empty)
    return F.aggregate(F.coalesce(new.cast(SAMPLES_TYPE), empty), start, add)


def _joined(groups: DataFrame, fold: DataFrame) -> DataFrame:
    return groups.alias("g").join(
        fold.alias("f"), F.col("g.fingerprint") == F.col("f.fingerprint"), "full_outer"
    )


def merge_error_groups(groups: DataFrame, fold: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The group table after a fold: new groups, updated counts, reopened resolved groups.

    A level is never lowered and ``first_seen`` is the earliest event ever seen.
    """
    g, f = (lambda c: F.col(f"g.{c}")), (lambda c: F.col(f"f.{c}"))
    hit = f("fingerprint").isNotNull()
    old = g("fingerprint").isNotNull()
    status = F.coalesce(g("status"), F.lit("unresolved"))
    reopened = hit & old & (status == "resolved")
    merged_samples = rotate_samples(g("samples"), f("samples"), samples)
    worst = F.greatest(level_rank(g("level")), level_rank(f("level")))
    return _joined(groups, fold).select(
        F.coalesce(g("fingerprint"), f("fingerprint")).alias("fingerprint"),
        F.when(old, g("service")).otherwise(f("service")).alias("service"),
        F.when(hit, _level(worst)).otherwise(g("level")).alias("level"),
        F.coalesce(g("title"), f("title")).alias("title"),
        F.when(old, g("exception_type")).otherwise(f("exception_type")).alias("exception_type"),
        F.least(g("first_seen"), f("first_seen")).alias("first_seen"),
        F.greatest(g("last_seen"), f("last_seen")).alias("last_seen"),
        (F.coalesce(g("total_count"), F.lit(0)) + F.coalesce(f("count"), F.lit(0))).alias("total_count"),
        F.when(reopened, "unresolved").otherwise(status).alias("status"),
        F.when(~reopened, g("resolved_at")).alias("resolved_at"),
        F.when(hit, merged_samples).otherwise(g("samples")).alias("samples"),
        F.when(hit, F.transform(merged_samples, lambda s: s["variant_hash"]))
        .otherwise(g("variant_hashes"))
        .alias("variant_hashes"),
    )


def group_transitions(groups: DataFrame, fold: DataFrame, min_level: str = "error") -> DataFrame:
    """What a fold does to each of its groups: created, regressed or updated."""
    g, f = (lambda c: F.col(f"g.{c}")), (lambda c: F.col(f"f.{c}"))
    change = (
        F.when(g("fingerprint").isNull(), "created")
        .when(g("status") == "resolved", "regressed")
        .otherwise("updated")
    )
    return (
        fold.alias("f")
        .join(groups.alias("g"), F.col("g.fingerprint") == F.col("f.fingerprint"), "left")
        .filter(level_rank(f("level")) >= rank_of(min_level))
        .select(
            f("fingerprint").alias("fingerprint"),
            change.alias("transition"),
            F.coalesce(g("service"), f("service")).alias("service"),
            F.coalesce(g("title"), f("title")).alias("title"),
            f("level").alias("level"),
            (F.coalesce(g("total_count"), F.lit(0)) + f("count")).alias("count"),
            F.least(g("first_seen"), f("first_seen")).alias("first_seen"),
            F.greatest(g("last_seen"), f("last_seen")).alias("last_seen"),
        )
    )


def reconcile_groups(groups: DataFrame, logs: DataFrame) -> DataFrame:
    """Counts and last times recomputed from retained logs; groups without any stay as they are."""
    seen = (
        logs.filter(F.col("fingerprint").isNotNull())
        .groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last"))
    )
    return (
        groups.join(seen, "fingerprint", "left")
        .withColumns(
            {
                "total_count": F.coalesce("_n", "total_count"),
                "last_seen": F.coalesce("_last", "last_seen"),
            }
        )
        .select(*groups.columns)
    )


def list_groups(
    groups: DataFrame, now: datetime, window_seconds: int = 7 * 86400, status: str | None = None,
    service: str | None = None, text: str | None = None, sort: str = "recent",
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of groups seen in the window, with the number of matches.

    ``status`` is unresolved (default), resolved, ignored or all.
    """
    keep = F.col("last_seen") >= F.lit(now - timedelta(seconds=max(window_seconds, 1)))
    if status in (None, "unresolved", "resolved", "ignored"):
        keep = keep & (F.col("status") == (status or "unresolved"))
    if service is not None:
        keep = keep & (F.col("service") == service)
    if text is not None:
        like = F.lit(f"%{text}%")
        keep = keep & (F.ilike("title", like) | F.ilike("exception_type", like))
    rows = groups.filter(keep)
    order = [F.col("last_seen").desc(), F.col("fingerprint")]
    if sort == "count":
        order = [F.col("total_count").desc(), *order]
    total = rows.agg(F.count(F.lit(1))).scalar()
    return (
        rows.orderBy(*order)
        .offset(offset)
        .limit(limit)
        .select(*GROUP_COLUMNS[:10])
        .withColumn("total_matched", total)
    )


def group_detail(
    groups: DataFrame, error_rollup: DataFrame, fingerprint: str, now: datetime,
    window_seconds: int = 86400,
) -> DataFrame:
    """One group with its samples and its events per minute over the window."""
    since = F.lit(now - timedelta(seconds=max(window_seconds, 60)))
    minutes = (
        error_rollup.filter((F.col("fingerprint") == fingerprint) & (F.col("bucket") >= since))
        .groupBy("bucket")
        .agg(F.sum("count").alias("count"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("bucket").alias("ts"), "count"))))
        .scalar()
    )
    return groups.filter(F.col("fingerprint") == fingerprint).withColumn("spark", minutes)


def set_group_status(groups: DataFrame, changes: DataFrame) -> DataFrame:
    """Groups after a change table (fingerprint, status, at); status ``deleted`` removes a group."""
    picked = changes.groupBy("fingerprint").agg(F.max(F.struct("at", "status")).alias("_change"))
    status = F.col("_change.status")
    return (
        groups.join(picked, "fingerprint", "left")
        .filter(F.coalesce(status != "deleted", F.lit(True)))
        .withColumns(
            {
                "resolved_at": F.when(status == "resolved", F.col("_change.at"))
                .when(status.isNotNull(), F.lit(None).cast("timestamp"))
                .otherwise(F.col("resolved_at")),
                "status": F.coalesce(status, F.col("status")),
            }
        )
        .select(*groups.columns)
    )


def new_groups(fold: DataFrame) -> DataFrame:
    """A fold as the first group table."""
    return fold.select(
        "fingerprint", "service", "level", "title", "exception_type", "first_seen", "last_seen",
        F.col("count").alias("total_count"), F.lit("unresolved").alias("status"),
        F.lit(None).cast("timestamp").alias("resolved_at"), "samples",
        F.transform("samples", lambda s: s["variant_hash"]).alias("variant_hashes"),
    )


def error_minutes(logs: DataFrame) -> DataFrame:
    """Events per (minute, fingerprint) of error rows."""
    return (
        logs.filter(F.col("fingerprint").isNotNull())
        .groupBy(bucket(F.col("ts"), "1m").alias("bucket"), "fingerprint")
        .agg(F.count(F.lit(1)).alias("count"))
    )
