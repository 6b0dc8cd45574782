"""Minute and day rollups of web traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logspark.functions.text import clean_label
from logspark.functions.timestamps import bucket
from logspark.operators.sessions import GAP_SECONDS, VISITOR, session_rows
from logspark.operators.visit_store import day_of, stamp_from_visits
from logspark.operators.web_reports import human, real_session, views
from logspark.plans.skew import HOT_ROWS

DIMENSIONS = ["path", "source", "country", "region", "city", "device", "browser", "os"]
MEASURES = ["pageviews", "visitors", "sessions", "bounces", "engaged_ms"]
OTHER = "(other)"
VALUE = ["day", "site_id", "dim", "dim_value"]


def web_rollup_minute(events: DataFrame) -> DataFrame:
    return (
        events.filter(human())
        .groupBy(bucket(F.col("ts"), "1m").alias("bucket"), "site_id")
        .agg(views().alias("pageviews"), F.count(F.lit(1)).alias("events"))
    )


def daily_values(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Exact daily numbers of every value of the eight dimensions, in one scan.

    Events are first folded to one row per (day, site, visitor, session and label tuple), so
    the eight-fold copy works on folded rows. Distinct counts come from counting rows per
    session, then per visitor (a session has one visitor): every step shrinks before it is
    shuffled, and no row is copied per distinct column.
    """
    return _per_value(_stamped_visitors(events, sessions))


def daily_values_of_visits(events: DataFrame, visits: DataFrame, gap_seconds: int = GAP_SECONDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``daily_values`` of events without session ids, from the visits (see ``visit_store``) they were cut into.

    Events are joined with the visits of their visitor and day, so one shuffle of the events, by (day, site,
    visitor), serves the join, the fold and both distinct counts. Visitors that could have about ``hot_rows``
    events a day, and events without a visitor or site, don't fit a task: they are stamped and counted as in ``daily_values``.
    """
    busy_visit = max(hot_rows * (gap_seconds + 1) // 86_400, 1)  # a day has at most 86,400 / (gap + 1) visits of a visitor, and one
    busy = F.broadcast(visits.filter(F.col("events") > busy_visit).select(*VISITOR, F.lit(True).alias("_busy")).distinct())
    marked = events.filter(human()).join(busy, VISITOR, "left")
    is_calm = F.coalesce((F.col("visitor_id") != 0) & F.col("site_id").isNotNull(), F.lit(False)) & F.col("_busy").isNull()

    bounced = (F.col("pageviews") == 1) & (F.col("interactions") == 0)
    spans = visits.select(
        *[F.col(c).alias(f"_{c}") for c in VISITOR], "first_s", "last_s",
        F.explode(F.sequence(day_of(F.col("first_s")), day_of(F.col("last_s")))).alias("_day"),
        F.when(F.col("start_ts").isNotNull(), F.col("first_s")).alias("session_id"),  # tells the sessions of a visitor apart
        F.when(F.col("start_ts").isNotNull() & bounced, F.lit(True)).alias("bounced"),
    )
    own = (F.col("day") == F.col("_day")) & (F.col("site_id") == F.col("_site_id")) & (F.col("visitor_id") == F.col("_visitor_id"))
    calm = (
        _labelled(marked.filter(is_calm), F.unix_seconds("ts").alias("_at"))
        .join(spans, own & F.col("_at").between(F.col("first_s"), F.col("last_s")), "left")
    )
    visitors = _per_visitor(_folded(calm, "bounced"))
    loud = marked.filter(~is_calm).drop("_busy")
    if not loud.isEmpty():
        visitors = visitors.unionByName(_stamped_visitors(stamp_from_visits(loud, visits, gap_seconds), session_rows(visits)))
    return _per_value(visitors)


def _labelled(events: DataFrame, *more: Column) -> DataFrame:
    labels = [clean_label(F.col(d), "(none)").alias(d) for d in DIMENSIONS]
    return events.select(F.to_date("ts").alias("day"), *VISITOR, *more, "event", "value", *labels)


def _folded(labelled: DataFrame, *keys: str) -> DataFrame:
    """One row per (day, site, visitor, session and label tuple)."""
    return labelled.groupBy("day", *VISITOR, "session_id", *keys, *DIMENSIONS).agg(
        views().alias("pageviews"),
        F.sum(F.when(F.col("event") == "engagement", F.coalesce("value", F.lit(0.0))).otherwise(0.0)).alias("engaged_ms"),
    )


def _stamped_visitors(events: DataFrame, sessions: DataFrame) -> DataFrame:
    bounced = sessions.filter("is_bounce").select("session_id", F.lit(0).alias("_spread"), F.lit(True).alias("bounced"))
    # events outside sessions join nothing: they spread over all tasks instead of meeting in one
    spread = F.when(F.col("session_id").isNull(), F.pmod(F.xxhash64("day", "site_id", "visitor_id", *DIMENSIONS), F.lit(1 << 20))).otherwise(F.lit(0)).cast("int")
    folded = _folded(_labelled(events.filter(human()), real_session().alias("session_id")))
    return _per_visitor(folded.withColumn("_spread", spread).join(bounced, ["session_id", "_spread"], "left"))


def _per_visitor(folded: DataFrame) -> DataFrame:
    """Numbers of each value and visitor, with the sessions counted."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("dim_value")) for d in DIMENSIONS])
    stacked = folded.select(
        "day", "site_id", "visitor_id", "session_id", "bounced", "pageviews", "engaged_ms",
        F.explode(pairs).alias("p"),
    ).select("*", "p.dim", "p.dim_value")
    per_session = stacked.groupBy(*VALUE, "visitor_id", "session_id").agg(
        F.sum("pageviews").alias("pageviews"),
        F.sum("engaged_ms").alias("engaged_ms"),
        F.max("bounced").alias("bounced"),
    )
    return per_session.groupBy(*VALUE, "visitor_id").agg(
        F.sum("pageviews").alias("pageviews"),
        F.count("session_id").alias("sessions"),
        F.count_if(F.col("bounced")).alias("bounces"),
        F.sum("engaged_ms").alias("engaged_ms"),
    )


def _per_value(visitors: DataFrame) -> DataFrame:
    return visitors.groupBy(*VALUE).agg(
        F.sum("pageviews").alias("pageviews"),
        F.count("visitor_id").alias("visitors"),
        F.sum("sessions").alias("sessions"),
        F.sum("bounces").alias("bounces"),
        F.round(F.sum("engaged_ms")).cast("long").alias("engaged_ms"),
    )


def fold_tail(values: DataFrame, top: int = 100, across_sites: bool = False) -> DataFrame:
    """The ``top`` values per day, site and dimension; the rest summed as ``(other)``.

    Leading values are found with a limited window (each task drops what cannot rank), and the
    tail is the group total minus them, so no task ever sorts all values of a busy dimension.
    """
    group = ["day", "dim"] if across_sites else ["day", "site_id", "dim"]
    order = [F.col("pageviews").desc(), F.col("dim_value"), *([F.col("site_id")] if across_sites else [])]
    leading = (
        values.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
        .filter(F.col("rank") <= max(top, 1))
        .drop("rank")
    )
    whole = ["day", "site_id", "dim"]
    signed = values.select(*whole, *MEASURES, F.lit(1).alias("n")).unionByName(
        leading.select(*whole, *[(-F.col(m)).alias(m) for m in MEASURES], F.lit(-1).alias("n"))
    )
    rest = (
        signed.groupBy(*whole)
        .agg(*[F.sum(m).alias(m) for m in MEASURES], F.sum("n").alias("n"))
        .filter(F.col("n") > 0)
        .select(*whole, F.lit(OTHER).alias("dim_value"), *MEASURES)
    )
    return leading.select(*whole, "dim_value", *MEASURES).unionByName(rest)


def web_rollup_daily(events: DataFrame, sessions: DataFrame, top: int = 100, across_sites: bool = False) -> DataFrame:
    return fold_tail(daily_values(events, sessions), top, across_sites)
