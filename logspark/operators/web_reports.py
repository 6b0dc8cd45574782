"""Web-traffic reports over events (with session ids) and sessions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logspark.functions.text import clean_label, glob_like
from logspark.functions.timestamps import bucket
from logspark.plans.ranges import first_rows, in_log_range, in_web_range, web_width
from logspark.plans.skew import HOT_ROWS, copy_to_slices, hot_keys, slice_rows, splits_of

CHIPS = ["path", "country", "region", "city", "device", "browser", "os", "source", "medium"]
# Good and poor limits per vital.
VITAL_LIMITS = {"LCP": (2500.0, 4000.0), "INP": (200.0, 500.0), "CLS": (0.1, 0.25)}
GOOD = {name: good for name, (good, _) in VITAL_LIMITS.items()}
VITAL_ORDER = ["LCP", "INP", "CLS"]
MIN_STEPS, MAX_STEPS = 2, 8


# -- filters ---------------------------------------------------------------


def internal_ok(include_internal: bool) -> Column:
    return F.lit(True) if include_internal else ~F.coalesce("is_internal", F.lit(False))


def chip_filter(chips: dict[str, str] | None) -> Column:
    """Exact matches on the nine filterable dimensions, all of which must hold."""
    keep = F.lit(True)
    for name in CHIPS:
        value = (chips or {}).get(name, "").strip()
        if value:
            keep = keep & (F.col(name) == value)
    return keep


def human(exclude_bots: bool = True) -> Column:
    return ~F.coalesce("is_bot", F.lit(False)) if exclude_bots else F.lit(True)


def events_in(
    events: DataFrame, start: datetime, end: datetime, *, site: str | None = None,
    chips: dict[str, str] | None = None, include_internal: bool = False, exclude_bots: bool = True,
) -> DataFrame:
    rows = events.filter(
        in_web_range(F.col("ts"), start, end) & human(exclude_bots) & internal_ok(include_internal)
        & chip_filter(chips)
    )
    return rows if site is None else rows.filter(F.col("site_id") == site)


def touched_sessions(
    events: DataFrame, start: datetime, end: datetime, chips: dict[str, str],
    include_internal: bool = False,
) -> DataFrame:
    """Ids of sessions with a matching event in range."""
    return (
        events.filter(in_web_range(F.col("ts"), start, end) & internal_ok(include_internal) & chip_filter(chips))
        .filter(F.col("session_id").isNotNull())
        .select("session_id")
        .distinct()
    )


def sessions_in(
    sessions: DataFrame, start: datetime, end: datetime, *, events: DataFrame | None = None,
    site: str | None = None, chips: dict[str, str] | None = None, include_internal: bool = False,
) -> DataFrame:
    """Sessions with a page view that start in range; chips need the stamped events."""
    rows = sessions.filter(
        (F.col("pageviews") >= 1)
        & in_web_range(F.col("start_ts"), start, end)
        & internal_ok(include_internal)
    )
    if site is not None:
        rows = rows.filter(F.col("site_id") == site)
    if chips:
        ids = touched_sessions(events, start, end, chips, include_internal)
        rows = rows.join(ids, "session_id", "left_semi")
    return rows


def real_session() -> Column:
    """The session id, or NULL for events outside any session."""
    return F.nullif(F.col("session_id"), F.lit(0).cast("long"))


def views() -> Column:
    return F.count_if(F.col("event") == "pageview")


def mean_flag(flag: Column) -> Column:
    return F.avg(F.when(flag, 1.0).otherwise(0.0))


# -- time series -----------------------------------------------------------

EVENT_METRICS = {
    "pageviews": views,
    "events": lambda: F.count(F.lit(1)),
    "visitors": lambda: F.countDistinct("visitor_id"),
    "sessions": lambda: F.countDistinct(real_session()),
}
SESSION_METRICS = {
    "bounce_rate": lambda: F.coalesce(mean_flag(F.col("is_bounce")), F.lit(0.0)),
    "avg_duration": lambda: F.coalesce(F.avg("engaged_ms"), F.lit(0.0)),
}


def web_stats(
    metric: str, start: datetime, end: datetime, *, events: DataFrame, sessions: DataFrame | None = None,
    interval: str | None = None, **scope,
) -> DataFrame:
    """One value per bucket: event metrics by event time, session metrics by session start."""
    width = web_width(start, end, interval)
    if metric in EVENT_METRICS:
        rows, when, value = events_in(events, start, end, **scope), "ts", EVENT_METRICS[metric]()
    elif metric in SESSION_METRICS:
        rows = sessions_in(sessions, start, end, events=events, **scope)
        when, value = "start_ts", F.round(SESSION_METRICS[metric](), 4)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return (
        rows.groupBy(bucket(F.col(when), width).alias("bucket"))
        .agg(value.cast("double").alias("value"))
        .orderBy("bucket")
    )


# -- breakdowns ------------------------------------------------------------


def _utm(key: str) -> Column:
    return clean_label(F.col("utm")[key], "(none)")


EVENT_DIMENSIONS = {
    "path": lambda: F.col("path"),
    "event": lambda: F.col("event"),
    "source": lambda: clean_label(F.col("source"), "direct"),
    "medium": lambda: clean_label(F.col("medium"), "none"),
    "country": lambda: clean_label(F.col("country"), "unknown"),
    "region": lambda: clean_label(F.col("region"), "unknown"),
    "city": lambda: clean_label(F.col("city"), "unknown"),
    "screen": lambda: F.coalesce(F.col("screen_w").cast("string"), F.lit("unknown")),
    "utm_source": lambda: _utm("source"),
    "utm_medium": lambda: _utm("medium"),
    "utm_campaign": lambda: _utm("campaign"),
    "device": lambda: clean_label(F.col("device"), "unknown"),
    "browser": lambda: clean_label(F.col("browser"), "unknown"),
    "os": lambda: clean_label(F.col("os"), "unknown"),
}
SESSION_DIMENSIONS = {"entry_page": "entry_path", "exit_page": "exit_path"}


def _top_by(rows: DataFrame, value: Column, pageviews: Column, session: Column, limit: int) -> DataFrame:
    return (
        rows.groupBy(F.coalesce(value, F.lit("(none)")).alias("dim_value"))
        .agg(
            pageviews.alias("pageviews"),
            F.countDistinct("visitor_id").alias("visitors"),
            F.countDistinct(session).alias("sessions"),
        )
        .orderBy(F.col("pageviews").desc(), "dim_value")
        .transform(first_rows, limit)
    )


def breakdown(
    by: str, start: datetime, end: datetime, *, events: DataFrame, sessions: DataFrame | None = None,
    limit: int = 10, **scope,
) -> DataFrame:
    """Page views, visitors and sessions of the leading values of one of 16 dimensions."""
    if by in EVENT_DIMENSIONS:
        rows = events_in(events, start, end, **scope)
        return _top_by(rows, EVENT_DIMENSIONS[by](), views(), real_session(), limit)
    if by in SESSION_DIMENSIONS:
        rows = sessions_in(sessions, start, end, events=events, **scope)
        value = F.col(SESSION_DIMENSIONS[by])
        return _top_by(rows, value, F.sum("pageviews"), F.col("session_id"), limit)
    raise ValueError(f"unknown dimension {by!r}")


def top_values(by: str, start: datetime, end: datetime, events: DataFrame, site: str | None = None, limit: int = 10) -> DataFrame:
    """As ``breakdown`` over events, with a closed range and internal visits included."""
    if by not in EVENT_DIMENSIONS:
        raise ValueError(f"unknown dimension {by!r}")
    rows = events.filter(in_log_range(F.col("ts"), start, end) & human())
    if site is not None:
        rows = rows.filter(F.col("site_id") == site)
    return _top_by(rows, EVENT_DIMENSIONS[by](), views(), real_session(), limit)


def realtime(events: DataFrame, now: datetime, minutes: int = 5, limit: int = 10, **scope) -> DataFrame:
    """Visitors of the last minutes and their leading pages, as (kind, value, hits) rows."""
    after = now - timedelta(minutes=minutes)
    rows = events_in(events, after, now + timedelta(microseconds=1), **scope)
    visitors = rows.agg(F.countDistinct("visitor_id").alias("hits")).select(
        F.lit("visitors").alias("kind"), F.lit(None).cast("string").alias("value"), "hits"
    )
    pages = (
        rows.filter(F.col("event") == "pageview")
        .groupBy(F.coalesce("path", F.lit("(none)")).alias("value"))
        .agg(F.count(F.lit(1)).alias("hits"))
        .orderBy(F.col("hits").desc(), "value")
        .transform(first_rows, limit)
        .select(F.lit("page").alias("kind"), "value", "hits")
    )
    return visitors.unionByName(pages)


# -- vitals and errors -----------------------------------------------------


def is_good(name: Column, value: Column) -> Column:
    good = F.lit(False)
    for metric, most in GOOD.items():
        good = good | ((name == metric) & (value <= most))
    return good


def vitals(
    events: DataFrame, start: datetime, end: datetime, *, path: str | None = None,
    exact: bool = False, exclude_bots: bool = False, **scope,
) -> DataFrame:
    """p75, sample count and share of good samples per metric, path and device."""
    chips = {"path": path} if path else None
    rows = events_in(events, start, end, chips=chips, exclude_bots=exclude_bots, **scope).filter(
        F.col("event") == "vital"
    )
    p75 = F.percentile("value", 0.75) if exact else F.percentile_approx("value", 0.75, 10_000)
    return (
        rows.groupBy(
            F.col("name").alias("metric"),
            F.coalesce("path", F.lit("(none)")).alias("path"),
            clean_label(F.col("device"), "unknown").alias("device"),
        )
        .agg(
            p75.alias("p75"),
            F.count(F.lit(1)).alias("samples"),
            mean_flag(is_good(F.col("name"), F.col("value"))).alias("good_pct"),
        )
        .orderBy("metric", "p75", "path", "device")
    )


def vital_word(metric: Column, p75: Column) -> Column:
    word = F.when(F.lit(False), "")
    for name, (good, poor) in VITAL_LIMITS.items():
        here = metric == name
        word = word.when(here & (p75 <= good), "Good").when(here & (p75 <= poor), "Needs work").when(here, "Poor")
    return word.otherwise("Good")


def vitals_overall(rows: DataFrame, top: int = 5) -> DataFrame:
    """Sample-weighted view of ``vitals``: overall, the busiest paths, and per device.

    Columns: scope (overall, path, device), metric, label, p75, good_pct, samples, status.
    """
    weight = F.sum("samples")

    def weighted(name: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(name) * F.col("samples")), weight), F.lit(0.0)).alias(name)

    overall = rows.groupBy("metric").agg(weighted("p75"), weighted("good_pct"), weight.alias("samples")).select(
        F.lit("overall").alias("scope"), "metric", F.lit(None).cast("string").alias("label"),
        "p75", "good_pct", "samples",
    )
    device = rows.groupBy("metric", "device").agg(weighted("p75"), weighted("good_pct"), weight.alias("samples")).select(
        F.lit("device").alias("scope"), "metric", F.col("device").alias("label"), "p75", "good_pct", "samples",
    )
    busiest = W.partitionBy("metric").orderBy(F.col("samples").desc(), "path", "device")
    paths = (
        rows.filter(F.col("path") != "(none)")
        .withColumn("rank", F.row_number().over(busiest))
        .filter(F.col("rank") <= top)
        .select(F.lit("path").alias("scope"), "metric", F.col("path").alias("label"), "p75", "good_pct", "samples")
    )
    return (
        overall.unionByName(paths).unionByName(device)
        .withColumn("status", vital_word(F.col("metric"), F.col("p75")))
    )


def web_errors(events: DataFrame, start: datetime, end: datetime, limit: int = 50, exclude_bots: bool = False, **scope) -> DataFrame:
    rows = events_in(events, start, end, exclude_bots=exclude_bots, **scope).filter(F.col("event") == "error")
    return (
        rows.groupBy(
            F.coalesce("name", F.lit("(unknown)")).alias("name"),
            F.coalesce("path", F.lit("(none)")).alias("path"),
        )
        .agg(F.count(F.lit(1)).alias("hits"), F.max("ts").alias("last_seen"))
        .orderBy(F.col("hits").desc(), F.col("last_seen").desc(), "name", "path")
        .transform(first_rows, limit)
    )


# -- sources, pages, links, custom events ----------------------------------


def _with_daily(totals: DataFrame, rows: DataFrame, day: Column, label: Column, key: str, count: Column) -> DataFrame:
    """Adds ``daily``, an array of (day, n) per leading label.

    Only days of labels that made the list are collected, one entry per day.
    """
    daily = (
        rows.groupBy(label.alias(key), day.alias("day"))
        .agg(count.alias("n"))
        .join(totals.select(key), key, "left_semi")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("daily"))
    )
    return totals.join(daily, key)


def _session_list(rows: DataFrame, label: Column, key: str, limit: int) -> DataFrame:
    return (
        rows.groupBy(label.alias(key))
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.countDistinct("visitor_id").alias("visitors"),
            F.round(mean_flag(F.col("is_bounce")), 4).alias("bounce_rate"),
        )
        .orderBy(F.col("sessions").desc(), key)
        .transform(first_rows, limit)
    )


def sources(sessions: DataFrame, start: datetime, end: datetime, *, events: DataFrame | None = None, limit: int = 20, **scope) -> DataFrame:
    """Sessions, visitors and bounce rate per medium with the daily series."""
    rows = sessions_in(sessions, start, end, events=events, **scope)
    label = clean_label(F.col("medium"), "direct")
    totals = _session_list(rows, label, "medium", limit)
    return _with_daily(totals, rows, F.to_date("start_ts"), label, "medium", F.count(F.lit(1)))


def pages(events: DataFrame, sessions: DataFrame, start: datetime, end: datetime, limit: int = 10, **scope) -> DataFrame:
    """Entry, top and exit pages with their daily series, told apart by ``kind``."""
    visit_rows = sessions_in(sessions, start, end, events=events, **scope)
    view_rows = events_in(events, start, end, **scope).filter(F.col("event") == "pageview")
    empty = F.lit(None)

    def visit_list(kind: str, column: str) -> DataFrame:
        label = clean_label(F.col(column), "(none)")
        totals = _session_list(visit_rows, label, "page", limit)
        return _with_daily(
            totals, visit_rows, F.to_date("start_ts"), label, "page", F.count(F.lit(1))
        ).select(
            F.lit(kind).alias("kind"), "page", "sessions", "visitors", "bounce_rate",
            empty.cast("long").alias("pageviews"), "daily",
        )

    label = clean_label(F.col("path"), "(none)")
    totals = (
        view_rows.groupBy(label.alias("page"))
        .agg(F.count(F.lit(1)).alias("pageviews"), F.countDistinct(real_session()).alias("sessions"))
        .orderBy(F.col("pageviews").desc(), "page")
        .transform(first_rows, limit)
    )
    top = _with_daily(totals, view_rows, F.to_date("ts"), label, "page", F.count(F.lit(1))).select(
        F.lit("top").alias("kind"), "page", "sessions", empty.cast("long").alias("visitors"),
        empty.cast("double").alias("bounce_rate"), "pageviews", "daily",
    )
    return visit_list("entry", "entry_path").unionByName(top).unionByName(visit_list("exit", "exit_path"))


def links(events: DataFrame, kind: str, start: datetime, end: datetime, limit: int = 20, **scope) -> DataFrame:
    """Outbound destinations or downloads by hits."""
    if kind not in ("outbound", "download"):
        raise ValueError("kind must be outbound or download")
    rows = events_in(events, start, end, **scope).filter(F.col("event") == kind)
    if kind == "outbound":
        host = clean_label(F.col("name"), "(unknown)")
        path = clean_label(F.col("path"), "/")
    else:
        host = F.lit(None).cast("string")
        path = clean_label(F.col("path"), "(unknown)")
    return (
        rows.select(host.alias("host"), path.alias("path"))
        .groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("hits"))
        .orderBy(F.col("hits").desc(), "host", "path")
        .transform(first_rows, limit)
    )


def custom_events(events: DataFrame, start: datetime, end: datetime, limit: int = 50, **scope) -> DataFrame:
    rows = events_in(events, start, end, **scope).filter((F.col("event") == "custom") & (F.col("name") != ""))
    return (
        rows.groupBy("name")
        .agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("visitor_id").alias("visitors"))
        .orderBy(F.col("hits").desc(), "name")
        .transform(first_rows, limit)
    )


# -- funnel ----------------------------------------------------------------


def step_matches(step: str) -> Column:
    """``event:<name>``, ``outbound:<host glob>`` or a path glob."""
    if step.startswith("event:"):
        return (F.col("event") == "custom") & F.col("name").like(glob_like(step.removeprefix("event:")))
    if step.startswith("outbound:"):
        return (F.col("event") == "outbound") & F.col("name").like(glob_like(step.removeprefix("outbound:")))
    return F.col("path").like(glob_like(step))


def funnel(
    events: DataFrame, steps: list[str], start: datetime, end: datetime, hot_rows: int = HOT_ROWS, **scope
) -> DataFrame:
    """Sessions reaching each step, every match strictly after the one before.

    Matching events are folded to one row per (session, instant) with a bit mask of the steps
    they match and shuffled once by session; every step joins that same exchange with one row
    per session (its level and the time it was reached) and takes a minimum, which combines
    before it is shuffled. A session with very many instants is cut into slices, and its one
    row is copied per slice. No cap on the sessions of step one is needed.
    """
    if not MIN_STEPS <= len(steps) <= MAX_STEPS:
        raise ValueError(f"a funnel has {MIN_STEPS} to {MAX_STEPS} steps")
    mask = F.lit(0)
    for i, step in enumerate(steps):
        mask = mask.bitwiseOR(F.when(step_matches(step), F.lit(1 << i)).otherwise(F.lit(0)))
    hits = (
        events_in(events, start, end, **scope)
        .select(real_session().alias("session_id"), "ts", mask.alias("mask"))
        .filter(F.col("session_id").isNotNull() & (F.col("mask") > 0))
        .groupBy("session_id", "ts")
        .agg(F.bit_or("mask").alias("mask"))
    )
    first = F.col("mask").bitwiseAND(F.lit(1)) > 0
    entered = (
        hits.groupBy("session_id")
        .agg(F.min(F.when(first, F.col("ts"))).alias("t"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("t").isNotNull())
    )
    hot = hot_keys(entered.select("session_id", "n"), ["session_id"], hot_rows)
    sliced = slice_rows(hits, hot, ["session_id"], F.col("ts"))
    splits = splits_of(F.col("n"), hot_rows)
    reached = entered.select("session_id", F.lit(1).alias("level"), "t", splits.alias("splits"))
    for i in range(1, len(steps)):
        here = (
            (F.col("level") == i)
            & (F.col("mask").bitwiseAND(F.lit(1 << i)) > 0)
            & (F.col("ts") > F.col("t"))
        )
        reached = (
            copy_to_slices(reached, F.col("splits"))
            .join(sliced, ["session_id", "_slice"], "left")
            .groupBy("session_id")
            .agg(
                F.max("level").alias("level"),
                F.max("t").alias("t"),
                F.max("splits").alias("splits"),
                F.min(F.when(here, F.col("ts"))).alias("next"),
            )
            .select(
                "session_id",
                F.when(F.col("next").isNotNull(), i + 1).otherwise(F.col("level")).alias("level"),
                F.coalesce("next", "t").alias("t"),
                "splits",
            )
        )
    tally = reached.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    one = tally.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("level") >= i + 1, F.col("n"))), F.lit(0)).alias(f"s{i + 1}")
            for i in range(len(steps))
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"), F.lit(step).alias("pattern"),
                F.col(f"s{i + 1}").alias("sessions"), F.col(f"s{max(i, 1)}").alias("before"),
                F.col("s1").alias("first"),
            )
            for i, step in enumerate(steps)
        ]
    )

    def ratio(name: str) -> Column:
        part = F.try_divide(F.col("sessions").cast("double"), F.col(name))
        return F.coalesce(F.round(part, 4), F.lit(0.0))

    return (
        one.select(F.explode(rows).alias("r"))
        .select("r.*")
        .withColumn("conversion_from_prev", ratio("before"))
        .withColumn(
            "drop_off",
            F.when(F.col("first") == 0, 0.0).otherwise(F.round(1 - F.col("conversion_from_prev"), 4)),
        )
        .withColumn("overall_conversion", ratio("first"))
        .drop("before", "first")
    )


# -- summaries and lists ---------------------------------------------------


def web_summary(events: DataFrame, sessions: DataFrame, start: datetime, end: datetime, **scope) -> DataFrame:
    """One row of headline numbers; visitors are the sum of exact daily uniques."""
    per_day = (
        events_in(events, start, end, **scope)
        .groupBy(F.to_date("ts").alias("day"))
        .agg(views().alias("pageviews"), F.countDistinct("visitor_id").alias("visitors"))
    )
    visit = sessions_in(sessions, start, end, events=events, **scope).agg(
        F.struct(
            F.count(F.lit(1)).alias("sessions"),
            F.round(F.coalesce(mean_flag(F.col("is_bounce")), F.lit(0.0)), 4).alias("bounce_rate"),
            F.round(F.coalesce(F.avg("engaged_ms"), F.lit(0.0)), 3).alias("avg_duration_ms"),
        )
    )
    return (
        per_day.agg(
            F.coalesce(F.sum("pageviews"), F.lit(0)).alias("pageviews"),
            F.coalesce(F.sum("visitors"), F.lit(0)).alias("visitors"),
        )
        .withColumn("s", visit.scalar())
        .select("pageviews", "visitors", "s.*")
    )


SESSION_LIST = [
    "session_id", "start_ts", "end_ts", "entry_path", "exit_path", "pageviews", "events",
    "engaged_ms", "is_bounce", "source", "medium", "country", "region", "city", "device",
    "browser", "os",
]


def list_sessions(sessions: DataFrame, start: datetime, end: datetime, *, events: DataFrame | None = None, limit: int | None = None, **scope) -> DataFrame:
    rows = sessions_in(sessions, start, end, events=events, **scope)
    return (
        first_rows(rows.orderBy(F.col("start_ts").desc(), "session_id"), limit).select(*SESSION_LIST)
    )


def session_events(events: DataFrame, session_id: int, limit: int | None = None) -> DataFrame:
    keys = [c for c in ("event_key",) if c in events.columns]
    return (
        events.filter(F.col("session_id") == F.lit(session_id).cast("long"))
        .orderBy("ts", *keys)
        .transform(first_rows, limit)
        .select("ts", "event", "name", "path", "value", "source", "medium", "country", "city", "device", "trace_id")
    )


def site_totals(daily: DataFrame, sessions: DataFrame, start: datetime, end: datetime, site: str | None = None, dim: str = "device") -> DataFrame:
    """One row of totals from one dimension of the daily rollup, with the daily page views."""
    rows = daily.filter(
        (F.col("dim") == dim) & F.col("day").between(F.lit(start.date()), F.lit(end.date()))
    )
    visits = sessions.filter(in_log_range(F.col("start_ts"), start, end))
    if site is not None:
        rows, visits = rows.filter(F.col("site_id") == site), visits.filter(F.col("site_id") == site)
    per_day = rows.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("pageviews", "visitors", "sessions")])
    rates = visits.agg(
        F.struct(
            F.round(F.coalesce(mean_flag(F.col("is_bounce")), F.lit(0.0)), 4).alias("bounce_rate"),
            F.round(F.coalesce(F.avg("engaged_ms"), F.lit(0.0)), 3).alias("avg_engaged_ms"),
        )
    )
    return (
        per_day.agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pageviews", "visitors", "sessions")],
            F.array_sort(F.collect_list(F.struct("day", "pageviews"))).alias("daily"),
        )
        .withColumn("r", rates.scalar())
        .select("pageviews", "visitors", "sessions", "r.*", "daily")
    )
