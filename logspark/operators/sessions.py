"""Visits: cutting events into sessions, restitching late events, repairing old rows.

Cutting needs no sort of a visitor's events. Two events of one visitor that fall into the same
slot of ``gap + 1`` seconds are never further apart than the gap, so only a slot's first event
can open a session. Events are therefore folded into one row per (site, visitor, slot) with
map-side aggregation; the gap test then runs over slots, of which a visitor has at most one per
half hour no matter how many events there are.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logspark.functions.hashing import session_key
from logspark.functions.timestamps import ms_between
from logspark.functions.web import BROWSERS, DEVICES, SYSTEMS
from logspark.plans.skew import HOT_ROWS, salted_join

GAP_SECONDS = 30 * 60
SETTLE_SECONDS = 30
VISITOR = ["site_id", "visitor_id"]
SLOT = [*VISITOR, "slot"]
INTERACTIONS = ["outbound", "download", "custom"]
FIRST_EVENT = ["user_id", "country", "region", "city", "device", "browser", "os"]
NO_SESSION = 0


def slot(gap_seconds: int) -> Column:
    return F.floor(F.unix_seconds("ts") / (gap_seconds + 1))


def eligible(events: DataFrame) -> DataFrame:
    """Human events with a visitor id."""
    return events.filter(~F.coalesce("is_bot", F.lit(False)) & (F.col("visitor_id") != 0))


def slots(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """One row per (site, visitor, slot) holding everything a session row needs.

    ``events`` needs a unique ``event_key`` to settle ties of (ts, insert_ts).
    """
    order = [F.col("ts"), F.col("insert_ts"), F.col("event_key")]
    is_view = F.col("event") == "pageview"

    def ordered(*payload: str, when: Column | None = None) -> Column:
        value = F.struct(*order, *payload)
        return value if when is None else F.when(when, value)

    has_path = F.col("path").isNotNull()
    return (
        eligible(events)
        .withColumn("slot", slot(gap_seconds))
        .groupBy(*SLOT)
        .agg(
            F.min(F.unix_seconds("ts")).alias("first_s"),
            F.max(F.unix_seconds("ts")).alias("last_s"),
            F.max("ts").alias("end_ts"),
            F.min(F.when(is_view, F.col("ts"))).alias("start_ts"),
            F.min(ordered(*FIRST_EVENT)).alias("first_event"),
            F.min(ordered("source", when=is_view & F.col("source").isNotNull())).alias("first_source"),
            F.min(ordered("medium", when=is_view & F.col("medium").isNotNull())).alias("first_medium"),
            F.min(ordered("path", when=has_path)).alias("first_path"),
            F.max(ordered("path", when=has_path)).alias("last_path"),
            F.min(F.coalesce("is_internal", F.lit(True))).alias("is_internal"),
            F.count_if(is_view).alias("pageviews"),
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("event").isin(INTERACTIONS)).alias("interactions"),
            F.sum(
                F.when(F.col("event") == "engagement", F.coalesce("value", F.lit(0.0))).otherwise(0.0)
            ).alias("engaged_ms"),
        )
    )


def numbered(slot_rows: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Slots with their visit number ``g``; a visit opens when the gap is exceeded."""
    by_time = W.partitionBy(*VISITOR).orderBy("slot")
    before = F.lag("last_s").over(by_time)
    opens = F.when(before.isNull() | (F.col("first_s") - before > gap_seconds), 1).otherwise(0)
    running = by_time.rowsBetween(W.unboundedPreceding, 0)
    return slot_rows.withColumn("is_new", opens).withColumn("g", F.sum("is_new").over(running)).drop("is_new")


def visits(numbered_slots: DataFrame, *more: Column) -> DataFrame:
    """Visits (site, visitor, g) folded from their slots, with and without page views; ``more`` aggregates may follow."""
    return numbered_slots.groupBy(*VISITOR, "g").agg(
        F.min("first_s").alias("first_s"),
        F.max("last_s").alias("last_s"),
        F.max("end_ts").alias("end_ts"),
        F.min("start_ts").alias("start_ts"),
        F.min("first_event").alias("first_event"),
        F.min("first_source").alias("first_source"),
        F.min("first_medium").alias("first_medium"),
        F.min("first_path").alias("first_path"),
        F.max("last_path").alias("last_path"),
        F.min("is_internal").alias("is_internal"),
        F.sum("pageviews").alias("pageviews"),
        F.sum("events").alias("events"),
        F.sum("interactions").alias("interactions"),
        F.sum("engaged_ms").alias("engaged_ms"),
        *more,
    )


def combine_visits(rows: DataFrame, gap_seconds: int = GAP_SECONDS, *more: Column) -> DataFrame:
    """Visits that lie within the gap of each other made one; the others stay as they are.

    New events never split a visit, they only lengthen or join some. So a visit's row, whose
    columns are all least, greatest or summed values, stands for its events, and old visits
    plus the visits cut from new events give the visits of all events.
    """
    by_start = W.partitionBy(*VISITOR).orderBy("first_s", "last_s")
    reach = F.max("last_s").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("first_s") - reach > gap_seconds), 1).otherwise(0)
    marked = rows.withColumn("is_new", opens)
    running = by_start.rowsBetween(W.unboundedPreceding, 0)
    return visits(marked.withColumn("g", F.sum("is_new").over(running)), *more)


def session_rows(visit_rows: DataFrame) -> DataFrame:
    """Session rows; visits without a page view are not sessions."""
    wall = ms_between(F.col("start_ts"), F.col("end_ts"))
    return visit_rows.filter(F.col("pageviews") >= 1).select(
        session_key(F.col("site_id"), F.col("visitor_id"), F.col("start_ts")).alias("session_id"),
        "site_id",
        "visitor_id",
        F.col("first_event.user_id").alias("user_id"),
        "is_internal",
        "start_ts",
        "end_ts",
        F.col("first_path.path").alias("entry_path"),
        F.col("last_path.path").alias("exit_path"),
        "pageviews",
        "events",
        F.least(F.round("engaged_ms").cast("long"), wall).alias("engaged_ms"),
        ((F.col("pageviews") == 1) & (F.col("interactions") == 0)).alias("is_bounce"),
        F.col("first_source.source").alias("source"),
        F.col("first_medium.medium").alias("medium"),
        *[F.col(f"first_event.{c}").alias(c) for c in FIRST_EVENT[1:]],
    )


def sessionize(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Session rows of all events given; see ``settled`` for the stragglers' margin."""
    return session_rows(visits(numbered(slots(events, gap_seconds), gap_seconds)))


def settled(events: DataFrame, now: datetime, settle_seconds: int = SETTLE_SECONDS) -> DataFrame:
    """Events old enough that late commits have arrived."""
    return events.filter(F.col("ts") < F.lit(now - timedelta(seconds=max(settle_seconds, 1))))


def slot_sessions(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """(site, visitor, slot, n, session_id): the session every slot belongs to, 0 for none."""
    rows = numbered(slots(events, gap_seconds), gap_seconds).select(
        *SLOT, "g", "start_ts", F.col("events").alias("n")
    )
    whole = W.partitionBy(*VISITOR, "g")
    start = F.min("start_ts").over(whole)
    return rows.select(
        *SLOT,
        "n",
        F.when(start.isNotNull(), session_key(F.col("site_id"), F.col("visitor_id"), start))
        .otherwise(F.lit(NO_SESSION).cast("long"))
        .alias("session_id"),
    )


def stamp_sessions(
    events: DataFrame, gap_seconds: int = GAP_SECONDS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Events with ``session_id``: the session's id, 0 outside sessions, NULL for bots.

    The slot table carries row counts, so a slot holding very many events is cut into slices
    by event key before the join instead of going to one task.
    """
    lookup = slot_sessions(events, gap_seconds)
    keyed = events.drop("session_id").withColumn(
        "slot",
        F.when(
            ~F.coalesce("is_bot", F.lit(False)) & (F.col("visitor_id") != 0), slot(gap_seconds)
        ),
    )
    return salted_join(keyed, lookup, SLOT, F.col("event_key"), "left", hot_rows=hot_rows).drop("slot")


def restitch(
    events: DataFrame, sessions: DataFrame, fresh: DataFrame, gap_seconds: int = GAP_SECONDS
) -> DataFrame:
    """Sessions after late events where only session rows were kept: touched visitors are cut again.

    ``visit_store`` keeps visits instead and needs no history. ``events`` is the whole history
    including ``fresh``. Running it twice changes nothing.
    Only slots are matched to the touched visitors, never raw events.
    """
    touched = eligible(fresh).select(*VISITOR).distinct()
    history = slots(events, gap_seconds).join(touched, VISITOR, "left_semi")
    recut = session_rows(visits(numbered(history, gap_seconds)))
    kept = sessions.join(touched, VISITOR, "left_anti")
    return kept.select(*recut.columns).unionByName(recut)


def repair_sessions(
    sessions: DataFrame, stamped: DataFrame, now: datetime, days: int = 7
) -> DataFrame:
    """Old session rows brought in line with today's rules.

    Missing entry and exit paths come from the events, rotated geo/device columns are turned
    back, and rows of the last ``days`` days get fresh bounce flags and capped engagement;
    recent rows without a page view go away.
    """
    order = [F.col("ts"), F.col("insert_ts"), F.col("event_key")]
    path = F.when(F.coalesce("path", F.lit("")) != "", F.struct(*order, "path"))
    facts = (
        stamped.filter(F.col("session_id").isNotNull() & (F.col("session_id") != NO_SESSION))
        .groupBy("session_id")
        .agg(
            F.min(path).alias("_first"),
            F.max(path).alias("_last"),
            F.max(F.col("event").isin(INTERACTIONS)).alias("_acted"),
        )
    )
    joined = sessions.join(facts, "session_id", "left")
    broken = F.col("entry_path").isNull() | F.col("exit_path").isNull()
    paths = joined.withColumns(
        {
            "entry_path": F.when(broken, F.col("_first.path")).otherwise(F.col("entry_path")),
            "exit_path": F.when(broken, F.col("_last.path")).otherwise(F.col("exit_path")),
        }
    )
    browsers = [name for name, _ in BROWSERS]
    systems = [name for name, _ in SYSTEMS]

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    rotated = (
        ~text("device").isin([*DEVICES, ""])
        | ~text("browser").isin([*browsers, ""])
        | ~text("os").isin([*systems, ""])
        | text("region").isin([b for b in browsers if b != "IE"])
        | text("city").isin(systems)
    )
    turned = {"device": "os", "browser": "region", "os": "city", "region": "device", "city": "browser"}
    turned_rows = paths.withColumn("_rotated", rotated)
    turned_rows = turned_rows.withColumns(
        {
            name: F.when(F.col("_rotated"), F.col(source)).otherwise(F.col(name))
            for name, source in turned.items()
        }
    )
    recent = F.col("start_ts") >= F.lit(now - timedelta(days=days))
    wall = ms_between(F.col("start_ts"), F.col("end_ts"))
    bounce = (F.col("pageviews") == 1) & ~F.coalesce("_acted", F.lit(False))
    return (
        turned_rows.filter(~(recent & (F.col("pageviews") < 1)))
        .withColumns(
            {
                "is_bounce": F.when(recent, bounce).otherwise(F.col("is_bounce")),
                "engaged_ms": F.when(recent, F.least("engaged_ms", wall)).otherwise(F.col("engaged_ms")),
            }
        )
        .select(*sessions.columns)
    )
