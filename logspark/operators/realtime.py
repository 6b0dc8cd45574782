"""Exact visitors of the last minutes, for every minute, without copying events per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from logspark.operators.web_reports import human

WIDTH = 5


def visitor_minutes(events: DataFrame) -> DataFrame:
    """One row per (site, visitor, minute) with its events."""
    return (
        events.filter(human())
        .groupBy("site_id", "visitor_id", F.date_trunc("minute", "ts").alias("minute"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sliding_visitors(minutes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(as_of, site_id, visitors, events): the ``width`` minutes before every minute ``as_of`` that has events in them.

    An event in minute m counts from m + 1 to m + width. A visitor's minutes no further apart than
    the width make one span, so a span adds 1 where it begins and takes 1 away behind its end; running
    sums over the changes of a site (at most two a minute) give the numbers. ``minutes`` as from
    ``visitor_minutes``; several rows of one minute are added up.
    """
    by_time = W.partitionBy("site_id", "visitor_id").orderBy("m")
    at = (F.unix_seconds("minute") / 60).cast("long")
    rows = minutes.groupBy("site_id", "visitor_id", at.alias("m")).agg(F.sum("n").alias("n"))
    before, after = F.lag("m").over(by_time), F.lead("m").over(by_time)
    known = F.col("visitor_id").isNotNull()
    rows = rows.withColumns({
        "_opens": F.when(known & (before.isNull() | (F.col("m") - before > width)), 1).otherwise(0),
        "_closes": F.when(known & (after.isNull() | (after - F.col("m") > width)), 1).otherwise(0),
    })
    changes = F.array(
        F.struct((F.col("m") + 1).alias("at"), F.col("_opens").alias("v"), F.col("n").alias("e")),
        F.struct((F.col("m") + 1 + width).alias("at"), (-F.col("_closes")).alias("v"), (-F.col("n")).alias("e")),
    )
    sums = rows.select("site_id", F.inline(changes)).groupBy("site_id", "at").agg(F.sum("v").alias("v"), F.sum("e").alias("e"))
    order = W.partitionBy("site_id").orderBy("at")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    steps = sums.select(
        "site_id", "at", F.lead("at").over(order).alias("until"),
        F.sum("v").over(running).alias("visitors"), F.sum("e").over(running).alias("events"),
    ).filter("events > 0")
    as_of = F.explode(F.sequence(F.col("at"), F.col("until") - 1))
    return steps.select(as_of.alias("m"), "site_id", "visitors", "events").select(F.timestamp_seconds(F.col("m") * 60).alias("as_of"), "site_id", "visitors", "events")
