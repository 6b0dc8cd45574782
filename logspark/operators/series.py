"""Shaping of time series for display: gaps, comparisons, shares."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Fixed value: bucket widths in seconds.
STEP_SECONDS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}


def zero_fill(
    series: DataFrame, start: datetime, end: datetime, width: str, keys: tuple[str, ...] = (),
    value: str = "value",
) -> DataFrame:
    """Every bucket from ``start`` to before ``end``, with 0 where the series has none."""
    step = STEP_SECONDS[width]
    first = F.timestamp_seconds(F.floor(F.unix_seconds(F.lit(start)) / step) * step)
    last = F.lit(end - timedelta(microseconds=1))
    buckets = F.explode(F.sequence(first, last, F.expr(f"INTERVAL {step} SECONDS"))).alias("bucket")
    if keys:
        frame = series.select(*keys).distinct().select(*keys, buckets)
    else:
        frame = series.sparkSession.range(1).select(buckets)
    return frame.join(series, [*keys, "bucket"], "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(0).cast(series.schema[value].dataType))
    )


def previous_range(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    return start - (end - start), start


def compare_previous(current: DataFrame, previous: DataFrame, measures: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Current and previous values of each measure with the difference and percent change.

    Percent change is NULL when there was nothing before.
    """
    both = current.select(*keys, F.lit(1).alias("_p"), *measures).unionByName(
        previous.select(*keys, F.lit(0).alias("_p"), *measures)
    )

    def side(name: str, which: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_p") == which, F.col(name))), F.lit(0))

    rows = both.groupBy(*keys).agg(
        *[side(m, w).alias(f"{m}{suffix}") for m in measures for w, suffix in ((1, ""), (0, "_prev"))]
    )
    out = {}
    for m in measures:
        delta = F.col(m) - F.col(f"{m}_prev")
        out[f"{m}_delta"] = delta
        out[f"{m}_change_pct"] = F.try_divide(delta.cast("double") * 100, F.col(f"{m}_prev"))
    return rows.withColumns(out)


def shift_series(series: DataFrame, by: timedelta) -> DataFrame:
    """A previous period's series moved onto the current axis."""
    seconds = int(by.total_seconds())
    return series.withColumn("bucket", F.col("bucket") + F.expr(f"INTERVAL {seconds} SECONDS"))


def share_percent(rows: DataFrame, value: str, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Whole percentages that add up to 100: floors plus one for the largest remainders.

    ``rows`` is a short list such as a breakdown. ``order`` settles equal remainders.
    """
    group = W.partitionBy(*keys)
    exact = F.try_divide(F.col(value).cast("double"), F.sum(F.col(value)).over(group)) * 100
    sized = rows.withColumn("_exact", F.coalesce(exact, F.lit(0.0))).withColumn("_floor", F.floor("_exact"))
    by_rest = group.orderBy((F.col("_exact") - F.col("_floor")).desc(), *order)
    ranked = sized.withColumns(
        {
            "_left": F.when(F.sum("_exact").over(group) > 0, 100 - F.sum("_floor").over(group)).otherwise(0),
            "_nth": F.row_number().over(by_rest),
        }
    )
    bonus = F.when(F.col("_nth") <= F.col("_left"), 1).otherwise(0)
    return ranked.withColumn("percent", (F.col("_floor") + bonus).cast("long")).drop(
        "_exact", "_floor", "_left", "_nth"
    )
