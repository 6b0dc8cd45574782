"""Anomaly detection on the newest point of many series at once.

A series is rows of (keys, ts, value), already one row per time bucket and cut to the last few
buckets, so gathering one series into an array is bounded by its length in buckets.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logspark.plans.ranges import first_rows
from logspark.functions.levels import anomaly_severity
from logspark.operators.rollups import SITE_METRIC

POINTS = 120
MIN_POINTS = 5
DAY_MINUTES = 1440
#: Minutes a cycle looks at: two days, which the seasonal detector needs, and one more.
CYCLE_POINTS = 2 * DAY_MINUTES + 1
FLAT = 1e-9
NORMAL_QUARTILE = 0.6745


def latest_points(series: DataFrame, keys: list[str], points: int = POINTS) -> DataFrame:
    """The newest ``points`` buckets of every series."""
    newest = W.partitionBy(*keys).orderBy(F.col("ts").desc())
    return (
        series.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= points).drop("_nth")
    )


def median_of(values: Column) -> Column:
    s = F.array_sort(values)
    mid = (F.size(s) / 2).cast("int")
    even = F.size(s) % 2 == 0
    return F.when(even, (F.get(s, mid - 1) + F.get(s, mid)) / 2).otherwise(F.get(s, mid))


def upper_median_of(values: Column) -> Column:
    return F.get(F.array_sort(values), (F.size(values) / 2).cast("int"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def differences(values: Column) -> Column:
    n = F.size(values)
    return F.zip_with(F.slice(values, F.lit(2), n - 1), F.slice(values, F.lit(1), n - 1), lambda b, a: b - a)


def with_score(rows: DataFrame, values: str, name: str) -> DataFrame:
    """Modified z-score of the last element; mean and deviation stand in when the MAD is zero.

    Each statistic is its own column, so it is computed once per row and not once per element.
    """
    v, med, mean = F.col(values), F.col("_med"), F.col("_mean")
    last = F.element_at(v, -1)
    return (
        rows.withColumns({"_med": median_of(v), "_mean": _mean(v)})
        .withColumns(
            {
                "_dev": median_of(F.transform(v, lambda x: F.abs(x - med))),
                "_sd": F.sqrt(_mean(F.transform(v, lambda x: (x - mean) * (x - mean)))),
            }
        )
        .withColumn(
            name,
            F.when(F.col("_dev") >= FLAT, F.lit(NORMAL_QUARTILE) * (last - med) / F.col("_dev")).when(
                F.col("_sd") >= FLAT, (last - mean) / F.col("_sd")
            ),
        )
        .drop("_med", "_mean", "_dev", "_sd")
    )


def gather(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts of the newest point, values oldest first) with at least five points."""
    return (
        series.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("ts", F.col("value").cast("double").alias("value")))).alias("p"))
        .filter(F.size("p") >= MIN_POINTS)
        .select(
            *keys,
            F.element_at("p", -1)["ts"].alias("ts"),
            F.transform("p", lambda x: x["value"]).alias("values"),
        )
    )


def detect(series: DataFrame, keys: list[str], metric: Column, z: float = 3.0, drops: bool = False,
           period: int = DAY_MINUTES) -> DataFrame:
    """Rows (keys, ts, metric, score, method, severity) for every detector that fires.

    Detectors: MAD, rate of change, one-day season (needs two days of minutes), and with
    ``drops`` a fall under 30 % of the usual level.
    """
    rows = gather(series, keys).withColumn("steps", differences(F.col("values")))
    rows = with_score(with_score(rows, "values", "_mad"), "steps", "_rate")
    values, last = F.col("values"), F.element_at("values", -1)
    long_enough = F.size(values) >= 2 * period
    previous = F.get(values, F.size(values) - 1 - period)
    base = F.abs(previous - median_of(values))
    seasonal = F.when(
        long_enough & (base > FLAT) & (F.abs(last - previous) / base > 3.0), (last - previous) / base
    )

    def finding(score: Column, method: str, severity: Column, fires: Column) -> Column:
        found = F.struct(score.alias("score"), F.lit(method).alias("method"), severity.alias("severity"))
        return F.when(fires, found)

    found = [
        finding(F.col("_mad"), "mad", anomaly_severity(F.col("_mad")), F.abs("_mad") >= z),
        finding(F.col("_rate"), "rate_of_change", anomaly_severity(F.col("_rate")), F.abs("_rate") >= z),
        finding(seasonal, "seasonal", anomaly_severity(seasonal), seasonal.isNotNull()),
    ]
    if drops:
        usual = upper_median_of(F.slice(values, F.lit(1), F.size(values) - 1))
        score = F.when(usual > 0, (usual - last) / usual).otherwise(1.0)
        found.append(finding(score, "mad", F.lit("warning"), last < 0.3 * usual))
    return (
        rows.select(*keys, "ts", metric.alias("metric"), F.explode(F.array(*found)).alias("f"))
        .filter(F.col("f").isNotNull())
        .select(*keys, "ts", "metric", "f.score", "f.method", "f.severity")
    )


def total_volume(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy(F.col("bucket").alias("ts")).agg(F.sum("n").cast("double").alias("value"))


def anomaly_cycle(rollup: DataFrame, points: int = CYCLE_POINTS, z: float = 3.0) -> DataFrame:
    """All detectors on the newest minutes of total volume."""
    series = total_volume(rollup).orderBy(F.col("ts").desc()).limit(points)
    one = series.withColumn("_all", F.lit(0))
    return detect(one, ["_all"], F.lit("volume"), z).drop("_all")


def site_anomaly_cycle(web_rollup: DataFrame, points: int = CYCLE_POINTS, z: float = 3.0) -> DataFrame:
    """All detectors plus the drop warning on every site's page views."""
    series = web_rollup.groupBy("site_id", F.col("bucket").alias("ts")).agg(
        F.sum("pageviews").cast("double").alias("value")
    )
    metric = F.concat(F.lit(SITE_METRIC), F.col("site_id"))
    return detect(latest_points(series, ["site_id"], points), ["site_id"], metric, z, drops=True).drop("site_id")


def anomalies_on(volume: DataFrame, z: float = 3.0) -> DataFrame:
    """Detectors on a filtered volume series (bucket, n)."""
    series = volume.select(F.col("bucket").alias("ts"), F.col("n").alias("value"), F.lit(0).alias("_all"))
    return detect(series, ["_all"], F.lit("volume"), z).drop("_all")


def stored_anomalies(anomalies: DataFrame, start: datetime, end: datetime, limit: int | None = None) -> DataFrame:
    rows = anomalies.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)))
    return first_rows(rows.orderBy(F.col("ts").desc(), "metric", "method"), limit)
