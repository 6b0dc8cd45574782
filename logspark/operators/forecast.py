"""Forecasts of many series in parallel.

Every forecast is one Catalyst plan; ``forecast_smoothing`` fits exponential smoothing by a scan.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logspark.operators.anomaly import latest_points

MIN_POINTS = 4
DAY_SECONDS = 86_400


def check_request(horizon: int, level: float) -> None:
    if horizon < 1:
        raise ValueError("horizon must be > 0")
    if not 0.0 <= level <= 1.0:
        raise ValueError("level must be in [0, 1]")


def spread(level: float) -> float:
    """Half width of a central interval in standard deviations."""
    if level >= 1.0:
        return float("inf")
    return NormalDist().inv_cdf(0.5 + level / 2)


def seasonal_periods(points: int, interval_seconds: int) -> list[int]:
    """Daily and weekly periods covered at least twice by the series."""
    daily = DAY_SECONDS // max(interval_seconds, 1)
    if daily < 2 or points < 2 * daily:
        return []
    return [daily] + ([7 * daily] if points >= 14 * daily else [])


def _indexed(series: DataFrame, keys: list[str], points: int) -> DataFrame:
    oldest = W.partitionBy(*keys).orderBy("ts")
    return latest_points(series, keys, points).withColumn(
        "i", (F.row_number().over(oldest) - 1).cast("double")
    )


def _fit(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    n = F.count(F.lit(1))
    slope = F.coalesce(F.regr_slope(value, F.col("i")), F.lit(0.0))
    left = F.regr_syy(value, F.col("i")) - slope * F.regr_sxy(value, F.col("i"))
    return (
        rows.groupBy(*keys)
        .agg(
            n.alias("n"),
            F.max("ts").alias("last_ts"),
            slope.alias("slope"),
            F.avg(value).alias("mean"),
            F.sqrt(F.greatest(left, F.lit(0.0)) / F.greatest(n - 2, F.lit(1))).alias("sigma"),
        )
        .filter(F.col("n") >= MIN_POINTS)
        .withColumn("intercept", F.col("mean") - F.col("slope") * (F.col("n") - 1) / 2)
    )


def _project(fits: DataFrame, keys: list[str], horizon: int, interval_seconds: int) -> DataFrame:
    return fits.select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    ).withColumns(
        {
            "ts": F.col("last_ts") + F.make_interval(secs=F.col("h") * F.lit(max(interval_seconds, 1))),
            "trend": F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("h")),
        }
    )


def forecast_trend(
    series: DataFrame, keys: list[str], horizon: int, interval_seconds: int,
    level: float = 0.95, points: int = 120,
) -> DataFrame:
    """Straight-line forecast with bounds from the residuals: (keys, h, ts, predicted, lower, upper)."""
    check_request(horizon, level)
    fits = _fit(_indexed(series, keys, points), keys, F.col("value"))
    half = F.col("sigma") * F.lit(spread(level))
    return _project(fits, keys, horizon, interval_seconds).select(
        *keys, "h", "ts", F.col("trend").alias("predicted"),
        (F.col("trend") - half).alias("lower"), (F.col("trend") + half).alias("upper"),
    )


def forecast_seasonal(
    series: DataFrame, keys: list[str], horizon: int, interval_seconds: int, period: int,
    level: float = 0.95, points: int = 2880,
) -> DataFrame:
    """Line plus the mean deviation of each phase of ``period``.

    Series shorter than two periods give no rows; use ``forecast_trend`` for them.
    """
    check_request(horizon, level)
    rows = _indexed(series, keys, points)
    fits = _fit(rows, keys, F.col("value")).filter(F.col("n") >= 2 * period)
    phase = F.pmod(F.col("i"), F.lit(float(period))).cast("int").alias("phase")
    off = F.col("value") - (F.col("intercept") + F.col("slope") * F.col("i"))
    residuals = rows.join(fits.select(*keys, "intercept", "slope"), keys).select(
        *keys, phase, off.alias("off")
    )
    season = residuals.groupBy(*keys, "phase").agg(
        F.avg("off").alias("season"), F.count(F.lit(1)).alias("m"), F.var_pop("off").alias("v")
    )
    noise = season.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("noise")
    )
    out = (
        _project(fits, keys, horizon, interval_seconds)
        .withColumn("phase", F.pmod(F.col("n") - 1 + F.col("h"), F.lit(period)).cast("int"))
        .join(season.select(*keys, "phase", "season"), [*keys, "phase"])
        .join(noise, keys)
    )
    center = F.col("trend") + F.col("season")
    half = F.col("noise") * F.lit(spread(level))
    return out.select(
        *keys, "h", "ts", center.alias("predicted"), (center - half).alias("lower"), (center + half).alias("upper")
    )


# -- exponential smoothing -----------------------------------------------------
#
# With level l and slope s, a point y gives guess = l + s, e = y - guess, l' = guess + alpha e and
# s' = s + alpha beta e. That is an affine map, (l', s') = A (l, s) + y b, with A and b fixed by (alpha, beta).
# So the states of a series are a scan: the state after t points is the sum of A^(t - i) b y_i, which
# is gathered by doubling (each step adds what lies 2^j points back, times A^(2^j)) inside blocks of
# BLOCK points; the blocks' totals are scanned the same way, with A^BLOCK. No step runs point by point,
# no row or task holds a long series, and the pairs (alpha, beta) of the grid are the elements of arrays.

BLOCK = 64
#: (alpha, beta) tried, beta 0 being a level without slope.
GRID = [(round(0.05 + 0.1 * i, 2), beta) for i in range(10) for beta in (0.0, 0.05, 0.2, 0.5)]


def _step(alpha: float, beta: float) -> list[list[float]]:
    return [[1 - alpha, 1 - alpha], [-alpha * beta, 1 - alpha * beta]]


def _times(p: list[list[float]], q: list[list[float]]) -> list[list[float]]:
    return [[sum(p[i][k] * q[k][j] for k in (0, 1)) for j in (0, 1)] for i in (0, 1)]


def _power(p: list[list[float]], n: int) -> list[list[float]]:
    out = [[1.0, 0.0], [0.0, 1.0]]
    while n:
        if n & 1:
            out = _times(out, p)
        p, n = _times(p, p), n >> 1
    return out


def _moved(state: str, before: tuple[Column, Column], by: tuple[Column, Column]) -> Column:
    """Array ``state`` plus, pair by pair, a matrix line times an earlier level and slope; as it is where there is none."""
    sums = F.transform(F.col(state), lambda v, n: v + F.get(by[0], n) * F.get(before[0], n) + F.get(by[1], n) * F.get(before[1], n))
    return F.when(before[0].isNull(), F.col(state)).otherwise(sums)


def _scan(rows: DataFrame, keys: list[str], steps: list[list[list[float]]], levels: int) -> DataFrame:
    """Arrays l and s by ``i`` (0, 1, ...) replaced by their running sums, each step back times the pair's matrix."""
    place = [*keys, "_block"]
    rows = rows.withColumns({"_block": F.floor(F.col("i") / BLOCK).cast("long"), "_at": F.pmod(F.col("i"), F.lit(BLOCK)).cast("int")})
    by_index = W.partitionBy(*place).orderBy("i")
    back = 1
    while back < BLOCK:
        powers = [_power(step, back) for step in steps]
        line = [[F.lit([p[x][y] for p in powers]) for y in (0, 1)] for x in (0, 1)]
        rows = rows.withColumns({"_l": F.lag("l", back).over(by_index), "_s": F.lag("s", back).over(by_index)})
        before = (F.col("_l"), F.col("_s"))
        rows = rows.withColumns({"l": _moved("l", before, line[0]), "s": _moved("s", before, line[1])}).drop("_l", "_s")
        back *= 2
    if levels <= 1:
        return rows.drop("_block", "_at")
    totals = rows.filter(F.col("_at") == BLOCK - 1).select(*keys, F.col("_block").alias("i"), "l", "s")
    before = _scan(totals, keys, [_power(step, BLOCK) for step in steps], levels - 1)
    before = before.select(*keys, (F.col("i") + 1).alias("_block"), F.col("l").alias("_l"), F.col("s").alias("_s"))
    # A^(place in the block + 1) for every place: a table of BLOCK rows.
    powers = [[_power(step, at + 1) for step in steps] for at in range(BLOCK)]
    table = rows.sparkSession.createDataFrame(
        [(at, *[[p[x][y] for p in powers[at]] for x in (0, 1) for y in (0, 1)]) for at in range(BLOCK)],
        "_at int, _a array<double>, _b array<double>, _c array<double>, _d array<double>",
    )
    rows = rows.join(before, place, "left").join(F.broadcast(table), "_at")
    start = (F.col("_l"), F.col("_s"))
    rows = rows.withColumns({"l": _moved("l", start, (F.col("_a"), F.col("_b"))), "s": _moved("s", start, (F.col("_c"), F.col("_d")))})
    return rows.drop("_block", "_at", "_l", "_s", "_a", "_b", "_c", "_d")


def smooth_states(rows: DataFrame, keys: list[str], grid: list[tuple[float, float]], points: int) -> DataFrame:
    """``rows`` (keys, i from 0, y, ahead: the next y) with arrays l, s and e: level, slope and error after each point, by pair.

    Smoothing starts at the first point, with the first step as slope where beta > 0; the first point has no error.
    ``points`` is the length of the longest series.
    """
    levels = 1
    while BLOCK**levels < points:
        levels += 1
    first, step = F.col("i") == 0, F.coalesce(F.col("ahead") - F.col("y"), F.lit(0.0))
    gains, sloped = [F.lit([a for a, _ in grid]), F.lit([a * b for a, b in grid])], F.lit([float(b > 0) for _, b in grid])
    scaled = [F.transform(g, lambda v: v * F.col("y")) for g in gains]
    starts = [F.array_repeat("y", len(grid)), F.transform(sloped, lambda v: v * step)]
    rows = rows.withColumns({c: F.when(first, at).otherwise(then) for c, at, then in zip("ls", starts, scaled)})
    states = _scan(rows, keys, [_step(*pair) for pair in grid], levels)
    # l = (1 - alpha) guess + alpha y, so e = y - guess = (y - l) / (1 - alpha)
    return states.withColumn("e", F.when(~first, F.zip_with("l", gains[0], lambda l, a: (F.col("y") - l) / (1 - a))))


def deseasonalise(rows: DataFrame, keys: list[str], interval_seconds: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """``rows`` (keys, i, n, y) with the seasons taken off y, and (period, table of keys, phase, season).

    A daily season where the series covers two days, then a weekly one where it covers fourteen: mean
    deviations of each phase from the straight line of least squares.
    """
    daily, seasons = DAY_SECONDS // max(interval_seconds, 1), []
    for period, needed in ((daily, 2 * daily), (7 * daily, 14 * daily)):
        if daily < 2:
            break
        long_enough = F.col("n") >= needed
        fits = rows.filter(long_enough).groupBy(*keys).agg(
            F.regr_slope("y", "i").alias("_slope"), F.regr_intercept("y", "i").alias("_start")
        )
        phase = F.pmod(F.col("i"), F.lit(period)).alias("phase")
        off = F.col("y") - (F.col("_start") + F.col("_slope") * F.col("i"))
        season = rows.join(fits, keys).groupBy(*keys, phase).agg(F.avg(off).alias("season"))
        seasons.append((period, season))
        rows = rows.withColumn("phase", phase).join(season, [*keys, "phase"], "left")
        rows = rows.withColumn("y", F.col("y") - F.coalesce("season", F.lit(0.0))).drop("phase", "season")
    return rows, seasons


def forecast_smoothing(
    series: DataFrame, keys: list[str], horizon: int, interval_seconds: int,
    level: float = 0.95, points: int = 120, grid: list[tuple[float, float]] = GRID,
) -> DataFrame:
    """Exponential smoothing per series, with daily and weekly seasons where the series covers them twice.

    The pair of the grid with the least information criterion wins (the first of equals). Rows (keys,
    h, ts, predicted, lower, upper, model); series with fewer than four points give none.
    """
    check_request(horizon, level)
    names, keys = keys, [f"_key{j}" for j in range(len(keys))]  # no clash with working columns
    by_time = W.partitionBy(*keys).orderBy("ts")
    size = W.partitionBy(*keys)
    series = series.select(*[F.col(name).alias(k) for name, k in zip(names, keys)], "ts", F.col("value").cast("double").alias("y"))
    rows = latest_points(series, keys, points)
    rows = rows.select(*keys, "ts", "y", (F.row_number().over(by_time) - 1).alias("i"), F.count(F.lit(1)).over(size).alias("n"))
    rows, seasons = deseasonalise(rows.filter(F.col("n") >= MIN_POINTS), keys, interval_seconds)
    rows = rows.withColumn("ahead", F.lead("y").over(W.partitionBy(*keys).orderBy("i")))
    states = smooth_states(rows, keys, grid, points)
    each = F.posexplode(F.arrays_zip("l", "s", F.coalesce("e", F.array_repeat(F.lit(None).cast("double"), len(grid))).alias("e")))
    tried = states.select(*keys, "ts", "i", "n", each.alias("k", "at"))
    last = F.col("i") == F.col("n") - 1
    tried = tried.groupBy(*keys, "k").agg(
        F.first("n").alias("n"), F.max("ts").alias("last_ts"), F.avg(F.col("at.e") * F.col("at.e")).alias("q"),
        F.max(F.when(last, F.col("at.l"))).alias("level"), F.max(F.when(last, F.col("at.s"))).alias("slope"),
    )
    cost = F.get(F.lit([6 if beta > 0 else 2 for _, beta in grid]), F.col("k"))
    score = (F.col("n") - 1) * F.log(F.greatest(F.col("q"), F.lit(1e-12))) + cost
    pair = [F.get(F.lit([p[x] for p in grid]), F.col("k")).alias(name) for x, name in enumerate(("alpha", "beta"))]
    best = tried.groupBy(*keys).agg(F.min(F.struct(score.alias("score"), "k", "n", "last_ts", "q", "level", "slope", *pair)).alias("best")).select(*keys, "best.*")
    out = best.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    center, periods = F.col("level") + F.col("slope") * F.col("h"), []
    for i, (period, season) in enumerate(seasons):
        here = season.select(*keys, F.col("phase").alias("_phase"), F.col("season").alias(f"season{i}"))
        out = out.withColumn("_phase", F.pmod(F.col("n") - 1 + F.col("h"), F.lit(period))).join(here, [*keys, "_phase"], "left").drop("_phase")
        center = center + F.coalesce(F.col(f"season{i}"), F.lit(0.0))
        periods.append(F.when(F.col(f"season{i}").isNotNull(), str(period)))
    model = F.lit("smoothing")
    if periods:
        model = F.when(F.coalesce(*periods).isNull(), model).otherwise(F.concat(F.lit("seasonal-smoothing("), F.concat_ws(",", *periods), F.lit(")")))
    # errors add up as 1 + the sum over j < h of (alpha (1 + beta j))^2
    m, beta = F.col("h") - 1, F.col("beta")
    growth = 1 + F.col("alpha") * F.col("alpha") * (m + beta * m * (m + 1) + beta * beta * m * (m + 1) * (2 * m + 1) / 6)
    half = F.lit(spread(level)) * F.sqrt(F.col("q") * growth)
    return out.select(
        *[F.col(k).alias(name) for name, k in zip(names, keys)], "h", (F.col("last_ts") + F.make_interval(secs=F.col("h") * F.lit(max(interval_seconds, 1)))).alias("ts"),
        center.alias("predicted"), (center - half).alias("lower"), (center + half).alias("upper"), model.alias("model"),
    )
