import random
import math
import statistics
from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from logspark.operators import alerts as J, anomaly as N, forecast as P, rollups as U


def series(spark, values, key="a", minutes=1):
    return spark.createDataFrame([(key, T0 + timedelta(minutes=minutes * i), float(v)) for i, v in enumerate(values)], "k string, ts timestamp, value double")


def found(spark, values, **kw):
    return {(r["method"], r["severity"]): r["score"] for r in N.detect(series(spark, values), ["k"], F.lit("m"), **kw).collect()}


def plain_score(v):
    med = statistics.median(v)
    mad = statistics.median([abs(x - med) for x in v])
    if mad < 1e-9:
        sd = statistics.pstdev(v)
        return None if sd < 1e-9 else (v[-1] - statistics.fmean(v)) / sd
    return 0.6745 * (v[-1] - med) / mad


def test_spike_flat_short_and_noise(spark):
    out = found(spark, [10] * 60 + [500])
    assert ("mad", "critical") in out and math.isclose(out[("mad", "critical")], plain_score([10] * 60 + [500]), rel_tol=1e-9)
    assert found(spark, [10] * 61) == {}
    assert found(spark, [1, 2, 3, 400]) == {}
    noisy = [10 + (i * 7) % 5 for i in range(50)] + [60]
    out = found(spark, noisy)
    diffs = [b - a for a, b in zip(noisy, noisy[1:])]
    assert math.isclose(out[("mad", "critical")], plain_score(noisy)) and math.isclose(out[("rate_of_change", "critical")], plain_score(diffs))


def test_drop_and_season(spark):
    out = found(spark, [100, 110, 90, 105, 95, 100, 20], drops=True)
    assert math.isclose(out[("mad", "warning")], 0.8)
    values = [10 + i % 4 for i in range(16)]
    values[-5], values[-1] = 14, 60
    assert ("seasonal", "critical") in found(spark, values, period=4)


def test_many_series_and_window(spark):
    df = series(spark, range(50)).unionByName(series(spark, [5] * 10 + [90], "b"))
    last = N.latest_points(df, ["k"], 5).groupBy("k").agg(F.min("value").alias("m")).collect()
    assert {r["k"]: r["m"] for r in last} == {"a": 45.0, "b": 5.0}
    assert {r["k"] for r in N.detect(df, ["k"], F.lit("m")).collect()} == {"b"}


def test_forecast_rules(spark):
    with pytest.raises(ValueError):
        P.check_request(0, 0.9)
    with pytest.raises(ValueError):
        P.check_request(1, 1.5)
    assert P.forecast_smoothing(series(spark, [1, 2, 3]), ["k"], 3, 60).count() == 0
    rows = P.forecast_smoothing(series(spark, [1, 2, 3, 4, 5, 6, 7, 8]), ["k"], 4, 60).orderBy("h").collect()
    assert [r["ts"] for r in rows] == [T0 + timedelta(minutes=7 + i) for i in range(1, 5)]
    assert all(r["lower"] <= r["predicted"] <= r["upper"] for r in rows)
    assert abs(rows[0]["predicted"] - 9) < 0.5
    line = P.forecast_trend(series(spark, [1, 2, 3, 4]), ["k"], 2, 60).orderBy("h").collect()
    assert [round(r["predicted"], 6) for r in line] == [5, 6] and line[0]["ts"] == T0 + timedelta(minutes=4)


def test_seasonal_keeps_amplitude(spark):
    wave = [100 + 50 * math.sin(2 * math.pi * i / 96) for i in range(192)]
    assert P.seasonal_periods(192, 900) == [96] and P.seasonal_periods(191, 900) == [] and P.seasonal_periods(14 * 96, 900) == [96, 672]
    data = series(spark, wave, minutes=15)
    for out in (P.forecast_smoothing(data, ["k"], 96, 900, points=192), P.forecast_seasonal(data, ["k"], 96, 900, 96)):
        values = [r["predicted"] for r in out.collect()]
        assert max(values) - min(values) >= 50
    assert P.forecast_seasonal(data, ["k"], 2, 900, 97).count() == 0


def plain_smoothing(y, interval, horizon, z):
    """Seasons off, every pair of the grid point by point, the best pair carried on."""
    rest, seasons = list(map(float, y)), []
    for period in P.seasonal_periods(len(y), interval):
        n, mx = len(rest), (len(rest) - 1) / 2
        slope = sum((i - mx) * v for i, v in enumerate(rest)) / sum((i - mx) ** 2 for i in range(n))
        off = [v - (sum(rest) / n + slope * (i - mx)) for i, v in enumerate(rest)]
        means = [sum(off[f::period]) / len(off[f::period]) for f in range(period)]
        seasons.append((period, means))
        rest = [v - means[i % period] for i, v in enumerate(rest)]
    best = None
    for alpha, beta in P.GRID:
        level, slope, errors = rest[0], rest[1] - rest[0] if beta else 0.0, []
        for v in rest[1:]:
            e = v - level - slope
            level, slope = level + slope + alpha * e, slope + alpha * beta * e
            errors.append(e)
        q = sum(e * e for e in errors) / len(errors)
        score = len(errors) * math.log(max(q, 1e-12)) + (6 if beta else 2)
        if best is None or score < best[0] - 1e-9:
            best = (score, alpha, beta, level, slope, q)
    _, alpha, beta, level, slope, q = best
    out = []
    for h in range(1, horizon + 1):
        center = level + slope * h + sum(m[(len(y) - 1 + h) % p] for p, m in seasons)
        half = z * math.sqrt(q * (1 + sum((alpha * (1 + beta * j)) ** 2 for j in range(1, h))))
        out.append((center, center - half, center + half))
    return out


@pytest.mark.parametrize("length,interval", [(4, 60), (65, 86_400), (700, 7200), (4500, 60)])
def test_smoothing_equals_a_loop_over_points(spark, length, interval):
    rnd = random.Random(length)
    y = [round(50 + 0.3 * i + 9 * math.sin(i / 3) + rnd.gauss(0, 4), 3) for i in range(length)]
    got = P.forecast_smoothing(series(spark, y, minutes=interval / 60), ["k"], 5, interval, points=length).orderBy("h").collect()
    want = plain_smoothing(y, interval, 5, P.spread(0.95))
    assert len(got) == 5
    for r, w in zip(got, want):
        assert [r["predicted"], r["lower"], r["upper"]] == pytest.approx(w, rel=1e-6, abs=1e-6)
    assert got[0]["model"] == ("seasonal-smoothing(" + ",".join(map(str, P.seasonal_periods(length, interval))) + ")" if P.seasonal_periods(length, interval) else "smoothing")


def test_smoothing_of_long_series_needs_no_task_for_a_series(spark):
    rows = spark.range(1000).selectExpr("'a' AS k", "id AS i", "double(id % 7) AS y", "double((id + 1) % 7) AS ahead")
    states = P.smooth_states(rows, ["k"], [(0.25, 0.2)], 1000)
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan and "Python" not in plan and "Pandas" not in plan
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_block" in line for line in windows)


def test_cycles_find_a_broken_season_by_default(spark):
    n = 3000
    rows = spark.range(n).selectExpr(
        "timestamp_micros((1705312800 + id * 60) * 1000000) AS bucket", f"case when id = {n - 1} then 200 when id % 1440 = {(n - 1) % 1440} then 150 else 100 + id % 3 end AS n", "'s' AS site_id")
    found = {r["method"]: r["score"] for r in N.anomaly_cycle(rows).collect()}
    assert "seasonal" not in found  # 50 more than a day before, where the usual deviation of that minute is 49
    calm = rows.withColumn("n", F.when(F.col("n") == 200, 400).otherwise(F.col("n")))
    assert {r["method"] for r in N.anomaly_cycle(calm).collect()} >= {"seasonal"}
    sites = N.site_anomaly_cycle(calm.withColumnRenamed("n", "pageviews")).collect()
    assert {(r["metric"], r["method"]) for r in sites} >= {("web_pageviews:s", "seasonal")}


# -- rollups and alerts --------------------------------------------------------


def log_rows(spark, n=20):
    data = [(i, T0 + timedelta(seconds=i), "api" if i % 2 else "web", "error" if i % 4 == 0 else "info", f"m {i}", "fp" if i % 4 == 0 else None, '{"duration_ms":%d}' % i, 10, "http_json") for i in range(n)]
    return spark.createDataFrame(data, "event_key long, ts timestamp, service string, level string, message string, fingerprint string, attributes string, raw_len int, protocol string")


def test_services_merge(spark):
    logs = log_rows(spark, 3)
    first = U.merge_services(None, logs)
    assert {r["name"]: r["total"] for r in first.collect()} == {"web": 2, "api": 1}
    both = U.merge_services(first, logs.withColumn("service", F.when(F.col("service") == "api", "api").otherwise("")))
    assert {r["name"]: r["total"] for r in both.collect()} == {"web": 2, "api": 2}


def test_replace_buckets(spark, tmp_path):
    path = str(tmp_path / "r")
    U.replace_buckets(U.rollup_logs(log_rows(spark, 10)), path)
    U.replace_buckets(U.rollup_logs(log_rows(spark, 20)), path)
    assert spark.read.parquet(path).agg(F.sum("n")).first()[0] == 20


def test_rollup_without_durations(spark):
    r = U.rollup_logs(log_rows(spark, 1).withColumn("attributes", F.lit('{"duration_ms":"x"}')).withColumn("service", F.lit(None).cast("string"))).first()
    assert (r["service"], r["p50"], r["bytes"]) == ("", 0.0, 10)


NOW = T0 + timedelta(seconds=60)


def rule(i, kind, metric="volume", **c):
    return {"rule_id": i, "name": f"r{i}", "metric": metric, "condition": {"type": kind, **c}}


def run(spark, rules, state=None):
    logs = log_rows(spark)
    return {r["rule_id"]: r for r in J.evaluate(spark, rules, NOW, logs=logs, rollup=U.rollup_logs(logs), state=state).collect()}


def test_threshold_silence_escalation_recovery(spark):
    steps = [{"comparator": ">=", "value": 5, "severity": "warning"}, {"comparator": ">=", "value": 15, "severity": "critical"}]
    rules = [rule(1, "threshold", comparator=">", value=5), rule(2, "threshold", comparator=">", value=500), rule(3, "threshold", thresholds=steps)]
    out = run(spark, rules)
    assert (out[1]["fired"], out[1]["severity"], out[2]["fired"], out[3]["severity"]) == (True, "alert", False, "critical")
    state = J.next_state(spark.createDataFrame([], J.STATE_SCHEMA), J.evaluate(spark, rules, NOW, logs=log_rows(spark), rollup=U.rollup_logs(log_rows(spark))))
    again = run(spark, rules, state)
    assert not any(r["fired"] for r in again.values())
    worse = [rule(1, "threshold", comparator=">", value=500), rule(3, "threshold", thresholds=[{**steps[0]}, {**steps[1], "value": 100}])]
    out = run(spark, worse, state)
    assert out[1]["severity"] == "ok" and out[1]["message"].startswith("r1: ok after alert; volume was ")
    assert out[3]["severity"] == "warning" and out[3]["fired"]
    healthy = J.next_state(state, J.evaluate(spark, worse, NOW, logs=log_rows(spark), rollup=U.rollup_logs(log_rows(spark)), state=state))
    assert {r["rule_id"]: r["last_severity"] for r in healthy.collect()}[1] is None


def test_count_group_and_bad_rules(spark):
    rules = [
        rule(1, "count", filter=["level", "=", "error"], count=5), rule(2, "error_group_threshold", fingerprint="fp", value=6.0),
        rule(3, "threshold", metric="nope", comparator=">", value=1), rule(4, "threshold", comparator="=>", value=1), rule(5, "count", filter=["nope", "=", "x"], count=1),
    ]
    out = run(spark, rules)
    assert out[1]["fired"] and out[1]["value"] == 5 and not out[2]["fired"]
    assert "unsupported metric" in out[3]["error"] and "unknown comparator" in out[4]["error"] and "unknown column" in out[5]["error"]
    assert J.validate_rule({"rule_id": 1, "name": "", "condition": {"type": "anomaly"}}) == ["name must be 1..128 characters", "metric is required"]
    assert J.validate_rules(spark, rules, log_rows(spark).schema).filter("size(errors) = 0").count() == 2


def test_anomaly_rule_cooldown(spark):
    seen = spark.createDataFrame([("volume", T0, 7.0, "critical"), ("volume", NOW, 1.0, "low")], "metric string, ts timestamp, score double, severity string")
    table = J.rule_table(spark, [rule(1, "anomaly", min_severity="high", window_secs=600)], log_rows(spark).schema)
    empty = spark.createDataFrame([], J.STATE_SCHEMA)
    assert J.anomaly_firings(table, seen, empty, NOW).first()["severity"] == "critical"
    recent = spark.createDataFrame([(1, "high", NOW - timedelta(seconds=10))], J.STATE_SCHEMA)
    assert not J.anomaly_firings(table, seen, recent, NOW).first()["fired"]
    assert J.anomaly_firings(table, seen.filter("severity = 'low'"), empty, NOW).count() == 0


def test_rule_decisions(spark):
    rules = spark.createDataFrame([(1, "pending_approval"), (2, "active"), (3, "pending_approval")], "rule_id long, status string")
    out = J.set_rule_status(rules, spark.createDataFrame([(1, True), (2, False)], "rule_id long, approve boolean"))
    assert {r["rule_id"]: r["status"] for r in out.collect()} == {1: "active", 2: "active", 3: "pending_approval"}
