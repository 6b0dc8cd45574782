"""Anomalies, forecasts, alert rules, archive and retention."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import Window, functions as F

from logspark.operators import alerts as J, anomaly as N, forecast as P, retention as K, rollups as U, sessions as S, search as E
from logspark.operators.web_rollups import web_rollup_minute
from logspark.plans.predicates import compile_predicate
from logspark.session import checkpoint_dir
from logspark.sources import adapters as A, tiers as T
from registry.core import END, GAP, LOGS, R1M, RANGE, START, WEB, WEB_RANGE, check, sql_sessions

SEVERITY = "CASE WHEN abs(score) >= 6 THEN 'critical' WHEN abs(score) >= 4 THEN 'high' WHEN abs(score) >= 3 THEN 'medium' ELSE 'low' END"


def sql_scores(series: str, key: str) -> str:
    """MAD and rate-of-change scores of the newest point of every series (key, ts, v)."""
    return f"""d AS (SELECT *, v - lag(v) OVER (PARTITION BY {key} ORDER BY ts) AS dv FROM {series}),
n AS (SELECT {key}, count(*) AS n, max(ts) AS ts, arg_max(v, ts) AS last, arg_max(dv, ts) AS dlast, median(v) AS med, median(dv) AS dmed,
   avg(v) AS mean, avg(dv) AS dmean, stddev_pop(v) AS sd, stddev_pop(dv) AS dsd FROM d GROUP BY {key}),
m AS (SELECT {key}, median(abs(v - med)) AS mad, median(abs(dv - dmed)) AS dmad FROM d JOIN n USING ({key}) GROUP BY {key}),
sc AS (SELECT {key}, n.ts, 'mad' AS method, CASE WHEN mad >= 1e-9 THEN 0.6745 * (last - med) / mad WHEN sd >= 1e-9 THEN (last - mean) / sd END AS score FROM n JOIN m USING ({key}) WHERE n >= 5
  UNION ALL SELECT {key}, n.ts, 'rate_of_change', CASE WHEN dmad >= 1e-9 THEN 0.6745 * (dlast - dmed) / dmad WHEN dsd >= 1e-9 THEN (dlast - dmean) / dsd END FROM n JOIN m USING ({key}) WHERE n >= 5)"""


def sql_season(series: str, key: str, period: int = 1440) -> str:
    """Scores of the newest point of every series against the point a season before it."""
    return f"""sr AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts DESC) AS i FROM {series}),
sn AS (SELECT {key}, max(ts) AS ts, count(*) AS n, max(v) FILTER (WHERE i = 1) AS cur, max(v) FILTER (WHERE i = {period + 1}) AS prev, median(v) AS med FROM sr GROUP BY {key}),
sea AS (SELECT {key}, ts, 'seasonal' AS method, (cur - prev) / abs(prev - med) AS score FROM sn WHERE n >= {2 * period} AND abs(prev - med) > 1e-9 AND abs(cur - prev) / abs(prev - med) > 3)"""


def hourly(spark, d):
    return A.logs(spark, d).groupBy("service", F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").cast("double").alias("value"))


_HOURLY = "h AS (SELECT service, date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS v FROM logs GROUP BY 1, 2)"


@check("I1_mad_anomaly", f"WITH {LOGS}, {_HOURLY}, {sql_scores('h', 'service')} SELECT service, ts, round(score, 6) AS score, {SEVERITY} AS severity FROM sc WHERE method='mad' AND abs(score) >= 0.5")
def i1(spark, d):
    found = N.detect(N.latest_points(hourly(spark, d), ["service"], 800), ["service"], F.lit("volume"), z=0.5)
    return found.filter("method = 'mad'").select("service", "ts", F.round("score", 6).alias("score"), "severity")


@check("I2_rate_of_change", f"WITH {LOGS}, {_HOURLY}, {sql_scores('h', 'service')} SELECT service, ts, round(score, 6) AS score, {SEVERITY} AS severity FROM sc WHERE method='rate_of_change' AND abs(score) >= 0.5")
def i2(spark, d):
    found = N.detect(N.latest_points(hourly(spark, d), ["service"], 800), ["service"], F.lit("volume"), z=0.5)
    return found.filter("method = 'rate_of_change'").select("service", "ts", F.round("score", 6).alias("score"), "severity")


@check("I3_seasonal_anomaly", f"""WITH {LOGS}, h AS (SELECT source_host, level, date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS v FROM logs GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY source_host, level ORDER BY ts DESC) AS i, count(*) OVER (PARTITION BY source_host, level) AS n FROM h),
s AS (SELECT source_host, level, max(ts) AS ts, max(v) FILTER (WHERE i=1) AS cur, max(v) FILTER (WHERE i=9) AS prev, avg(v) AS m, median(v) AS med FROM r WHERE n >= 16 GROUP BY 1, 2)
SELECT source_host, level, ts, round((cur - prev) / abs(prev - med), 6) AS score FROM s WHERE abs(prev - med) > 1e-9 AND abs(cur - prev) / abs(prev - med) > 3""")
def i3(spark, d):
    keys = ["source_host", "level"]
    series = A.logs(spark, d).groupBy(*keys, F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").cast("double").alias("value"))
    found = N.detect(N.latest_points(series, keys, 2880), keys, F.lit("volume"), period=8)
    return found.filter("method = 'seasonal'").select(*keys, "ts", F.round("score", 6).alias("score"))


@check("I4_severity", f"WITH {LOGS}, s AS (SELECT event_key, duration_ms / 20 - 3 AS score FROM logs) SELECT event_key, {SEVERITY} AS severity FROM s")
def i4(spark, d):
    from logspark.functions.levels import anomaly_severity

    value = F.get_json_object("attributes", "$.duration_ms").cast("double")
    return A.logs(spark, d).select("event_key", anomaly_severity(value / 20 - 3).alias("severity"))


@check("I5_anomaly_cycle", f"""WITH {LOGS}, {R1M}, t AS (SELECT 0 AS a, bucket AS ts, sum(n)::DOUBLE AS v FROM r1m GROUP BY 2 ORDER BY 2 DESC LIMIT 2881), {sql_scores('t', 'a')}, {sql_season('t', 'a')}
SELECT ts, 'volume' AS metric, round(score, 6) AS score, method, {SEVERITY} AS severity FROM (SELECT ts, score, method FROM sc WHERE abs(score) >= 0.1 UNION ALL SELECT ts, score, method FROM sea)""")
def i5(spark, d):
    return N.anomaly_cycle(U.rollup_logs(A.logs(spark, d), "1m"), z=0.1).withColumn("score", F.round("score", 6))


_SITES = f"""wr AS (SELECT site_id, date_trunc('minute', ts) AS ts, count(*) FILTER (WHERE event='pageview')::DOUBLE AS v FROM web WHERE NOT is_bot GROUP BY 1, 2),
l AS (SELECT site_id, ts, v FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS i FROM wr) WHERE i <= 2881)"""


@check("I6_site_anomaly_cycle", f"""WITH {WEB}, {_SITES}, {sql_scores('l', 'site_id')}, {sql_season('l', 'site_id')}, p AS (SELECT site_id, max(ts) AS t, arg_max(v, ts) AS cur FROM l GROUP BY 1),
q AS (SELECT site_id, list_sort(list(v)) AS vs FROM l JOIN p USING (site_id) WHERE ts < t GROUP BY 1),
w AS (SELECT site_id, t AS ts, vs[len(vs) // 2 + 1] AS usual, cur FROM p JOIN q USING (site_id))
SELECT ts, 'web_pageviews:' || site_id AS metric, round(score, 6) AS score, method, {SEVERITY} AS severity FROM (SELECT site_id, ts, score, method FROM sc WHERE abs(score) >= 0.1 UNION ALL SELECT site_id, ts, score, method FROM sea)
UNION ALL SELECT ts, 'web_pageviews:' || site_id, round(CASE WHEN usual > 0 THEN (usual - cur) / usual ELSE 1.0 END, 6), 'mad', 'warning' FROM w WHERE cur < 0.3 * usual""")
def i6(spark, d):
    return N.site_anomaly_cycle(web_rollup_minute(A.web_events(spark, d)), z=0.1).withColumn("score", F.round("score", 6))


@check("I7_anomalies_on", f"""WITH {LOGS}, t AS (SELECT 0 AS a, date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS v FROM logs WHERE level='error' GROUP BY 2), {sql_scores('t', 'a')}
SELECT ts, method, round(score, 6) AS score FROM sc WHERE abs(score) >= 0.1""")
def i7(spark, d):
    logs = A.logs(spark, d)
    volume = U.volume(START, END, logs=logs, predicate=compile_predicate(["level", "=", "error"], logs.schema))
    return N.anomalies_on(volume, z=0.1).select("ts", "method", F.round("score", 6).alias("score"))


# -- forecasts ---------------------------------------------------------------

_DAILY = "dd AS (SELECT o_orderpriority AS k, date_trunc('day', o_orderdate) AS ts, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)"


def daily_orders(spark, d):
    return A.table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("k"), F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("ts")
    ).agg(F.sum("o_totalprice").alias("value"))


def _rounded(f):
    return f.withColumns({c: F.round(c, 2) for c in ("predicted", "lower", "upper")})


_IDX = """x AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts DESC) AS r FROM dd),
y AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS i FROM x WHERE r <= {points}),
fit AS (SELECT k, count(*) AS n, max(ts) AS last_ts, regr_slope(v, i) AS b, regr_intercept(v, i) AS a, sqrt((regr_syy(v, i) - regr_slope(v, i) * regr_sxy(v, i)) / (count(*) - 2)) AS s FROM y GROUP BY 1)"""


@check("I8_forecast_trend", f"""WITH {_DAILY}, {_IDX.format(points=120)}, h AS (SELECT unnest(range(1, 15)) AS h)
SELECT k, h, last_ts + to_days(CAST(h AS INTEGER)) AS ts, round(a + b * (n - 1 + h), 2) AS predicted, round(a + b * (n - 1 + h) - 1.959963984540054 * s, 2) AS lower,
  round(a + b * (n - 1 + h) + 1.959963984540054 * s, 2) AS upper FROM fit CROSS JOIN h""")
def i8(spark, d):
    return _rounded(P.forecast_trend(daily_orders(spark, d), ["k"], 14, 86_400))


GRID_SQL = """g AS (SELECT p, round(0.05 + 0.1 * (p // 4), 2) AS alpha, [0.0, 0.05, 0.2, 0.5][p % 4 + 1]::DOUBLE AS beta FROM range(40) AS r(p)),
st AS (
  SELECT a.k, p, alpha::DOUBLE AS alpha, beta, 0 AS i, a.v AS l, CASE WHEN beta > 0 THEN b.v - a.v ELSE 0 END AS s, 0::DOUBLE AS sq FROM z a JOIN z b ON a.k = b.k AND a.i = 0 AND b.i = 1, g
  UNION ALL
  SELECT st.k, p, alpha, beta, st.i + 1, l + s + alpha * (z.v - l - s), s + alpha * beta * (z.v - l - s), sq + (z.v - l - s) * (z.v - l - s) FROM st JOIN z ON z.k = st.k AND z.i = st.i + 1),
c AS (SELECT k, count(*) AS n, max(ts) AS last_ts FROM z GROUP BY 1),
best AS (SELECT st.*, n, last_ts, sq / (n - 1) AS q FROM st JOIN c ON st.k = c.k AND st.i = n - 1 WHERE n >= 4
  QUALIFY row_number() OVER (PARTITION BY st.k ORDER BY (n - 1) * ln(greatest(sq / (n - 1), 1e-12)) + CASE WHEN beta > 0 THEN 6 ELSE 2 END, p) = 1),
f AS (SELECT *, l + s * h AS level, 1.959963984540054 * sqrt(q * (1 + alpha * alpha * ((h - 1) + beta * (h - 1) * h + beta * beta * (h - 1) * h * (2 * h - 1) / 6))) AS half FROM best, range(1, {h}) AS r(h))"""


@check("I8_forecast_smoothing", f"""WITH RECURSIVE {_DAILY}, {_IDX.format(points=120)}, z AS (SELECT * FROM y), {GRID_SQL.format(h=15)}
SELECT k, h, last_ts + to_days(CAST(h AS INTEGER)) AS ts, round(level, 2) AS predicted, round(level - half, 2) AS lower, round(level + half, 2) AS upper, 'smoothing' AS model FROM f""")
def i8s(spark, d):
    return _rounded(P.forecast_smoothing(daily_orders(spark, d), ["k"], 14, 86_400))


@check("I8_smoothing_states", f"""WITH RECURSIVE {_DAILY}, {_IDX.format(points=1000)},
st AS (SELECT a.k, 0 AS i, a.v AS l, b.v - a.v AS s, NULL::DOUBLE AS e FROM y a JOIN y b ON a.k = b.k AND a.i = 0 AND b.i = 1
  UNION ALL SELECT st.k, y.i, l + s + 0.25 * (y.v - l - s), s + 0.05 * (y.v - l - s), y.v - l - s FROM st JOIN y ON y.k = st.k AND y.i = st.i + 1)
SELECT k, CAST(i AS BIGINT) AS i, round(l, 3) AS level, round(s, 3) AS slope, round(e, 3) AS error FROM st""")
def i8t(spark, d):
    by_time = Window.partitionBy("k").orderBy("ts")
    rows = N.latest_points(daily_orders(spark, d), ["k"], 1000).select("k", (F.row_number().over(by_time) - 1).alias("i"), F.col("value").alias("y"), F.lead("value").over(by_time).alias("ahead"))
    states = P.smooth_states(rows, ["k"], [(0.25, 0.2)], 1000)
    return states.select("k", "i", *[F.round(F.get(c, F.lit(0)), 3).alias(name) for c, name in (("l", "level"), ("s", "slope"), ("e", "error"))])


@check("I9_forecast_seasonal", f"""WITH {_DAILY}, {_IDX.format(points=364)}, h AS (SELECT unnest(range(1, 15)) AS h),
o AS (SELECT k, i % 7 AS p, v - (a + b * i) AS off FROM y JOIN fit USING (k)), se AS (SELECT k, p, avg(off) AS m, var_pop(off) AS vv, count(*) AS c FROM o GROUP BY 1, 2),
nz AS (SELECT k, sqrt(sum(vv * c) / sum(c)) AS z FROM se GROUP BY 1)
SELECT fit.k AS k, h, last_ts + to_days(CAST(h AS INTEGER)) AS ts, round(a + b * (n - 1 + h) + m, 2) AS predicted, round(a + b * (n - 1 + h) + m - 1.959963984540054 * z, 2) AS lower,
 round(a + b * (n - 1 + h) + m + 1.959963984540054 * z, 2) AS upper FROM fit CROSS JOIN h JOIN se ON se.k = fit.k AND se.p = (n - 1 + h) % 7 JOIN nz ON nz.k = fit.k""")
def i9(spark, d):
    return _rounded(P.forecast_seasonal(daily_orders(spark, d), ["k"], 14, 86_400, 7, points=364))


@check("I9_forecast_seasonal_smoothing", f"""WITH RECURSIVE {LOGS}, {_HOURLY}, r AS (SELECT service AS k, ts, v, row_number() OVER (PARTITION BY service ORDER BY ts DESC) AS r FROM h),
y AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM r WHERE r <= 720),
f1 AS (SELECT k, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM y WHERE n >= 48 GROUP BY 1), s1 AS (SELECT k, i % 24 AS p, avg(v - (a + b * i)) AS m FROM y JOIN f1 USING (k) GROUP BY 1, 2),
y2 AS (SELECT y.k, ts, v - coalesce(m, 0) AS v, i, n FROM y LEFT JOIN s1 ON s1.k = y.k AND s1.p = i % 24),
f2 AS (SELECT k, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM y2 WHERE n >= 336 GROUP BY 1), s2 AS (SELECT k, i % 168 AS p, avg(v - (a + b * i)) AS m FROM y2 JOIN f2 USING (k) GROUP BY 1, 2),
z AS (SELECT y2.k, ts, v - coalesce(m, 0) AS v, i FROM y2 LEFT JOIN s2 ON s2.k = y2.k AND s2.p = i % 168), {GRID_SQL.format(h=25)}, o AS (
SELECT f.k AS service, h, last_ts + to_hours(CAST(h AS INTEGER)) AS ts, level + coalesce(s1.m, 0) + coalesce(s2.m, 0) AS center, half,
  CASE WHEN s1.m IS NULL THEN 'smoothing' WHEN s2.m IS NULL THEN 'seasonal-smoothing(24)' ELSE 'seasonal-smoothing(24,168)' END AS model
FROM f LEFT JOIN s1 ON s1.k = f.k AND s1.p = (n - 1 + h) % 24 LEFT JOIN s2 ON s2.k = f.k AND s2.p = (n - 1 + h) % 168)
SELECT service, h, ts, round(center, 4) AS predicted, round(center - half, 4) AS lower, round(center + half, 4) AS upper, model FROM o""")
def i9s(spark, d):
    out = P.forecast_smoothing(hourly(spark, d), ["service"], 24, 3600, points=720)
    return out.withColumns({c: F.round(c, 4) for c in ("predicted", "lower", "upper")})


@check("I10_series_choice", f"""WITH {LOGS}, t AS (SELECT service, date_trunc('hour', ts) AS ts, count(*) AS value FROM logs WHERE level <> 'info' GROUP BY 1, 2)
SELECT service, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC) AS i FROM t) WHERE i <= 120""")
def i10(spark, d):
    t = A.logs(spark, d).filter("level <> 'info'").groupBy("service", F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").alias("value"))
    return N.latest_points(t, ["service"], 120)


# -- alerts ------------------------------------------------------------------

MONTH = 30 * 86_400
STEPS = [{"comparator": ">=", "value": 0.05, "severity": "warning"}, {"comparator": ">=", "value": 0.15, "severity": "critical"}]
RULES = [
    {"rule_id": 1, "name": "volume", "metric": "volume", "condition": {"type": "threshold", "comparator": ">", "value": 5, "window_secs": MONTH}},
    {"rule_id": 2, "name": "errors", "metric": "error_rate", "condition": {"type": "threshold", "window_secs": MONTH, "thresholds": STEPS}},
    {"rule_id": 3, "name": "slow", "metric": "p95_latency", "condition": {"type": "threshold", "comparator": ">", "value": 100000, "window_secs": MONTH}},
    {"rule_id": 4, "name": "views", "metric": "web_pageviews:site-1", "condition": {"type": "threshold", "comparator": "<", "value": 1, "window_secs": MONTH}},
    {"rule_id": 5, "name": "handlers", "condition": {"type": "count", "filter": ["and", ["text", "handler"], ["service", "=", "svc-1"]], "comparator": ">=", "count": 10, "window_secs": MONTH}},
    {"rule_id": 6, "name": "groups", "condition": {"type": "error_group_threshold", "comparator": ">=", "value": 3, "min_level": "fatal", "window_secs": MONTH}},
    {"rule_id": 7, "name": "odd", "metric": "nope", "condition": {"type": "threshold", "comparator": ">", "value": 1}},
    {"rule_id": 8, "name": "exact", "metric": "volume", "condition": {"type": "threshold", "comparator": "==", "value": 10000, "window_secs": MONTH}},
]

_OBS = f"""WITH {LOGS}, {R1M}, ob AS (
SELECT 1 AS rule_id, sum(n)::DOUBLE AS value FROM r1m UNION ALL SELECT 2, sum(n) FILTER (WHERE level='error')::DOUBLE / sum(n) FROM r1m
UNION ALL SELECT 3, sum(p95 * n) / sum(n) FROM r1m
UNION ALL SELECT 4, count(*)::DOUBLE FROM (WITH {WEB} SELECT * FROM web) WHERE event='pageview' AND NOT is_bot AND site_id='site-1'
UNION ALL SELECT 5, count(*)::DOUBLE FROM logs WHERE message ILIKE '%handler%' AND service='svc-1' UNION ALL SELECT 6, count(*)::DOUBLE FROM logs WHERE level='fatal'
UNION ALL SELECT 8, sum(n)::DOUBLE FROM r1m)"""


def observed(spark, d, ids):
    logs = A.logs(spark, d)
    rules = [r for r in RULES if r["rule_id"] in ids]
    return J.observed_values(rules, END, logs, U.rollup_logs(logs, "1m"), web_rollup_minute(A.web_events(spark, d)))


def _observed(name, ids):
    @check(name, f"{_OBS} SELECT CAST(rule_id AS BIGINT) AS rule_id, round(value, 6) AS value FROM ob WHERE rule_id IN ({', '.join(map(str, ids))})")
    def run(spark, d):
        return observed(spark, d, ids).withColumn("value", F.round("value", 6))


_observed("J1_threshold_rules", (1, 2, 3, 4, 8))
_observed("J2_count_rules", (5,))
_observed("J3_error_group_rules", (6,))


def evaluated(spark, d):
    logs = A.logs(spark, d)
    state = spark.createDataFrame([(1, "alert", START), (3, "alert", START), (5, None, None)], J.STATE_SCHEMA)
    return state, J.evaluate(
        spark, RULES, END, logs=logs, rollup=U.rollup_logs(logs, "1m"), web_rollup=web_rollup_minute(A.web_events(spark, d)), state=state
    )


_EVAL = _OBS + """, c AS (SELECT rule_id, value, CASE WHEN rule_id = 1 AND value > 5 THEN 'alert' WHEN rule_id = 2 AND value >= 0.15 THEN 'critical' WHEN rule_id = 2 AND value >= 0.05 THEN 'warning'
  WHEN rule_id = 3 AND value > 100000 THEN 'alert' WHEN rule_id = 4 AND value < 1 THEN 'alert' WHEN rule_id = 5 AND value >= 10 THEN 'alert' WHEN rule_id = 6 AND value >= 3 THEN 'alert'
  WHEN rule_id = 8 AND abs(value - 10000) < 1e-9 THEN 'alert' ELSE 'ok' END AS severity, CASE WHEN rule_id IN (1, 3) THEN 'alert' ELSE 'ok' END AS before FROM ob)"""


@check("J5_escalation", _EVAL + " SELECT CAST(rule_id AS BIGINT) AS rule_id, round(value, 6) AS value, severity, before, severity <> before AS fired FROM c UNION ALL SELECT 7, NULL, NULL, 'ok', false")
def j5(spark, d):
    _, out = evaluated(spark, d)
    return out.select("rule_id", F.round("value", 6).alias("value"), "severity", "before", "fired")


@check("J5_messages", _EVAL + """ SELECT CAST(2 AS BIGINT) AS rule_id, 'errors: ' || severity || '; error_rate was ' || printf('%.3f', value) || ' in 2592000 s, limit >= ' || CASE severity WHEN 'critical' THEN '0.15' ELSE '0.05' END AS message FROM c WHERE rule_id = 2
UNION ALL SELECT 3, 'slow: ok after alert; p95_latency was ' || printf('%.3f', value) || ' in 2592000 s' FROM c WHERE rule_id = 3""")
def j5m(spark, d):
    return evaluated(spark, d)[1].filter("rule_id IN (2, 3) AND fired").select("rule_id", "message")


@check("J5_severity_history", f"""WITH {LOGS}, h AS (SELECT service, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, count(*) FILTER (WHERE level='error')::DOUBLE / count(*) AS value FROM logs GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN value >= 0.3 THEN 'critical' WHEN value >= 0.2 THEN 'warning' ELSE 'ok' END AS severity FROM h),
b AS (SELECT *, coalesce(lag(severity) OVER (PARTITION BY service ORDER BY ts), 'ok') AS before FROM s)
SELECT service, ts, round(value, 6) AS value, before, severity FROM b WHERE severity <> before""")
def j5h(spark, d):
    r = F.count_if(F.col("level") == "error") / F.count("*")
    series = A.logs(spark, d).groupBy("service", F.date_trunc("day", "ts").alias("ts")).agg(r.alias("value"))
    steps = [{"comparator": ">=", "value": 0.2, "severity": "warning"}, {"comparator": ">=", "value": 0.3, "severity": "critical"}]
    return J.severity_history(series, ["service"], steps).withColumn("value", F.round("value", 6))


@check("J6_comparators", f"""WITH {LOGS} SELECT event_key, CASE k % 6 WHEN 0 THEN duration_ms > 50 WHEN 1 THEN duration_ms >= 50 WHEN 2 THEN duration_ms < 50 WHEN 3 THEN duration_ms <= 50 WHEN 4 THEN abs(duration_ms - 50) < 1e-9 END IS TRUE AS hit, k % 6 = 5 AS unknown FROM logs""")
def j6(spark, d):
    v = F.get_json_object("attributes", "$.duration_ms").cast("double")
    sign = F.element_at(F.array(*[F.lit(c) for c in (">", ">=", "<", "<=", "==", "??")]), F.get_json_object("attributes", "$.k").cast("int") % 6 + 1)
    hit = J.compare(v, sign, F.lit(50.0))
    return A.logs(spark, d).select("event_key", F.coalesce(hit, F.lit(False)).alias("hit"), hit.isNull().alias("unknown"))


@check("J4_anomaly_rules", f"""WITH {LOGS}, a AS (SELECT service AS metric, ts, duration_ms / 50 AS score, CASE WHEN duration_ms > 150 THEN 'critical' WHEN duration_ms > 100 THEN 'high' ELSE 'low' END AS severity FROM logs),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, score DESC) AS i FROM a WHERE ts >= TIMESTAMP '2024-01-01')
SELECT metric, round(arg_min(score, i), 6) AS value, arg_min(severity, i) AS severity FROM r WHERE severity IN ('critical', 'high') GROUP BY 1""")
def j4(spark, d):
    logs = A.logs(spark, d)
    v = F.get_json_object("attributes", "$.duration_ms").cast("double")
    found = logs.select(F.col("service").alias("metric"), "ts", (v / 50).alias("score"),
                        F.when(v > 150, "critical").when(v > 100, "high").otherwise("low").alias("severity"))
    rules = [{"rule_id": i, "name": f"r{i}", "metric": f"svc-{i}", "condition": {"type": "anomaly", "min_severity": "high", "window_secs": MONTH}} for i in range(8)]
    state = spark.createDataFrame([(0, "high", START)], J.STATE_SCHEMA)
    out = J.anomaly_firings(J.rule_table(spark, rules, logs.schema), found, state, END)
    return out.filter("fired").select("metric", F.round("value", 6).alias("value"), "severity")


@check("J7_firing_history", _EVAL + """ SELECT CAST(rule_id AS BIGINT) AS rule_id, severity, CASE WHEN severity = 'ok' THEN NULL ELSE severity END AS last_severity FROM c WHERE severity <> before""")
def j7(spark, d):
    state, out = evaluated(spark, d)
    fresh = J.next_state(state, out).select("rule_id", "last_severity")
    return J.rule_history(J.firing_rows(out)).select("rule_id", "severity").join(fresh, "rule_id")


@check("J7_rule_status", """SELECT c_custkey AS rule_id, CASE WHEN c_custkey % 3 = 0 THEN CASE c_custkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'rejected' ELSE 'pending_approval' END ELSE 'active' END AS status FROM customer""")
def j7b(spark, d):
    key = F.col("c_custkey")
    c = A.table(spark, d, "customer")
    rules = c.select(key.alias("rule_id"), F.when(key % 3 == 0, "pending_approval").otherwise("active").alias("status"))
    decisions = c.filter(key % 4 < 2).select(key.alias("rule_id"), (key % 4 == 0).alias("approve"))
    return J.set_rule_status(rules, decisions)


# -- archive and retention -----------------------------------------------------

_CUT = START + timedelta(days=20)


@check("A1_union_tiers", f"WITH {LOGS} SELECT event_key, ts, service, level, CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN geo_country END AS geo_country FROM logs")
def a1(spark, d):
    logs = A.logs(spark, d)
    hot, cold = K.split_hot(logs, _CUT)[1], K.split_hot(logs, _CUT)[0].drop("geo_country", "fingerprint")
    both = T.union_tiers(hot, cold, {"event_key": logs.schema["event_key"].dataType})
    return both.select("event_key", "ts", "service", "level", "geo_country")


@check("A2_union_web_tiers", f"WITH {WEB} SELECT ts, site_id, event, CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN device END AS device, count(*) AS n FROM web GROUP BY ALL")
def a2(spark, d):
    web = A.web_events(spark, d)
    both = T.union_web_tiers(web.filter(F.col("ts") >= F.lit(_CUT)), web.filter(F.col("ts") < F.lit(_CUT)).drop("device"))
    return both.groupBy("ts", "site_id", "event", "device").agg(F.count("*").alias("n"))


@check("A3_archive_rows", f"WITH {LOGS} SELECT strftime(ts, '%Y-%m-%d') AS date, hour(ts) AS hour, service AS service_part, count(*) AS n FROM logs WHERE ts < TIMESTAMP '2024-01-21' GROUP BY 1, 2, 3")
def a3(spark, d):
    return T.archive_rows(A.logs(spark, d), _CUT).groupBy("date", "hour", "service_part").agg(F.count("*").alias("n"))


def _scratch(spark, name):
    """A fresh folder under the cluster's shared checkpoint directory (one in the warehouse in tests)."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@check("A6_export_events", f"WITH {sql_sessions()} SELECT ts, event, name, path, source, medium, country, region, city, device, browser, os, visitor_id, session_id, trace_id FROM we WHERE {WEB_RANGE} AND NOT is_bot AND NOT coalesce(is_internal, false) ")
def a6(spark, d):
    from logspark.operators.web_reports import events_in

    return T.export_rows(events_in(S.stamp_sessions(A.web_events(spark, d), GAP), START, END), "events")


@check("A6_export_sessions", f"WITH {sql_sessions()} SELECT session_id, start_ts, end_ts, entry_path, exit_path, pageviews, events, engaged_ms, is_bounce, source, medium, country, region, city, device FROM ws ")
def a6b(spark, d):
    return T.export_rows(S.sessionize(A.web_events(spark, d), GAP), "sessions")


@check("A7_flatten_attributes", f"""WITH {LOGS} SELECT event_key, CAST(duration_ms AS VARCHAR) AS d, event_type AS e, CAST(k AS VARCHAR) AS k,
  CASE WHEN event_type='view' THEN 'SPAN_KIND_SERVER' END AS kind, CASE WHEN event_type='error' THEN 'E' || (k % 5) END AS x FROM logs WHERE {RANGE}""")
def a7(spark, d):
    flat = E.flatten_attributes(A.logs(spark, d), F.lit(True), START, END)
    text = F.col("`attr.duration_ms`").cast("double").cast("string")
    return flat.select("event_key", text.alias("d"), F.col("`attr.event`").alias("e"), F.col("`attr.k`").alias("k"),
                       F.col("`attr.span_kind`").alias("kind"), F.col("`attr.exception_type`").alias("x"))


@check("A8_cold_footprint", f"WITH {WEB} SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS rows FROM web WHERE ts < TIMESTAMP '2024-01-21' GROUP BY 1")
def a8(spark, d):
    root = _scratch(spark, "web-archive")
    T.archive_web(A.web_events(spark, d).drop("utm"), root, _CUT)
    return T.cold_footprint(T.read_archive(spark, root)).select("date", "rows")


@check("A9_store_state", f"WITH {LOGS} SELECT count(*) AS hot_rows, min(ts) AS oldest_hot_ts, max(ts) AS newest_hot_ts, max(insert_ts) AS last_insert_ts, (SELECT count(DISTINCT fingerprint) FROM logs) AS error_groups FROM logs")
def a9(spark, d):
    from logspark.operators.errors import fold_error_groups

    logs = A.logs(spark, d)
    return T.store_state(logs, fold_error_groups(logs))


@check("K1_compact_split", f"WITH {LOGS} SELECT service, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-21') AS moved, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-21') AS kept FROM logs GROUP BY 1")
def k1(spark, d):
    old, stay = K.split_hot(A.logs(spark, d), _CUT)
    one = old.select("service", F.lit(1).alias("m"), F.lit(0).alias("k")).unionByName(stay.select("service", F.lit(0).alias("m"), F.lit(1).alias("k")))
    return one.groupBy("service").agg(F.sum("m").alias("moved"), F.sum("k").alias("kept"))


@check("K2_enforce_hot_cap", f"""WITH {LOGS}, o AS (SELECT min(epoch_us(ts)) AS t0 FROM logs), s AS (SELECT (epoch_us(ts) - t0) // 3600000000 AS step, sum(raw_len) AS b, count(*) AS c FROM logs, o GROUP BY 1),
r AS (SELECT *, sum(b) OVER (ORDER BY step DESC) AS lb, row_number() OVER (ORDER BY step) AS nth FROM s)
SELECT make_timestamp(CAST((SELECT t0 FROM o) + (max(step) + 1) * 3600000000 AS BIGINT)) AS cutoff, CAST(sum(c) AS BIGINT) AS moved_rows, CAST(sum(b) AS BIGINT) AS moved_bytes FROM r WHERE lb > (SELECT sum(raw_len) * 19 // 20 FROM logs) AND nth <= 48""")
def k2(spark, d):
    logs = A.logs(spark, d)
    cap = logs.agg(F.sum(F.col("raw_len").cast("long"))).first()[0] * 19 // 20
    return K.enforce_hot_cap(logs, cap)


_PARTS = f"parts AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date, hour(ts) AS hour, service AS service_part FROM logs)"


@check("K3_expired_partitions", f"""WITH {LOGS}, {_PARTS}, p AS (SELECT *, CASE WHEN service_part LIKE 'svc-1' THEN 5 WHEN service_part LIKE 'sv_-_' AND service_part LIKE '%3' THEN 10 WHEN service_part LIKE 'svc-%' THEN 20 ELSE 25 END AS keep_days FROM parts)
SELECT date, hour, service_part, keep_days FROM p WHERE CAST(date AS DATE) < DATE '2024-01-31' - CAST(keep_days AS INTEGER)""")
def k3(spark, d):
    parts = T.archive_rows(A.logs(spark, d), END + timedelta(days=1)).select("date", "hour", "service_part").distinct()
    return K.expired_partitions(parts, [("svc-1", 5), ("sv?-3", 10), ("svc-*", 20)], 25, date(2024, 1, 31))


@check("K4_safe_partition_name", """WITH n AS (SELECT DISTINCT source || ' / ' || lang AS raw FROM documents UNION ALL SELECT c_name FROM customer)
SELECT raw, left(name, 60) AS stem, changed FROM (SELECT raw, rtrim(regexp_replace(raw, '[^A-Za-z0-9_.-]', '_', 'g'), '._ ') AS name, NOT regexp_matches(raw, '^[A-Za-z0-9_.-]*$') AS changed FROM n)""")
def k4(spark, d):
    docs = A.table(spark, d, "documents").select(F.concat("source", F.lit(" / "), "lang").alias("raw")).distinct()
    names = docs.unionAll(A.table(spark, d, "customer").select(F.col("c_name").alias("raw")))
    safe = K.safe_partition_name(F.col("raw"))
    stem = F.regexp_replace(safe, "--[0-9a-f]{8}$", "")
    return names.select("raw", F.substring(stem, 1, 60).alias("stem"), safe.rlike("--[0-9a-f]{8}$").alias("changed"))


@check("K5_expired_web", f"WITH {WEB} SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date, site_id AS site FROM web WHERE CAST(ts AS DATE) < DATE '2024-01-26'")
def k5(spark, d):
    parts = A.web_events(spark, d).select(F.to_date("ts").alias("date"), K.safe_site_name(F.col("site_id")).alias("site")).distinct()
    return K.expired_web(parts, 5, date(2024, 1, 31))
