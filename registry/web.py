"""Sessions, web rollups and web reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from logspark.operators import sessions as S, visit_store as V, web_reports as R, web_rollups as WR
from logspark.sources import adapters as A
from registry.core import END, GAP, HUMAN, SES_RANGE, START, WEB, WEB_RANGE, check, sql_sessions
from registry.series import _scratch

WS = sql_sessions()
_EV = f"{WEB_RANGE} AND {HUMAN}"
_SES = f"{SES_RANGE} AND NOT coalesce(is_internal, false)"
_ALL = ("session_id, site_id, visitor_id, user_id, is_internal, start_ts, end_ts, entry_path, exit_path, pageviews, events, "
        "engaged_ms, is_bounce, source, medium, country, region, city, device, browser, os")


def stamped(spark, d):
    return S.stamp_sessions(A.web_events(spark, d), GAP)


def visits(spark, d):
    return S.sessionize(A.web_events(spark, d), GAP)


def days(c="daily", n="n"):
    return F.array_join(F.transform(c, lambda x: F.concat(x["day"].cast("string"), F.lit("="), x[n].cast("string"))), ",")


# -- D: web filters ----------------------------------------------------------

@check("D11_chips", f"WITH {WEB} SELECT event_key, path FROM web WHERE {_EV} AND country = 'US' AND device = 'mobile' AND source = 'google'")
def d11(spark, d):
    chips = {"country": "US", "device": " mobile ", "source": "google", "path": ""}
    return R.events_in(A.web_events(spark, d), START, END, chips=chips).select("event_key", "path")


@check("D12_session_chips", f"""WITH {WS} SELECT session_id, start_ts FROM ws WHERE {_SES}
AND session_id IN (SELECT session_id FROM we WHERE path = '/p/3' AND {WEB_RANGE} AND NOT coalesce(is_internal, false))""")
def d12(spark, d):
    rows = R.sessions_in(visits(spark, d), START, END, events=stamped(spark, d), chips={"path": "/p/3"})
    return rows.select("session_id", "start_ts")


@check("D13_bots_and_internal", f"WITH {WEB} SELECT site_id, count(*) FILTER (WHERE NOT is_bot) AS people, count(*) FILTER (WHERE {HUMAN}) AS visitors FROM web GROUP BY 1")
def d13(spark, d):
    return A.web_events(spark, d).groupBy("site_id").agg(
        F.count_if(R.human()).alias("people"), F.count_if(R.human() & R.internal_ok(False)).alias("visitors")
    )


# -- H: sessions -------------------------------------------------------------

@check("H1_sessionize", f"WITH {WS} SELECT {_ALL} FROM ws")
def h1(spark, d):
    return visits(spark, d)


@check("H1_sessionize_half_hour", f"WITH {sql_sessions(1800)} SELECT {_ALL} FROM ws")
def h1b(spark, d):
    return S.sessionize(A.web_events(spark, d))


@check("H1_stamp_sessions", f"WITH {WS} SELECT event_key, session_id FROM we")
def h1c(spark, d):
    return stamped(spark, d).select("event_key", "session_id")


@check("H1_stamp_hot_slots", f"WITH {WS} SELECT event_key, session_id FROM we")
def h1d(spark, d):
    return S.stamp_sessions(A.web_events(spark, d), GAP, hot_rows=2).select("event_key", "session_id")


@check("H2_restitch", f"WITH {WS} SELECT {_ALL} FROM ws")
def h2(spark, d):
    events = A.web_events(spark, d)
    late = (F.col("ts") >= F.lit(START + timedelta(days=20))) | (F.col("event_key") % 5 == 0)
    return S.restitch(events, S.sessionize(events.filter(~late), GAP), events.filter(late), GAP)


@check("H2_visit_batches", f"WITH {WS} SELECT {_ALL} FROM ws")
def h2b(spark, d):
    events = A.web_events(spark, d)
    late = (F.col("ts") >= F.lit(START + timedelta(days=20))) | (F.col("event_key") % 5 == 0)
    root = _scratch(spark, "visits")
    for version, part in enumerate((~late, late)):
        V.apply_batch(events.filter(part).drop("utm"), root, version, GAP, buckets=8)
    return V.read_sessions(spark, root)


@check("H19_repair_sessions", f"""WITH {WS} SELECT session_id, entry_path, exit_path, engaged_ms, is_bounce, device, browser, os, region, city FROM ws
WHERE NOT (start_ts >= TIMESTAMP '2024-01-24' AND visitor_id % 9 = 0)""")
def h19(spark, d):
    good = visits(spark, d)
    v, recent = F.col("visitor_id"), F.col("start_ts") >= F.lit(START + timedelta(days=23))
    null = F.lit(None).cast("string")
    rotated = v % 4 == 1
    broken = good.select(
        *[c for c in good.columns if c not in ("entry_path", "exit_path", "device", "browser", "os", "region", "city", "is_bounce", "engaged_ms", "pageviews")],
        F.when(v % 5 == 0, null).otherwise(F.col("entry_path")).alias("entry_path"), F.when(v % 5 == 0, null).otherwise(F.col("exit_path")).alias("exit_path"),
        F.when(rotated, F.col("region")).otherwise(F.col("device")).alias("device"),
        F.when(rotated, F.col("city")).otherwise(F.col("browser")).alias("browser"),
        F.when(rotated, F.col("device")).otherwise(F.col("os")).alias("os"),
        F.when(rotated, F.col("browser")).otherwise(F.col("region")).alias("region"),
        F.when(rotated, F.col("os")).otherwise(F.col("city")).alias("city"),
        F.when(recent, ~F.col("is_bounce")).otherwise(F.col("is_bounce")).alias("is_bounce"),
        F.when(recent, F.col("engaged_ms") + F.lit(10**9)).otherwise(F.col("engaged_ms")).alias("engaged_ms"),
        F.when(recent & (v % 9 == 0), F.lit(0)).otherwise(F.col("pageviews")).cast("long").alias("pageviews"),
    )
    fixed = S.repair_sessions(broken, stamped(spark, d), END)
    wall = F.unix_millis("end_ts") - F.unix_millis("start_ts")
    return fixed.join(good.select("session_id", F.col("engaged_ms").alias("was")), "session_id").select(
        "session_id", "entry_path", "exit_path",
        F.when(F.col("engaged_ms") == wall, F.col("was")).otherwise(F.col("engaged_ms")).alias("engaged_ms"),
        "is_bounce", "device", "browser", "os", "region", "city",
    )


# -- F: web rollups ----------------------------------------------------------

@check("F11_web_rollup_minute", f"WITH {WEB} SELECT date_trunc('minute', ts) AS bucket, site_id, count(*) FILTER (WHERE event='pageview') AS pageviews, count(*) AS events FROM web WHERE NOT is_bot GROUP BY 1, 2")
def f11(spark, d):
    return WR.web_rollup_minute(A.web_events(spark, d))


def sql_daily(top: int, ranked_by: str = "day, site_id, dim", tie: str = "dim_value") -> str:
    arms = " UNION ALL ".join(
        f"""SELECT CAST(ts AS DATE) AS day, site_id, '{c}' AS dim, coalesce(nullif(trim({c}), ''), '(none)') AS dim_value,
        count(*) FILTER (WHERE event='pageview') AS pageviews, count(DISTINCT visitor_id) AS visitors, count(DISTINCT sid) AS sessions,
        count(DISTINCT CASE WHEN sid IN (SELECT session_id FROM ws WHERE is_bounce) THEN sid END) AS bounces,
        CAST(round(coalesce(sum(value) FILTER (WHERE event='engagement'), 0)) AS BIGINT) AS engaged_ms
        FROM we WHERE NOT is_bot GROUP BY 1, 2, 3, 4"""
        for c in WR.DIMENSIONS
    )
    sums = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in WR.MEASURES)
    return f"""WITH {WS}, arms AS ({arms}), ranked AS (SELECT *, row_number() OVER (PARTITION BY {ranked_by} ORDER BY pageviews DESC, {tie}) AS rn FROM arms)
SELECT CAST(day AS VARCHAR) AS day, site_id, dim, dim_value, {', '.join(WR.MEASURES)} FROM ranked WHERE rn <= {top}
UNION ALL SELECT CAST(day AS VARCHAR), site_id, dim, '(other)', {sums} FROM ranked WHERE rn > {top} GROUP BY day, site_id, dim"""


@check("F12_web_rollup_daily", sql_daily(5))
def f12(spark, d):
    return WR.web_rollup_daily(stamped(spark, d), visits(spark, d), top=5)


@check("F12_web_rollup_across_sites", sql_daily(4, "day, dim", "dim_value, site_id"))
def f12b(spark, d):
    return WR.web_rollup_daily(stamped(spark, d), visits(spark, d), top=4, across_sites=True)


# -- H: reports --------------------------------------------------------------

_STATS = {
    "pageviews": "count(*) FILTER (WHERE event='pageview')", "events": "count(*)",
    "visitors": "count(DISTINCT visitor_id)", "sessions": "count(DISTINCT sid)",
}


def _stat(metric, expr):
    @check(f"H3_stats_{metric}", f"WITH {WS} SELECT date_trunc('hour', ts) AS bucket, CAST({expr} AS DOUBLE) AS value FROM we WHERE {_EV} GROUP BY 1")
    def run(spark, d):
        return R.web_stats(metric, START, END, events=stamped(spark, d), interval="1h")


for _m, _e in _STATS.items():
    _stat(_m, _e)


@check("H3_stats_bounce_rate", f"WITH {WS} SELECT CAST(date_trunc('day', start_ts) AS TIMESTAMP) AS bucket, round(avg(CASE WHEN is_bounce THEN 1.0 ELSE 0.0 END), 4) AS value FROM ws WHERE {_SES} AND site_id='site-1' GROUP BY 1")
def h3b(spark, d):
    return R.web_stats("bounce_rate", START, END, events=stamped(spark, d), sessions=visits(spark, d), site="site-1")


@check("H3_stats_avg_duration", f"WITH {WS} SELECT CAST(date_trunc('day', start_ts) AS TIMESTAMP) AS bucket, round(avg(engaged_ms), 4) AS value FROM ws WHERE {_SES} GROUP BY 1")
def h3d(spark, d):
    return R.web_stats("avg_duration", START, END, events=stamped(spark, d), sessions=visits(spark, d))


def _label(c, default):
    return f"coalesce(nullif(trim({c}), ''), '{default}')"


DIMS = {
    "path": "path", "event": "event", "source": _label("source", "direct"), "medium": _label("medium", "none"),
    "country": _label("country", "unknown"), "region": _label("region", "unknown"), "city": _label("city", "unknown"),
    "screen": "coalesce(CAST(screen_w AS VARCHAR), 'unknown')", "utm_source": _label("utm_source", "(none)"),
    "utm_medium": _label("utm_medium", "(none)"), "utm_campaign": _label("utm_campaign", "(none)"),
    "device": _label("device", "unknown"), "browser": _label("browser", "unknown"), "os": _label("os", "unknown"),
}


def _dims_sql(where, limit, session_dims):
    parts = [
        f"""(SELECT '{k}' AS dim, coalesce({e}, '(none)') AS dim_value, count(*) FILTER (WHERE event='pageview') AS pageviews, count(DISTINCT visitor_id) AS visitors,
        count(DISTINCT sid) AS sessions FROM we WHERE {where} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT {limit})"""
        for k, e in DIMS.items()
    ]
    if session_dims:
        parts += [
            f"""(SELECT '{k}' AS dim, coalesce({c}, '(none)') AS dim_value, CAST(sum(pageviews) AS BIGINT) AS pageviews, count(DISTINCT visitor_id) AS visitors,
            count(DISTINCT session_id) AS sessions FROM ws WHERE {_SES} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT {limit})"""
            for k, c in R.SESSION_DIMENSIONS.items()
        ]
    return f"WITH {WS} " + " UNION ALL ".join(parts)


def _stack(parts):
    out = None
    for name, rows in parts:
        one = rows.select(F.lit(name).alias("dim"), "dim_value", "pageviews", "visitors", "sessions")
        out = one if out is None else out.unionByName(one)
    return out


@check("H4_breakdown", _dims_sql(_EV, 8, True))
def h4(spark, d):
    ev, ses = stamped(spark, d), visits(spark, d)
    names = [*R.EVENT_DIMENSIONS, *R.SESSION_DIMENSIONS]
    return _stack((k, R.breakdown(k, START, END, events=ev, sessions=ses, limit=8)) for k in names)


@check("H18_top_values", _dims_sql("ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31' AND NOT is_bot AND site_id='site-0'", 50, False))
def h18(spark, d):
    ev = stamped(spark, d)
    return _stack((k, R.top_values(k, START, END, ev, "site-0", 50)) for k in R.EVENT_DIMENSIONS)


@check("H5_realtime", f"""WITH {WEB}, n AS (SELECT * FROM web WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' AND ts <= TIMESTAMP '2024-01-31' AND {HUMAN})
SELECT 'visitors' AS kind, NULL AS value, count(DISTINCT visitor_id) AS hits FROM n
UNION ALL (SELECT 'page', coalesce(path, '(none)'), count(*) FROM n WHERE event='pageview' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
def h5(spark, d):
    return R.realtime(A.web_events(spark, d), END, minutes=720)


_VITALS = f"""v AS (SELECT name AS metric, coalesce(path, '(none)') AS path, coalesce(nullif(trim(device), ''), 'unknown') AS device,
  quantile_disc(value, 0.75) AS p75, count(*) AS samples,
  count(*) FILTER (WHERE value <= CASE name WHEN 'LCP' THEN 2500 WHEN 'INP' THEN 200 WHEN 'CLS' THEN 0.1 END)::DOUBLE / count(*) AS good_pct
  FROM web WHERE event='vital' AND {WEB_RANGE} AND NOT coalesce(is_internal, false) GROUP BY 1, 2, 3)"""


@check("H6_vitals", f"WITH {WEB}, {_VITALS} SELECT metric, path, device, round(p75, 6) AS p75, samples, round(good_pct, 6) AS good_pct FROM v")
def h6(spark, d):
    v = R.vitals(A.web_events(spark, d), START, END)
    return v.withColumns({"p75": F.round("p75", 6), "good_pct": F.round("good_pct", 6)})


@check("H7_vitals_overall", f"""WITH {WEB}, {_VITALS}, u AS (
  SELECT 'overall' AS scope, metric, NULL AS label, sum(p75 * samples) / sum(samples) AS p75, sum(good_pct * samples) / sum(samples) AS good_pct, CAST(sum(samples) AS BIGINT) AS samples FROM v GROUP BY 2
  UNION ALL SELECT 'device', metric, device, sum(p75 * samples) / sum(samples), sum(good_pct * samples) / sum(samples), CAST(sum(samples) AS BIGINT) FROM v GROUP BY 2, 3
  UNION ALL SELECT 'path', metric, path, p75, good_pct, samples FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY samples DESC, path, device) AS i FROM v WHERE path <> '(none)') WHERE i <= 5)
SELECT scope, metric, label, round(p75, 6) AS p75, round(good_pct, 6) AS good_pct, samples,
  CASE WHEN p75 <= CASE metric WHEN 'LCP' THEN 2500 WHEN 'INP' THEN 200 ELSE 0.1 END THEN 'Good'
       WHEN p75 <= CASE metric WHEN 'LCP' THEN 4000 WHEN 'INP' THEN 500 ELSE 0.25 END THEN 'Needs work' ELSE 'Poor' END AS status FROM u""")
def h7(spark, d):
    v = R.vitals_overall(R.vitals(A.web_events(spark, d), START, END))
    return v.withColumns({"p75": F.round("p75", 6), "good_pct": F.round("good_pct", 6)})


@check("H8_web_errors", f"""WITH {WEB} SELECT coalesce(name, '(unknown)') AS name, coalesce(path, '(none)') AS path, count(*) AS hits, max(ts) AS last_seen
FROM web WHERE event='error' AND {WEB_RANGE} AND NOT coalesce(is_internal, false) GROUP BY 1, 2 ORDER BY hits DESC, last_seen DESC, 1, 2 LIMIT 50""")
def h8(spark, d):
    return R.web_errors(A.web_events(spark, d), START, END)


@check("H9_sources", f"""WITH {WS}, s AS (SELECT coalesce(nullif(trim(medium), ''), 'direct') AS m, * FROM ws WHERE {_SES}),
dd AS (SELECT m, CAST(start_ts AS DATE) AS day, count(*) AS n FROM s GROUP BY 1, 2), dl AS (SELECT m, string_agg(day || '=' || n, ',' ORDER BY day) AS daily FROM dd GROUP BY 1)
SELECT m AS medium, count(*) AS sessions, count(DISTINCT visitor_id) AS visitors, round(avg(CASE WHEN is_bounce THEN 1.0 ELSE 0.0 END), 4) AS bounce_rate, any_value(daily) AS daily
FROM s JOIN dl USING (m) GROUP BY 1 ORDER BY sessions DESC, 1 LIMIT 20""")
def h9(spark, d):
    return R.sources(visits(spark, d), START, END, events=stamped(spark, d)).withColumn("daily", days())


def _page_list(kind, col):
    return f"""(SELECT '{kind}' AS kind, page, count(*) AS sessions, count(DISTINCT visitor_id) AS visitors, round(avg(CASE WHEN is_bounce THEN 1.0 ELSE 0.0 END), 4) AS bounce_rate,
  CAST(NULL AS BIGINT) AS pageviews, any_value(daily) AS daily FROM (SELECT coalesce(nullif(trim({col}), ''), '(none)') AS page, * FROM ws WHERE {_SES}) JOIN
  (SELECT page, string_agg(day || '=' || n, ',' ORDER BY day) AS daily FROM (SELECT coalesce(nullif(trim({col}), ''), '(none)') AS page, CAST(start_ts AS DATE) AS day, count(*) AS n FROM ws WHERE {_SES} GROUP BY 1, 2) GROUP BY 1) USING (page)
  GROUP BY 2 ORDER BY sessions DESC, page LIMIT 10)"""


@check("H10_pages", f"""WITH {WS}, pv AS (SELECT coalesce(nullif(trim(path), ''), '(none)') AS page, * FROM we WHERE event='pageview' AND {_EV})
{_page_list('entry', 'entry_path')} UNION ALL {_page_list('exit', 'exit_path')} UNION ALL
(SELECT 'top', page, count(DISTINCT sid), NULL, NULL, count(*), any_value(daily) FROM pv JOIN
  (SELECT page, string_agg(day || '=' || n, ',' ORDER BY day) AS daily FROM (SELECT page, CAST(ts AS DATE) AS day, count(*) AS n FROM pv GROUP BY 1, 2) GROUP BY 1) USING (page)
  GROUP BY 2 ORDER BY count(*) DESC, page LIMIT 10)""")
def h10(spark, d):
    return R.pages(stamped(spark, d), visits(spark, d), START, END, 10).withColumn("daily", days())


@check("H11_links_outbound", f"WITH {WEB} SELECT name AS host, path, count(*) AS hits FROM web WHERE event='outbound' AND {_EV} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def h11(spark, d):
    return R.links(A.web_events(spark, d), "outbound", START, END)


@check("H11_links_download", f"WITH {WEB} SELECT CAST(NULL AS VARCHAR) AS host, path, count(*) AS hits FROM web WHERE event='download' AND {_EV} GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 20")
def h11b(spark, d):
    return R.links(A.web_events(spark, d), "download", START, END)


@check("H12_funnel", f"""WITH {WS}, e AS (SELECT * FROM we WHERE {_EV} AND sid IS NOT NULL),
f0 AS (SELECT sid, min(ts) AS t FROM e WHERE path LIKE '/p/%' GROUP BY 1),
f1 AS (SELECT e.sid, min(e.ts) AS t FROM f0 JOIN e ON e.sid = f0.sid WHERE e.ts > f0.t AND event='custom' AND name LIKE '%u%' GROUP BY 1),
f2 AS (SELECT e.sid, min(e.ts) AS t FROM f1 JOIN e ON e.sid = f1.sid WHERE e.ts > f1.t AND event='outbound' AND name LIKE 'ext%.example.com' GROUP BY 1),
f3 AS (SELECT e.sid, min(e.ts) AS t FROM f2 JOIN e ON e.sid = f2.sid WHERE e.ts > f2.t AND path LIKE '/p/1%' GROUP BY 1),
c AS (SELECT 1 AS step, '/p/*' AS pattern, count(*) AS sessions FROM f0 UNION ALL SELECT 2, 'event:*u*', count(*) FROM f1
  UNION ALL SELECT 3, 'outbound:ext*.example.com', count(*) FROM f2 UNION ALL SELECT 4, '/p/1*', count(*) FROM f3),
r AS (SELECT *, round(sessions::DOUBLE / coalesce(lag(sessions) OVER (ORDER BY step), sessions), 4) AS conversion_from_prev, first(sessions) OVER (ORDER BY step) AS f FROM c)
SELECT CAST(step AS BIGINT) AS step, pattern, sessions, conversion_from_prev, round(1 - conversion_from_prev, 4) AS drop_off, round(sessions::DOUBLE / f, 4) AS overall_conversion FROM r""")
def h12(spark, d):
    steps = ["/p/*", "event:*u*", "outbound:ext*.example.com", "/p/1*"]
    return R.funnel(stamped(spark, d), steps, START, END)


@check("H13_custom_events", f"WITH {WEB} SELECT name, count(*) AS hits, count(DISTINCT visitor_id) AS visitors FROM web WHERE event='custom' AND name <> '' AND {_EV} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def h13(spark, d):
    return R.custom_events(A.web_events(spark, d), START, END)


@check("H14_web_summary", f"""WITH {WS} SELECT (SELECT count(*) FROM we WHERE event='pageview' AND {_EV}) AS pageviews,
  (SELECT CAST(sum(v) AS BIGINT) FROM (SELECT count(DISTINCT visitor_id) AS v FROM we WHERE {_EV} GROUP BY CAST(ts AS DATE))) AS visitors,
  count(*) AS sessions, round(avg(CASE WHEN is_bounce THEN 1.0 ELSE 0.0 END), 4) AS bounce_rate, round(avg(engaged_ms), 3) AS avg_duration_ms FROM ws WHERE {_SES}""")
def h14(spark, d):
    return R.web_summary(stamped(spark, d), visits(spark, d), START, END)


@check("H15_list_sessions", f"WITH {WS} SELECT session_id, start_ts, end_ts, entry_path, exit_path, pageviews, events, engaged_ms, is_bounce, source, medium, country, region, city, device, browser, os FROM ws WHERE {_SES} ORDER BY start_ts DESC, session_id LIMIT 200")
def h15(spark, d):
    return R.list_sessions(visits(spark, d), START, END, events=stamped(spark, d), limit=200)


@check("H16_session_events", f"""WITH {WS}, t AS (SELECT session_id FROM ws ORDER BY events DESC, session_id LIMIT 1)
SELECT ts, event, name, path, round(value, 6) AS value, source, medium, country, city, device, trace_id FROM we WHERE session_id IN (SELECT session_id FROM t) """)
def h16(spark, d):
    top = visits(spark, d).orderBy(F.desc("events"), "session_id").first()["session_id"]
    return R.session_events(stamped(spark, d), top).withColumn("value", F.round("value", 6))


@check("H17_site_totals", f"""WITH {WS}, dd AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event='pageview') AS pv FROM we WHERE NOT is_bot AND site_id='site-2' GROUP BY 1),
dv AS (SELECT CAST(ts AS DATE) AS day, device, count(DISTINCT visitor_id) AS v, count(DISTINCT sid) AS s FROM we WHERE NOT is_bot AND site_id='site-2' GROUP BY 1, 2)
SELECT (SELECT CAST(sum(pv) AS BIGINT) FROM dd) AS pageviews, (SELECT CAST(sum(v) AS BIGINT) FROM dv) AS visitors, (SELECT CAST(sum(s) AS BIGINT) FROM dv) AS sessions,
  round(avg(CASE WHEN is_bounce THEN 1.0 ELSE 0.0 END), 4) AS bounce_rate, round(avg(engaged_ms), 3) AS avg_engaged_ms,
  (SELECT string_agg(day || '=' || pv, ',' ORDER BY day) FROM dd) AS daily FROM ws WHERE site_id='site-2'""")
def h17(spark, d):
    ses = visits(spark, d)
    daily = WR.web_rollup_daily(stamped(spark, d), ses)
    return R.site_totals(daily, ses, START, END, "site-2").withColumn("daily", days(n="pageviews"))
