"""Search, rollups, traces, error groups, predicates."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from logspark.functions.text import (
    clean_label, glob_like, glob_match, message_fingerprint, normalise_error_text, variant_hash,
)
from logspark.functions.timestamps import bucket
from logspark.operators import errors as C, rollups as U, search as E, series as S, traces as G
from logspark.plans.predicates import compile_predicate
from logspark.plans.ranges import in_log_range, in_web_range
from logspark.sources import adapters as A, tiers
from registry.core import (
    END, HUMAN, LOGS, R1H, R1M, RANGE, START, WEB, WEB_RANGE, check, sql_norm, sql_tagged,
)

ERRORS = ["or", ["level", "=", "error"], ["level", "=", "fatal"]]


def where(df, spec):
    return compile_predicate(spec, df.schema)


# -- D: predicates -----------------------------------------------------------

_PICK = "event_key, service, level"


def _predicate(name: str, spec, condition: str, exact=False):
    @check(name, f"WITH {LOGS} SELECT {_PICK} FROM logs WHERE {condition}")
    def run(spark, d):
        logs = A.logs(spark, d)
        return logs.filter(compile_predicate(spec, logs.schema, exact=exact)).select("event_key", "service", "level")


_predicate("D1_equals", ["and", ["service", "=", "svc-3"], ["level", "!=", "info"]], "service = 'svc-3' AND level <> 'info'")
_predicate("D2_order", ["and", ["raw_len", ">", 80], ["raw_len", "<=", 140]], "raw_len > 80 AND raw_len <= 140")
_predicate("D3_substring", ["message", "~", "TOOK 1"], "message ILIKE '%TOOK 1%'")
_predicate("D4_wildcard", ["message", "=", "code % user"], "message ILIKE '%code % user%'")
_predicate("D5_text", ["text", "step_ user 1"], "message ILIKE '%step_ user 1%'")
_predicate(
    "D6_groups",
    ["or", ["and", ["level", "=", "error"], ["not", ["service", "=", "svc-1"]]],
     ["not", ["or", ["geo_country", "=", "DE"], ["raw_len", "<", 120]]]],
    "(level = 'error' AND service <> 'svc-1') OR NOT (geo_country = 'DE' OR raw_len < 120)",
)
_predicate("D7_known_columns", ["host", "=", "host-7"], "source_host = 'host-7'")


@check("D8_time_range", f"""WITH {LOGS}
SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06') AS closed,
       count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06') AS half_open FROM logs""")
def d8(spark, d):
    a, b = START + timedelta(days=4), START + timedelta(days=5)
    return A.logs(spark, d).agg(
        F.count_if(in_log_range(F.col("ts"), a, b)).alias("closed"),
        F.count_if(in_web_range(F.col("ts"), a, b)).alias("half_open"),
    )


@check("D9_glob", f"WITH {LOGS} SELECT service, count(*) AS n FROM logs WHERE service LIKE 'sv_-%' AND NOT service LIKE '%3' GROUP BY 1")
def d9(spark, d):
    s = F.col("service")
    return A.logs(spark, d).filter(glob_match(s, "sv?-*") & ~glob_match(s, "*3")).groupBy("service").agg(F.count("*").alias("n"))


@check("D14_glob_like", f"WITH {WEB} SELECT path, count(*) AS n FROM web WHERE path LIKE '/p/1%' GROUP BY 1")
def d14(spark, d):
    return A.web_events(spark, d).filter(F.col("path").like(glob_like("/p/1*"))).groupBy("path").agg(F.count("*").alias("n"))


@check("D15_labels", f"WITH {WEB} SELECT coalesce(nullif(trim(medium), ''), 'none') AS medium, coalesce(nullif(trim(browser), ''), 'unknown') AS browser, count(*) AS n FROM web GROUP BY 1, 2")
def d15(spark, d):
    return A.web_events(spark, d).groupBy(
        clean_label(F.col("medium"), "none").alias("medium"), clean_label(F.col("browser"), "unknown").alias("browser")
    ).agg(F.count("*").alias("n"))


# -- E: search ---------------------------------------------------------------

@check("E1_search_logs", f"""WITH {LOGS}, m AS (SELECT * FROM logs WHERE level IN ('error','fatal') AND {RANGE})
SELECT ts, service, level, message, fingerprint, attributes, raw_len, (SELECT count(*) FROM m) AS total_matched,
  (SELECT count(*) FROM m) > 150 AS truncated FROM m ORDER BY ts DESC, event_key DESC LIMIT 100 OFFSET 50""")
def e1(spark, d):
    logs = A.logs(spark, d)
    page = E.search_logs(logs, where(logs, ERRORS), START, END, 100, 50)
    return page.select("ts", "service", "level", "message", "fingerprint", "attributes", "raw_len", "total_matched", "truncated")


@check("E2_count_logs", f"WITH {LOGS} SELECT count(*) AS count FROM logs WHERE message ILIKE '%handler%' AND {RANGE}")
def e2(spark, d):
    logs = A.logs(spark, d)
    return E.count_logs(logs, where(logs, ["text", "handler"]), START, END)


@check("E3_recent_messages", f"WITH {LOGS} SELECT ts, service, level, message FROM logs WHERE message ILIKE '%took%' ORDER BY ts DESC, event_key DESC LIMIT 100")
def e3(spark, d):
    return E.recent_messages(A.logs(spark, d), "took", 100)


@check("E4_list_services", f"""WITH {LOGS}, r AS (SELECT service AS name, max(ts) AS last_seen, count(*) AS total FROM logs GROUP BY 1)
SELECT name, last_seen, total, (SELECT count(*) FROM r) AS registered FROM r WHERE name ILIKE '%SVC-%' ORDER BY last_seen DESC NULLS LAST, name LIMIT 5""")
def e4(spark, d):
    return E.list_services(U.service_totals(A.logs(spark, d)), "SVC-", 5)


@check("E5_query_all", f"""WITH {LOGS} SELECT event_key, ts, service, level FROM logs
WHERE duration_ms > 50 AND level = 'info' AND {RANGE}""")
def e5(spark, d):
    logs = A.logs(spark, d)
    cut = F.lit(START + timedelta(days=15))
    hot, cold = logs.filter(F.col("ts") >= cut), logs.filter(F.col("ts") < cut)
    both = tiers.union_tiers(hot, cold, {"event_key": logs.schema["event_key"].dataType})
    condition = "CAST(get_json_object(attributes, '$.duration_ms') AS DOUBLE) > 50 AND level = 'info'"
    return E.query_all(both, condition, START, END).select("event_key", "ts", "service", "level")


@check("E6_level_counts", f"WITH {LOGS}, {R1M} SELECT level, CAST(sum(n) AS BIGINT) AS n FROM r1m WHERE bucket >= TIMESTAMP '2024-01-01' GROUP BY 1")
def e6(spark, d):
    return E.level_counts(U.rollup_logs(A.logs(spark, d), "1m"), END, 30 * 24)


@check("E7_top_services", f"""WITH {LOGS} SELECT service, count(*) AS n, count(*) FILTER (WHERE level='error') AS errors FROM logs
WHERE ts >= TIMESTAMP '2024-01-01' AND raw_len > 70 GROUP BY 1 ORDER BY n DESC, service LIMIT 10""")
def e7(spark, d):
    logs = A.logs(spark, d)
    return E.top_services(logs, END, 30 * 24, where(logs, ["raw_len", ">", 70]))


@check("E8_pulse", f"""WITH {LOGS}, {R1M}, {R1H} SELECT
  CAST((SELECT coalesce(sum(n), 0) FROM r1m WHERE bucket >= TIMESTAMP '2024-01-30 23:57:00') AS BIGINT) AS logs_per_minute,
  (SELECT count(DISTINCT service) FROM r1h WHERE bucket >= TIMESTAMP '2024-01-29 23:58:00') AS active_services_24h""")
def e8(spark, d):
    logs = A.logs(spark, d)
    return E.pulse(U.rollup_logs(logs, "1m"), U.rollup_logs(logs, "1h"), END - timedelta(minutes=2))


@check("E9_window_summary", f"""WITH {LOGS}, m AS (SELECT * FROM logs WHERE {RANGE}),
s AS (SELECT service, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, service LIMIT 5)
SELECT count(*) AS total, count(*) FILTER (WHERE level='error') AS errors,
  round(count(*) FILTER (WHERE level='error')::DOUBLE / count(*), 6) AS error_rate,
  (SELECT string_agg(service || '=' || n, ',' ORDER BY n DESC, service) FROM s) AS top_services,
  printf('%.2f', count(*) FILTER (WHERE level='error')::DOUBLE / count(*) * 100) || ' % of all rows are errors' AS hints FROM m""")
def e9(spark, d):
    top = F.transform("top_services", lambda s: F.concat(s["service"], F.lit("="), s["n"].cast("string")))
    return E.window_summary(A.logs(spark, d), START, END).select(
        "total", "errors", F.round("error_rate", 6).alias("error_rate"),
        F.array_join(top, ",").alias("top_services"), F.array_join("hints", "|").alias("hints"),
    )


@check("E10_top_services_by_rollup", f"WITH {LOGS}, {R1M} SELECT service, CAST(sum(n) AS BIGINT) AS n FROM r1m GROUP BY 1 ORDER BY n DESC, service LIMIT 20")
def e10(spark, d):
    return E.top_services_by_rollup(U.rollup_logs(A.logs(spark, d), "1m"))


# -- F: rollups --------------------------------------------------------------

_ROLL = "bucket, service, level, n, p50, p95, p99, bytes"


@check("F1_rollup_minute", f"WITH {LOGS}, {R1M} SELECT {_ROLL} FROM r1m")
def f1(spark, d):
    return U.rollup_logs(A.logs(spark, d), "1m")


@check("F2_rollup_hour", f"WITH {LOGS}, {R1H} SELECT {_ROLL} FROM r1h")
def f2(spark, d):
    return U.rollup_logs(A.logs(spark, d), "1h")


@check("F1_rollup_exact", f"""WITH {LOGS} SELECT date_trunc('hour', ts) AS bucket, service, level, count(*) AS n,
  round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95,
  round(quantile_cont(duration_ms, 0.99), 6) AS p99, CAST(sum(raw_len) AS BIGINT) AS bytes FROM logs GROUP BY 1, 2, 3""")
def f1x(spark, d):
    r = U.rollup_logs(A.logs(spark, d), "1h", exact=True)
    return r.withColumns({p: F.round(p, 6) for p in U.FRACTIONS})


@check("F3_rollup_errors", f"WITH {LOGS} SELECT date_trunc('minute', ts) AS bucket, fingerprint, count(*) AS count FROM logs WHERE fingerprint IS NOT NULL GROUP BY 1, 2")
def f3(spark, d):
    return U.rollup_errors(A.logs(spark, d))


@check("F4_merge_services", f"WITH {LOGS} SELECT service AS name, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS total FROM logs GROUP BY 1")
def f4(spark, d):
    logs = A.logs(spark, d)
    cut = F.lit(START + timedelta(days=10))
    registry = U.merge_services(None, logs.filter(F.col("ts") < cut))
    return U.merge_services(registry, logs.filter(F.col("ts") >= cut))


@check("F5_volume_rollup", f"WITH {LOGS} SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM logs GROUP BY 1")
def f5a(spark, d):
    return U.volume(START, END, rollups={"1h": U.rollup_logs(A.logs(spark, d), "1h")})


@check("F5_volume_filtered", f"WITH {LOGS} SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM logs WHERE level IN ('error','fatal') GROUP BY 1")
def f5b(spark, d):
    logs = A.logs(spark, d)
    return U.volume(START, END, logs=logs, predicate=where(logs, ERRORS))


_RATE = "count(*) FILTER (WHERE level='error') AS errors, count(*) AS total, round(count(*) FILTER (WHERE level='error')::DOUBLE / count(*), 6) AS rate"


@check("F6_error_rate", f"WITH {LOGS} SELECT date_trunc('hour', ts) AS bucket, service, {_RATE} FROM logs GROUP BY 1, 2")
def f6(spark, d):
    r = U.error_rate(START, END, rollups={"1h": U.rollup_logs(A.logs(spark, d), "1h")}, by=("service",))
    return r.withColumn("rate", F.round("rate", 6))


@check("F6_error_rate_filtered", f"WITH {LOGS} SELECT date_trunc('hour', ts) AS bucket, {_RATE} FROM logs WHERE geo_country = 'DE' GROUP BY 1")
def f6b(spark, d):
    logs = A.logs(spark, d)
    r = U.error_rate(START, END, logs=logs, predicate=where(logs, ["geo_country", "=", "DE"]))
    return r.withColumn("rate", F.round("rate", 6))


@check("F7_latency", f"WITH {LOGS}, {R1H} SELECT bucket, service, max(p50) AS p50, max(p95) AS p95, max(p99) AS p99 FROM r1h WHERE p95 > 0 GROUP BY 1, 2")
def f7(spark, d):
    return U.latency(START, END, rollups={"1h": U.rollup_logs(A.logs(spark, d), "1h")})


@check("F7_latency_filtered", f"""WITH {LOGS} SELECT date_trunc('hour', ts) AS bucket, service, quantile_disc(duration_ms, 0.5) AS p50,
  quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99 FROM logs WHERE level <> 'info' GROUP BY 1, 2""")
def f7b(spark, d):
    logs = A.logs(spark, d)
    return U.latency(START, END, logs=logs, predicate=where(logs, ["level", "!=", "info"]))


@check("F8_metric_value", f"""WITH {LOGS}, {R1M}, r AS (SELECT * FROM r1m WHERE bucket >= TIMESTAMP '2024-01-01')
SELECT 'volume' AS metric, CAST(sum(n) AS DOUBLE) AS value FROM r
UNION ALL SELECT 'error_rate', round(sum(CASE WHEN level='error' THEN n ELSE 0 END)::DOUBLE / sum(n), 6) FROM r
UNION ALL SELECT 'p95_latency', round(sum(p95 * n) / sum(n), 6) FROM r
UNION ALL SELECT 'web_pageviews:site-1', CAST(count(*) FILTER (WHERE event='pageview' AND NOT is_bot) AS DOUBLE) FROM (WITH {WEB} SELECT * FROM web) WHERE site_id='site-1'""")
def f8(spark, d):
    from logspark.operators.web_rollups import web_rollup_minute

    rollup = U.rollup_logs(A.logs(spark, d), "1m")
    web = web_rollup_minute(A.web_events(spark, d))
    out = None
    for name in ("volume", "error_rate", "p95_latency", "web_pageviews:site-1"):
        one = U.metric_value(name, START, rollup, web)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("value", F.round("value", 6))


@check("F9_metric_series", f"""WITH {LOGS} SELECT date_trunc('hour', ts) AS bucket, round(avg(duration_ms), 6) AS value, count(*) AS n
FROM logs WHERE protocol='otlp_metric' AND message='checkout.amount' GROUP BY 1""")
def f9(spark, d):
    return U.metric_series(A.logs(spark, d), "checkout.amount", START, END).withColumn("value", F.round("value", 6))


@check("F10_buckets", """SELECT date_trunc('minute', ts) AS m1, time_bucket(INTERVAL '5 minutes', ts) AS m5,
  date_trunc('hour', ts) AS h1, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d1, count(*) AS n FROM events GROUP BY 1, 2, 3, 4""")
def f10(spark, d):
    ts = F.col("ts")
    return A.logs(spark, d).groupBy(
        bucket(ts, "1m").alias("m1"), bucket(ts, "5m").alias("m5"), bucket(ts, "1h").alias("h1"), bucket(ts, "1d").alias("d1")
    ).agg(F.count("*").alias("n"))


@check("F13_zero_fill", f"""WITH {LOGS}, b AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS bucket),
s AS (SELECT DISTINCT service FROM logs WHERE level='fatal'),
v AS (SELECT service, date_trunc('hour', ts) AS bucket, count(*) AS n FROM logs WHERE level='fatal' GROUP BY 1, 2)
SELECT service, bucket, coalesce(n, 0) AS n FROM s CROSS JOIN b LEFT JOIN v USING (service, bucket)""")
def f13(spark, d):
    v = A.logs(spark, d).filter("level = 'fatal'").groupBy("service", bucket(F.col("ts"), "1h").alias("bucket")).agg(F.count("*").alias("n"))
    return S.zero_fill(v, START, END, "1h", ("service",), "n")


@check("F14_compare_previous", f"""WITH {LOGS}, c AS (SELECT service,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-31') AS n,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-16') AS n_prev FROM logs GROUP BY 1)
SELECT service, n, n_prev, n - n_prev AS n_delta, round((n - n_prev) * 100.0 / n_prev, 6) AS n_change_pct FROM c""")
def f14(spark, d):
    logs, mid = A.logs(spark, d), START + timedelta(days=15)
    assert S.previous_range(mid, END) == (START, mid)

    def side(a, b):
        return logs.filter(in_web_range(F.col("ts"), a, b)).groupBy("service").agg(F.count("*").alias("n"))

    out = S.compare_previous(side(mid, END), side(START, mid), ["n"], ("service",))
    return out.withColumn("n_change_pct", F.round("n_change_pct", 6))


@check("F15_share_percent", f"""WITH {LOGS}, c AS (SELECT service, count(*) AS n FROM logs GROUP BY 1),
e AS (SELECT service, n, n::DOUBLE / (SELECT sum(n) FROM c) * 100 AS x FROM c),
r AS (SELECT service, n, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, service) AS i,
  100 - sum(floor(x)) OVER () AS rest FROM e)
SELECT service, n, CAST(f + CASE WHEN i <= rest THEN 1 ELSE 0 END AS BIGINT) AS percent FROM r""")
def f15(spark, d):
    c = A.logs(spark, d).groupBy("service").agg(F.count("*").alias("n"))
    return S.share_percent(c, "n", ["service"])


@check("F16_panel_number", f"""WITH {LOGS}, {R1H} SELECT 'volume' AS panel, CAST(count(*) AS DOUBLE) AS value FROM logs
UNION ALL SELECT 'error_rate', round(count(*) FILTER (WHERE level='error') * 100.0 / count(*), 6) FROM logs
UNION ALL SELECT 'latency', max(p95) FROM r1h UNION ALL SELECT 'count', CAST(count(*) AS DOUBLE) FROM logs WHERE level='fatal'""")
def f16(spark, d):
    logs = A.logs(spark, d)
    rollups = {"1h": U.rollup_logs(logs, "1h")}
    parts = {
        "volume": U.volume(START, END, rollups=rollups),
        "error_rate": U.error_rate(START, END, rollups=rollups),
        "latency": U.latency(START, END, rollups=rollups),
        "count": logs.filter("level = 'fatal'"),
    }
    out = None
    for kind, rows in parts.items():
        one = U.panel_number(kind, rows).select(F.lit(kind).alias("panel"), F.round("value", 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


# -- G: traces ---------------------------------------------------------------

@check("G1_list_traces", f"""WITH {LOGS} SELECT trace_id, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS span_count,
  count(*) FILTER (WHERE level='error') AS error_count, max(duration_ms) AS duration_ms, min(service) AS service, min(message) AS root_name
FROM logs WHERE protocol='otlp_span' AND {RANGE} GROUP BY 1""")
def g1(spark, d):
    return G.list_traces(A.logs(spark, d), START, END)



@check("G2_trace_spans", f"""WITH {LOGS}, t AS (SELECT trace_id FROM logs WHERE protocol='otlp_span' GROUP BY 1 ORDER BY count(*) DESC, trace_id LIMIT 1)
SELECT ts, service, level, message AS name, span_id, 'p' || (k % 3) AS parent_span_id, 'SPAN_KIND_SERVER' AS span_kind,
  'STATUS_CODE_OK' AS status_code, duration_ms FROM logs WHERE protocol='otlp_span' AND trace_id IN (SELECT trace_id FROM t)""")
def g2(spark, d):
    logs = A.logs(spark, d)
    busiest = logs.filter("protocol = 'otlp_span'").groupBy("trace_id").count().orderBy(F.desc("count"), "trace_id").first()
    return G.trace_spans(logs, busiest["trace_id"]).drop("attributes")


@check("G3_correlate_trace", f"""WITH {LOGS}, t AS (SELECT trace_id FROM logs GROUP BY 1 ORDER BY count(*) DESC, trace_id LIMIT 1),
w AS (SELECT * FROM (WITH {WEB} SELECT * FROM web) WHERE trace_id IN (SELECT trace_id FROM t)),
l AS (SELECT * FROM logs WHERE trace_id IN (SELECT trace_id FROM t))
SELECT 'web_event' AS kind, ts, site_id, event, name, path, country, device, NULL AS service, NULL AS level, NULL AS message FROM w
UNION ALL SELECT 'log', ts, NULL, NULL, NULL, NULL, NULL, NULL, service, level, message FROM l""")
def g3(spark, d):
    logs = A.logs(spark, d)
    busiest = logs.groupBy("trace_id").count().orderBy(F.desc("count"), "trace_id").first()
    return G.correlate_trace(A.web_events(spark, d), logs, busiest["trace_id"])


# -- C: errors ---------------------------------------------------------------

@check("C1_normalise_error_text", f"""SELECT 'doc' AS kind, doc_id AS id, 0 AS nth, md5({sql_norm('text')}) AS h FROM documents
UNION ALL SELECT 'conv', conv_id, turn, md5({sql_norm('text')}) FROM conversations""")
def c1(spark, d):
    h = F.md5(normalise_error_text(F.col("text"))).alias("h")
    docs = A.table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("nth"), h)
    conv = A.table(spark, d, "conversations").select(F.lit("conv").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("nth"), h)
    return docs.unionByName(conv)


@check("C2_fingerprint", f"""SELECT doc_id, {sql_tagged('m', 'source', sql_norm('text'))} AS message_fp,
  {sql_tagged('c', 'lang', 'source')} AS client_fp,
  {sql_tagged('s', 'lang', sql_norm('text'), 'source', "'run'", 'lang')} AS exception_fp FROM documents""")
def c2(spark, d):
    from logspark.functions.text import client_fingerprint, exception_fingerprint

    frames = F.array(F.struct(F.col("source").alias("module"), F.lit("run").alias("function"), F.col("lang").alias("filename")))
    return A.table(spark, d, "documents").select(
        "doc_id",
        message_fingerprint(F.col("source"), F.col("text")).alias("message_fp"),
        client_fingerprint(F.array("lang", "source")).alias("client_fp"),
        exception_fingerprint(F.col("lang"), F.col("text"), frames).alias("exception_fp"),
    )


@check("C3_variant_hash", f"SELECT doc_id, {sql_tagged('v', sql_norm('text'))} AS variant FROM documents")
def c3(spark, d):
    return A.table(spark, d, "documents").select("doc_id", variant_hash(F.col("text")).alias("variant"))


@check("C4_truncate_stack", """WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS p FROM documents),
c AS (SELECT doc_id, len(p) AS n, array_to_string(p[1:3], chr(10)) AS s FROM l)
SELECT doc_id, md5(substr(s, 1, 200)) AS h, n > 3 OR length(s) > 200 AS truncated FROM c""")
def c4(spark, d):
    from logspark.functions.text import truncate_stack

    return A.table(spark, d, "documents").select("doc_id", truncate_stack(F.col("text"), 3, 200).alias("t")).select(
        "doc_id", F.md5("t.stack").alias("h"), "t.truncated"
    )


def sql_fold(condition: str) -> str:
    """Error rows of a batch folded per fingerprint, one row per group."""
    vh = sql_tagged("v", sql_norm("'at step ' || (k % 4) || ' of run'"))
    return f"""SELECT fingerprint, first(service ORDER BY ts, event_key) AS service,
  CASE WHEN bool_or(level='fatal') THEN 'fatal' ELSE 'error' END AS level, first(message ORDER BY ts, event_key) AS title,
  first('E' || (k % 5) ORDER BY ts, event_key) AS exception_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n
FROM logs WHERE level IN ('error','fatal') AND {condition} GROUP BY 1""", f"""SELECT fingerprint, string_agg(vh, ',' ORDER BY i) AS variants FROM (
  SELECT fingerprint, vh, row_number() OVER (PARTITION BY fingerprint ORDER BY t, e) AS i FROM (
    SELECT fingerprint, {vh} AS vh, min(ts) AS t, arg_min(event_key, ts) AS e FROM logs WHERE level IN ('error','fatal') AND {condition} GROUP BY 1, 2))
  WHERE i <= 3 GROUP BY 1"""


_FOLD, _VARIANTS = sql_fold("true")
_OLD, _OLDV = sql_fold("ts < TIMESTAMP '2024-01-16'")
_NEW, _NEWV = sql_fold("ts >= TIMESTAMP '2024-01-16'")
MID = START + timedelta(days=15)


def variant_list(c="samples"):
    return F.array_join(F.transform(c, lambda s: s["variant_hash"]), ",")


def old_groups(spark, d):
    """Groups of the first half, every svc-2 group resolved."""
    logs = A.logs(spark, d)
    groups = C.new_groups(C.fold_error_groups(logs.filter(F.col("ts") < F.lit(MID))))
    changes = groups.filter("service = 'svc-2'").select(
        "fingerprint", F.lit("resolved").alias("status"), F.lit(MID).alias("at")
    )
    return C.set_group_status(groups, changes)


@check("C5_fold_error_groups", f"WITH {LOGS}, f AS ({_FOLD}), v AS ({_VARIANTS}) SELECT f.*, v.variants FROM f JOIN v USING (fingerprint)")
def c5(spark, d):
    return C.fold_error_groups(A.logs(spark, d)).select(
        "fingerprint", "service", "level", "title", "exception_type", "first_seen", "last_seen",
        F.col("count").alias("n"), variant_list().alias("variants"),
    )


_MERGE = f"""WITH {LOGS}, o AS ({_OLD}), n AS ({_NEW}), m AS (
SELECT coalesce(o.fingerprint, n.fingerprint) AS fingerprint, coalesce(o.service, n.service) AS service,
  CASE WHEN coalesce(o.level,'')='fatal' OR coalesce(n.level,'')='fatal' THEN 'fatal' ELSE 'error' END AS level,
  coalesce(o.title, n.title) AS title, least(o.first_seen, n.first_seen) AS first_seen, greatest(o.last_seen, n.last_seen) AS last_seen,
  coalesce(o.n, 0) + coalesce(n.n, 0) AS total_count,
  CASE WHEN o.service = 'svc-2' AND n.fingerprint IS NULL THEN 'resolved' ELSE 'unresolved' END AS status,
  CASE WHEN o.fingerprint IS NULL THEN 'created' WHEN o.service = 'svc-2' THEN 'regressed' ELSE 'updated' END AS transition,
  n.fingerprint IS NOT NULL AS hit, n.level AS new_level
FROM o FULL JOIN n ON o.fingerprint = n.fingerprint)"""


@check("C6_merge_error_groups", _MERGE + " SELECT fingerprint, service, level, title, first_seen, last_seen, total_count, status FROM m")
def c6(spark, d):
    fold = C.fold_error_groups(A.logs(spark, d).filter(F.col("ts") >= F.lit(MID)))
    merged = C.merge_error_groups(old_groups(spark, d), fold)
    return merged.select("fingerprint", "service", "level", "title", "first_seen", "last_seen", "total_count", "status")


@check("C7_group_transitions", _MERGE + " SELECT fingerprint, transition, total_count AS count FROM m WHERE hit")
def c7(spark, d):
    fold = C.fold_error_groups(A.logs(spark, d).filter(F.col("ts") >= F.lit(MID)))
    return C.group_transitions(old_groups(spark, d), fold).select("fingerprint", "transition", "count")


@check("C8_reconcile_groups", f"""WITH {LOGS}, o AS ({_OLD}), c AS (SELECT fingerprint, count(*) AS n, max(ts) AS t FROM logs WHERE fingerprint IS NOT NULL AND ts >= TIMESTAMP '2024-01-08' GROUP BY 1)
SELECT o.fingerprint, coalesce(c.n, o.n) AS total_count, coalesce(c.t, o.last_seen) AS last_seen FROM o LEFT JOIN c USING (fingerprint)""")
def c8(spark, d):
    retained = A.logs(spark, d).filter(F.col("ts") >= F.lit(START + timedelta(days=7)))
    return C.reconcile_groups(old_groups(spark, d), retained).select("fingerprint", "total_count", "last_seen")


@check("C9_list_groups", f"""WITH {LOGS}, f AS ({_FOLD}), m AS (SELECT * FROM f WHERE last_seen >= TIMESTAMP '2024-01-11' AND service = 'svc-3' AND (title ILIKE '%step%' OR exception_type ILIKE '%step%'))
SELECT fingerprint, title, n AS total_count, last_seen, (SELECT count(*) FROM m) AS total_matched FROM m ORDER BY n DESC, last_seen DESC, fingerprint LIMIT 5 OFFSET 1""")
def c9(spark, d):
    groups = C.new_groups(C.fold_error_groups(A.logs(spark, d)))
    page = C.list_groups(groups, END, 20 * 86400, service="svc-3", text="step", sort="count", limit=5, offset=1)
    return page.select("fingerprint", "title", "total_count", "last_seen", "total_matched")


@check("C10_group_detail", f"""WITH {LOGS}, f AS ({_FOLD}), v AS ({_VARIANTS}), g AS (SELECT * FROM f ORDER BY n DESC, fingerprint LIMIT 1),
s AS (SELECT date_trunc('minute', ts) AS b, count(*) AS c FROM logs WHERE fingerprint IN (SELECT fingerprint FROM g) GROUP BY 1)
SELECT fingerprint, title, n AS total_count, variants, (SELECT string_agg(strftime(b, '%Y-%m-%d %H:%M') || '=' || c, ',' ORDER BY b) FROM s) AS spark
FROM g JOIN v USING (fingerprint)""")
def c10(spark, d):
    logs = A.logs(spark, d)
    groups = C.new_groups(C.fold_error_groups(logs))
    top = groups.orderBy(F.desc("total_count"), "fingerprint").first()["fingerprint"]
    one = C.group_detail(groups, C.error_minutes(logs), top, END, 30 * 86400)
    points = F.transform("spark", lambda p: F.concat(F.date_format(p["ts"], "yyyy-MM-dd HH:mm"), F.lit("="), p["count"].cast("string")))
    return one.select("fingerprint", "title", "total_count", variant_list().alias("variants"), F.array_join(points, ",").alias("spark"))


@check("C11_set_group_status", f"""WITH {LOGS}, f AS ({_FOLD}) SELECT fingerprint, CASE WHEN service='svc-1' THEN 'resolved' WHEN service='svc-2' THEN 'ignored' ELSE 'unresolved' END AS status,
  CASE WHEN service='svc-1' THEN TIMESTAMP '2024-01-31' END AS resolved_at FROM f WHERE service <> 'svc-3'""")
def c11(spark, d):
    groups = C.new_groups(C.fold_error_groups(A.logs(spark, d)))
    status = F.when(F.col("service") == "svc-1", "resolved").when(F.col("service") == "svc-2", "ignored").when(F.col("service") == "svc-3", "deleted")
    changes = groups.select("fingerprint", status.alias("status"), F.lit(END).alias("at")).filter(F.col("status").isNotNull())
    return C.set_group_status(groups, changes).select("fingerprint", "status", "resolved_at")
