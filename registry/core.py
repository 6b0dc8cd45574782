"""Registration of a Spark query next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logspark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

START, END = datetime(2024, 1, 1), datetime(2024, 1, 31)
GAP = 12 * 3600


def plain(df: DataFrame) -> DataFrame:
    """Times without a zone, dates as text and whole numbers as BIGINT: types both engines share."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def check(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(prepare(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# -- SQL building blocks -----------------------------------------------------

EV = """ev AS (
  SELECT event_id AS event_key, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
  FROM events)"""


def sql_norm(x: str) -> str:
    """Error-text normalisation."""
    quoted = (
        "'\"[^\"\\n]*(?:(\")|(\\n)|\\z)|''[^''\\n]*(?:('')|(\\n)|\\z)'"
    )
    s = f"regexp_replace({x}, {quoted}, chr(1) || '\\1\\2\\3\\4', 'g')"
    s = f"regexp_replace({s}, chr(1) || '[\"'']', '''S', 'g')"
    s = f"regexp_replace({s}, chr(1) || '\\n', ' ', 'g')"
    s = f"replace({s}, chr(1), '')"
    s = f"trim(regexp_replace({s}, '[\\s\\v\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
    s = f"regexp_replace({s}, '\\b[0-9]+\\b', 'N', 'g')"
    return f"regexp_replace({s}, '\\b[0-9a-fA-F]{{8,}}\\b', 'H', 'g')"


def sql_tagged(tag: str, *parts: str) -> str:
    joined = " || chr(31) || ".join([f"'{tag}'", *parts])
    return f"substr(sha256({joined}), 1, 16)"


def sql_signed64(x: str) -> str:
    n = f"('0x' || substr(sha256({x}), 1, 16))::UBIGINT::HUGEINT"
    return f"CAST({n} - CASE WHEN {n} >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT)"


LOGS = (
    EV
    + """, logs0 AS (
  SELECT event_key, ts, ts + INTERVAL 2 SECOND AS insert_ts,
    'host-' || (user_id % 16) AS source_host, 'svc-' || (user_id % 8) AS service,
    CASE WHEN event_type='error' AND value > 150 THEN 'fatal' WHEN event_type='error' THEN 'error'
         WHEN value > 100 THEN 'warn' ELSE 'info' END AS level,
    CASE WHEN event_type='error' THEN 'Error in handler "h' || (k % 5) || '" code ' || (k % 3) || ' of step' || (k % 7) || ' user ' || user_id
         WHEN event_type='purchase' THEN 'checkout.amount'
         ELSE event_type || ' took ' || CAST(value AS VARCHAR) || ' ms on /p/' || (k % 20) END AS message,
    md5(user_id || '|' || CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT)) AS trace_id,
    lower(lpad(to_hex(event_key), 16, '0')) AS span_id,
    '{"duration_ms":' || CAST(value AS VARCHAR) || ',"event":"' || event_type || '","k":' || k
      || CASE WHEN event_type='purchase' THEN ',"value":' || CAST(value AS VARCHAR) ELSE '' END
      || CASE WHEN event_type='view' THEN ',"span_kind":"SPAN_KIND_SERVER","status_code":"STATUS_CODE_OK","parent_span_id":"p' || (k % 3) || '"' ELSE '' END
      || CASE WHEN event_type='error' THEN ',"exception_type":"E' || (k % 5) || '","stack":"at step ' || (k % 4) || ' of run"' ELSE '' END
      || '}' AS attributes,
    CASE user_id % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'US' WHEN 2 THEN 'ID' END AS geo_country,
    CASE event_type WHEN 'view' THEN 'otlp_span' WHEN 'purchase' THEN 'otlp_metric' ELSE 'http_json' END AS protocol,
    value AS duration_ms, k, event_type, user_id
  FROM ev), logs AS (
  SELECT *, length(message) + length(attributes) AS raw_len,
    CASE WHEN level IN ('error','fatal') THEN """
    + sql_tagged("m", "service", sql_norm("message"))
    + """ END AS fingerprint
  FROM logs0)"""
)

WEB = (
    EV
    + """, web0 AS (
  SELECT *, CASE WHEN event_type='view' THEN 'pageview'
      WHEN event_type='click' AND k < 50 THEN 'outbound' WHEN event_type='click' AND k < 70 THEN 'download'
      WHEN event_type='click' THEN 'engagement' WHEN event_type='error' THEN 'error'
      WHEN event_type='purchase' AND k >= 60 THEN 'vital' ELSE 'custom' END AS event FROM ev),
web AS (
  SELECT event_key, ts, ts + INTERVAL 2 SECOND AS insert_ts, 'site-' || (user_id % 3) AS site_id, event,
    CASE event WHEN 'outbound' THEN 'ext' || (k % 6) || '.example.com' WHEN 'custom' THEN event_type
      WHEN 'vital' THEN CASE k % 3 WHEN 0 THEN 'LCP' WHEN 1 THEN 'INP' ELSE 'CLS' END
      WHEN 'error' THEN 'E' || (k % 5) END AS name,
    CASE WHEN event IN ('pageview','error','vital') THEN '/p/' || (k % 20) WHEN event='outbound' THEN '/out/' || (k % 7)
      WHEN event='download' THEN '/files/' || (k % 4) || '.pdf' END AS path,
    CASE WHEN event='engagement' THEN value * 100 WHEN event='vital' AND k % 3 = 0 THEN value * 40
      WHEN event='vital' AND k % 3 = 1 THEN value * 4 WHEN event='vital' THEN value / 500 END AS value,
    user_id + 1 AS visitor_id, CASE WHEN user_id % 7 = 0 THEN user_id + 1000 END AS user_id,
    user_id % 29 = 0 AS is_internal, user_id % 23 = 0 AS is_bot, 320 * (1 + user_id % 5) AS screen_w,
    CASE WHEN k % 10 = 0 THEN 'mail' END AS utm_source, CASE WHEN k % 10 = 0 THEN 'email' END AS utm_medium,
    CASE WHEN k % 10 = 0 THEN 'c' || (k % 3) END AS utm_campaign,
    CASE user_id % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'direct' WHEN 2 THEN 'twitter' WHEN 3 THEN 'news' END AS source,
    CASE user_id % 5 WHEN 0 THEN 'organic' WHEN 1 THEN 'direct' WHEN 2 THEN 'social' WHEN 3 THEN ' ' END AS medium,
    CASE user_id % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'US' WHEN 2 THEN 'ID' END AS country,
    CASE user_id % 4 WHEN 0 THEN 'BE' WHEN 1 THEN 'CA' END AS region,
    CASE user_id % 4 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'Oakland' END AS city,
    CASE user_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device,
    CASE user_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' WHEN 2 THEN 'Safari' ELSE '' END AS browser,
    CASE user_id % 3 WHEN 0 THEN 'Windows' WHEN 1 THEN 'Android' ELSE 'iPadOS' END AS os,
    md5(user_id || '|' || CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT)) AS trace_id
  FROM web0)"""
)


def sql_sessions(gap: int = GAP) -> str:
    """Stamped events ``we`` and sessions ``ws`` by the textbook lag form."""
    return (
        WEB
        + f""", seq AS (
  SELECT *, lag(ts) OVER (PARTITION BY site_id, visitor_id ORDER BY ts, insert_ts, event_key) AS prev_ts
  FROM web WHERE NOT is_bot AND visitor_id <> 0),
marked AS (
  SELECT *, SUM(CASE WHEN prev_ts IS NULL OR date_diff('second', prev_ts, ts) > {gap} THEN 1 ELSE 0 END)
    OVER (PARTITION BY site_id, visitor_id ORDER BY ts, insert_ts, event_key ROWS UNBOUNDED PRECEDING) AS g
  FROM seq),
wss AS (
  SELECT site_id, visitor_id, g, min(ts) FILTER (WHERE event='pageview') AS start_ts, max(ts) AS end_ts,
    first(user_id ORDER BY ts, insert_ts, event_key) AS user_id,
    first(path ORDER BY ts, insert_ts, event_key) FILTER (WHERE path IS NOT NULL) AS entry_path,
    last(path ORDER BY ts, insert_ts, event_key) FILTER (WHERE path IS NOT NULL) AS exit_path,
    first(source ORDER BY ts, insert_ts, event_key) FILTER (WHERE event='pageview' AND source IS NOT NULL) AS source,
    first(medium ORDER BY ts, insert_ts, event_key) FILTER (WHERE event='pageview' AND medium IS NOT NULL) AS medium,
    first(country ORDER BY ts, insert_ts, event_key) AS country,
    first(region ORDER BY ts, insert_ts, event_key) AS region,
    first(city ORDER BY ts, insert_ts, event_key) AS city,
    first(device ORDER BY ts, insert_ts, event_key) AS device,
    first(browser ORDER BY ts, insert_ts, event_key) AS browser,
    first(os ORDER BY ts, insert_ts, event_key) AS os,
    bool_and(is_internal) AS is_internal,
    count(*) FILTER (WHERE event='pageview') AS pageviews, count(*) AS events,
    count(*) FILTER (WHERE event IN ('outbound','download','custom')) AS interactions,
    coalesce(sum(value) FILTER (WHERE event='engagement'), 0) AS engaged
  FROM marked GROUP BY ALL),
keyed AS (
  SELECT *, CASE WHEN start_ts IS NULL THEN 0 ELSE {sql_signed64("site_id || '|' || visitor_id || '|' || (epoch_us(start_ts) // 1000)")} END AS session_id FROM wss),
ws AS (
  SELECT session_id, site_id, visitor_id, user_id, is_internal, start_ts, end_ts, entry_path, exit_path,
    pageviews, events, least(CAST(round(engaged) AS BIGINT), (epoch_us(end_ts) // 1000) - (epoch_us(start_ts) // 1000)) AS engaged_ms,
    pageviews = 1 AND interactions = 0 AS is_bounce, source, medium, country, region, city, device, browser, os
  FROM keyed WHERE pageviews >= 1),
we AS (
  SELECT w.*, k.session_id AS session_id, nullif(k.session_id, 0) AS sid
  FROM web w LEFT JOIN marked m USING (event_key)
  LEFT JOIN keyed k ON m.site_id = k.site_id AND m.visitor_id = k.visitor_id AND m.g = k.g)"""
    )


RANGE = "ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31'"
WEB_RANGE = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'"
SES_RANGE = "start_ts >= TIMESTAMP '2024-01-01' AND start_ts < TIMESTAMP '2024-01-31'"
HUMAN = "NOT is_bot AND NOT coalesce(is_internal, false)"


def rollup_sql(unit: str, name: str) -> str:
    return f"""{name} AS (
  SELECT date_trunc('{unit}', ts) AS bucket, coalesce(service, '') AS service, coalesce(level, '') AS level,
    count(*) AS n, coalesce(quantile_disc(duration_ms, 0.5), 0) AS p50, coalesce(quantile_disc(duration_ms, 0.95), 0) AS p95,
    coalesce(quantile_disc(duration_ms, 0.99), 0) AS p99, CAST(coalesce(sum(raw_len), 0) AS BIGINT) AS bytes
  FROM logs GROUP BY 1, 2, 3)"""


R1M, R1H = rollup_sql("minute", "r1m"), rollup_sql("hour", "r1h")
