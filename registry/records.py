"""Normalisation jobs on raw records that Spark builds from the driver tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions import json as J
from logspark.functions.hashing import user_hash, visitor_hash
from logspark.functions.levels import normalise_level
from logspark.functions.timestamps import flexible_ts
from logspark.functions.web import (
    BOT_WORDS, REFERRER_GROUPS, UTM_MEDIUMS, classify_referrer, classify_user_agent, split_traceparent, split_url_utm,
)
from logspark.normalise import beacons as B, common as C, enrich as N, error_events as X, logs as L, otlp as O, shippers as H
from logspark.operators.errors import with_fingerprint
from logspark.session import checkpoint_dir
from logspark.sources import adapters as A, tiers
from registry.core import EV, check, sql_norm, sql_tagged

RECEIVED = datetime(2024, 2, 1)
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def ev(spark, d) -> DataFrame:
    return A._events(spark, d)


def s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def raw(df: DataFrame, body: Column, protocol: str = "http_json") -> DataFrame:
    """Raw records with the event key kept alongside, dealt to all cores: a file of small events may be one read task."""
    context = df.sparkSession.sparkContext
    return df.repartition(2 * context.defaultParallelism).select(
        "event_key", F.lit(RECEIVED).alias("receive_ts"), F.lit("10.9.8.7").alias("source_addr"),
        (protocol if isinstance(protocol, Column) else F.lit(protocol)).alias("protocol"), body.alias("raw"),
    )


def text(*parts) -> Column:
    """Concatenation; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else s(p) for p in parts])


def c(name: str) -> Column:
    return F.col(name)


KEY = ("event_key",)


def iso() -> Column:
    return F.date_format("ts", _ISO)


# -- A5, B1, B4: JSON ----------------------------------------------------------

@check("A5_split_bodies", """WITH b AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1),
l AS (SELECT conv_id, trim(unnest(string_split(body, chr(10)))) AS line FROM b)
SELECT md5(line) AS h, count(*) AS n FROM l WHERE line <> '' GROUP BY 1
UNION ALL SELECT md5('{"n":' || c_nationkey || ',"v":"' || c_mktsegment || '"}') AS h, 2 * count(*) FROM customer GROUP BY 1""")
def a5(spark, d):
    lines = A.table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("body")
    ).select("body")
    one = text('{"n":', c("c_nationkey"), ', "v":"', c("c_mktsegment"), '"}')
    lists = A.table(spark, d, "customer").select(text(" [", one, ", null, ", one, "]").alias("body"))
    bodies = lines.unionByName(lists).withColumn("receive_ts", F.lit(RECEIVED))
    return tiers.split_bodies(bodies).groupBy(F.md5("raw").alias("h")).agg(F.count("*").alias("n"))


@check("A5_landed_files", f"WITH {EV} SELECT event_key, event_type, date_trunc('second', TIMESTAMP '2024-02-01') AS receive_ts, 'http_json' AS protocol FROM ev")
def a5b(spark, d):
    """Bodies of many lines, a file each, as a request handler would land them."""
    root = f"{checkpoint_dir(spark)}/landed-{uuid.uuid4().hex}"
    line = text('{"id":', c("event_key"), ',"kind":"', c("event_type"), '"}')
    ev(spark, d).select(line.alias("value")).repartition(24).write.text(root)
    raw = tiers.read_landed_bodies(spark, root, datetime(2024, 2, 1))
    return raw.select(F.get_json_object("raw", "$.id").cast("long").alias("event_key"), F.get_json_object("raw", "$.kind").alias("event_type"), "receive_ts", "protocol")


_WORDS = ["trace", " INFO ", "Warning", "ERR", "critical", "F", "custom", "notice", "x" * 33, "W", "LOG", "fault"]
_LEVELS = ["debug", "info", "warn", "error", "fatal", "fatal", "custom", "info", "info", "warn", "info", "error"]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def sql_pick(values: list[str], index: str) -> str:
    return "(list_value(" + ", ".join(f"'{v}'" for v in values) + f"))[{index} + 1]"


@check("B1_normalise_json", f"""WITH {EV}, r AS (SELECT *, {sql_pick(_LEVELS, 'k % 12')} AS level, event_type || ' of ' || user_id AS message, 'svc-' || (user_id % 8) AS service FROM ev)
SELECT event_key, ts, 'host-' || (user_id % 4) AS source_host, service, level, message, 't' || (k % 50) AS trace_id, 's' || k AS span_id,
  '{{"k":' || k || ',"nested":{{"v":' || CAST(value AS VARCHAR) || '}}}}' AS attributes,
  CASE WHEN level IN ('error', 'fatal') THEN {sql_tagged('m', 'service', sql_norm('message'))} END AS fingerprint FROM r""")
def b1(spark, d):
    body = text(
        '{"@timestamp":"', iso(), '","host":"host-', c("user_id") % 4, '","logger":"svc-', c("user_id") % 8, '","severity":"',
        _pick(_WORDS, c("k") % 12), '","msg":"', c("event_type"), " of ", c("user_id"), '","k":', c("k"), ',"nested":{"v":', c("value"),
        '},"traceId":"t', c("k") % 50, '","span_id":"s', c("k"), '"}',
    )
    out = L.normalise_json(raw(ev(spark, d), body), keep=KEY)
    return out.select("event_key", "ts", "source_host", "service", "level", "message", "trace_id", "span_id",
                      _as_double_json(F.col("attributes")).alias("attributes"), "fingerprint")


def _as_double_json(attributes: Column) -> Column:
    """Whole doubles lose their ``.0`` as JSON numbers; put it back for the comparison."""
    return F.regexp_replace(attributes, r'"v":(\d+)\}', r'"v":$1.0}')


@check("B2_flexible_ts", f"""WITH {EV} SELECT event_key, CASE k % 6 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts)
 WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN ts - INTERVAL 2 HOUR END AS t FROM ev""")
def b2(spark, d):
    t = F.col("ts")
    shapes = [
        F.date_format(t, _ISO), F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.date_format(t, "yyyy/MM/dd HH:mm:ss"),
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"), F.date_format(t, "dd MMM yyyy"),
    ]
    return ev(spark, d).select("event_key", flexible_ts(F.element_at(F.array(*shapes), c("k") % 6 + 1)).alias("t"))


@check("B2_json_times", f"""WITH {EV} SELECT event_key, CASE k % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) + INTERVAL 500 MILLISECOND ELSE TIMESTAMP '2024-02-01' END AS ts FROM ev""")
def b2b(spark, d):
    seconds = F.unix_seconds("ts")
    value = F.when(c("k") % 3 == 0, s(seconds)).when(c("k") % 3 == 1, F.concat(s(seconds), F.lit(".5"))).otherwise('"soon"')
    return L.normalise_json(raw(ev(spark, d), text('{"time":', value, ',"msg":"m"}')), keep=KEY).select("event_key", "ts")


@check("B3_normalise_level", f"WITH {EV} SELECT event_key, {sql_pick(_LEVELS, 'k % 12')} AS level FROM ev")
def b3(spark, d):
    return ev(spark, d).select("event_key", normalise_level(_pick(_WORDS, c("k") % 12)).alias("level"))


@check("B3_number_level", f"WITH {EV} SELECT event_key, CASE WHEN k % 13 <= 2 THEN 'fatal' WHEN k % 13 <= 4 THEN 'error' WHEN k % 13 <= 6 THEN 'warn' WHEN k % 13 <= 10 THEN 'info' ELSE 'debug' END AS level FROM ev")
def b3b(spark, d):
    return L.normalise_json(raw(ev(spark, d), text('{"lvl":', c("k") % 13, ',"msg":"m"}')), keep=KEY).select("event_key", "level")


@check("B4_lift_message_json", f"""WITH {EV} SELECT event_key, CASE WHEN k % 2 = 0 THEN 'outer' ELSE 'inner' END AS service, 'warn' AS level,
  '{{"a":' || CASE WHEN k % 3 = 0 THEN '1' ELSE '2' END || ',"b":' || k || '}}' AS attributes, 'h' || (k % 4) AS source_host FROM ev""")
def b4(spark, d):
    inner = text('{\\"service\\":\\"inner\\",\\"level\\":\\"W\\",\\"hostname\\":\\"h', c("k") % 4, '\\",\\"a\\":2,\\"b\\":', c("k"), "}")
    body = text(
        "{", F.when(c("k") % 2 == 0, '"service":"outer",').otherwise(""), F.when(c("k") % 3 == 0, '"a":1,').otherwise(""),
        '"message":"', inner, '"}',
    )
    out = L.normalise_json(raw(ev(spark, d), body), keep=KEY)
    attrs = F.from_json("attributes", "a int, b int")
    return out.select("event_key", "service", "level", F.to_json(attrs).alias("attributes"), "source_host")


SPECS = tuple(C.promoted_spec(x) for x in ("user_id:bigint", "amount:double", "kind", "flag:boolean", "deep:varchar:$.ctx.route"))


@check("B5_promote", f"""WITH {EV} SELECT event_key, user_id, CASE k % 4 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN 1.0 END AS amount, event_type AS kind,
  CASE k % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' END AS flag, '/p/' || k AS deep, '{{"ctx":{{"route":"/p/' || k || '"}},"rest":1}}' AS attributes FROM ev""")
def b5(spark, d):
    k = c("k") % 4
    amount = F.when(k == 0, s("value")).when(k == 1, F.concat(F.lit('"'), s("value"), F.lit('"'))).when(k == 2, "true").otherwise("[1]")
    flag = F.when(k == 0, '"Yes"').when(k == 1, "0").when(k == 2, "true").otherwise('"maybe"')
    user = F.when(k == 3, F.concat(F.lit('"'), s("user_id"), F.lit('"'))).otherwise(s("user_id"))
    body = text('{"msg":"m","user_id":', user, ',"amount":', amount, ',"kind":"', c("event_type"), '","flag":', flag,
                ',"ctx":{"route":"/p/', c("k"), '"},"rest":1}')
    out = L.normalise_json(raw(ev(spark, d), body), SPECS, keep=KEY)
    return out.select("event_key", "user_id", "amount", "kind", s("flag").alias("flag"), "deep", "attributes")


@check("B6_drop_attributes", f"WITH {EV} SELECT event_key, 'svc' AS service, '{{\"keep\":' || k || '}}' AS attributes FROM ev")
def b6(spark, d):
    body = text('{"msg":"m","service":"svc","secret":"', c("user_id"), '","noise":[1,2],"keep":', c("k"), "}")
    out = L.normalise_json(raw(ev(spark, d), body), drop_keys=("secret", "noise", "service"), keep=KEY)
    return out.select("event_key", "service", "attributes")


# -- B7-B9: lines --------------------------------------------------------------

_SYS = ["fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug"]


@check("B7_normalise_syslog", f"""WITH {EV} SELECT event_key, CASE WHEN k % 2 = 0 THEN ts ELSE date_trunc('second', ts) END AS ts, 'host' || (user_id % 5) AS source_host, 'app' || (k % 3) AS service,
  {sql_pick(_SYS, 'k % 8')} AS level, event_type || ' at ' || value AS message, CAST(user_id AS VARCHAR) AS procid, CASE WHEN k % 2 = 0 THEN 'v]"' || k END AS sd FROM ev""")
def b7(spark, d):
    pri = text("<", 16 * 8 + c("k") % 8, ">")
    message = text(c("event_type"), " at ", c("value"))
    host, app = text("host", c("user_id") % 5), text("app", c("k") % 3)
    new = text(pri, "1 ", iso(), " ", host, " ", app, " ", c("user_id"), ' ID1 [ex@1 key="v\\]\\"', c("k"), '" other="x"] ', message)
    day = F.lpad(s(F.dayofmonth("ts")), 2, " ")
    old = text(pri, F.date_format("ts", "MMM"), " ", day, " ", F.date_format("ts", "HH:mm:ss"), " ", host, " ", app, "[", c("user_id"), "]: ", message)
    out = L.normalise_syslog(raw(ev(spark, d), F.when(c("k") % 2 == 0, new).otherwise(old), "syslog_udp"), keep=KEY)
    return out.select("event_key", "ts", "source_host", "service", "level", "message",
                      F.get_json_object("attributes", "$.syslog_procid").alias("procid"),
                      F.get_json_object("attributes", "$['syslog_sd_ex@1_key']").alias("sd"))


_TEXT_LEVEL = """CASE WHEN regexp_matches(lower(text), 'error|exception|traceback|failed|fatal') THEN 'error' WHEN contains(lower(text), 'warn') THEN 'warn'
  WHEN contains(lower(text), 'debug') THEN 'debug' ELSE 'info' END"""


@check("B8_normalise_text", f"""SELECT 'doc' AS kind, doc_id AS event_key, {_TEXT_LEVEL} AS level, md5(text) AS h, octet_length(encode(text)) AS raw_len FROM documents
UNION ALL SELECT 'conv', conv_id * 1000 + turn, {_TEXT_LEVEL}, md5(text), octet_length(encode(text)) FROM conversations""")
def b8(spark, d):
    docs = raw(A.table(spark, d, "documents").withColumn("event_key", c("doc_id")), c("text"))
    conv = raw(A.table(spark, d, "conversations").withColumn("event_key", c("conv_id") * 1000 + c("turn")), c("text"))
    out = None
    for kind, rows in (("doc", docs), ("conv", conv)):
        one = L.normalise_text(rows, keep=KEY).select(F.lit(kind).alias("kind"), "event_key", "level", F.md5("message").alias("h"), "raw_len")
        out = one if out is None else out.unionByName(one)
    return out


@check("B8_any_record", f"""WITH {EV} SELECT event_key, CASE k % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'app' END AS service, CASE k % 3 WHEN 0 THEN 'debug' WHEN 1 THEN 'error' ELSE 'warn' END AS level,
 CASE k % 3 WHEN 2 THEN '{{"level":"debug"}} some warning ' || k ELSE 'm' || k END AS message FROM ev""")
def b8b(spark, d):
    k = c("k") % 3
    body = F.when(k == 0, text('{"service":"json","level":"debug","msg":"m', c("k"), '"}')).when(
        k == 1, text("<3>Jan  2 03:04:05 box app: m", c("k"))
    ).otherwise(text('{"level":"debug"} some warning ', c("k")))
    protocol = F.when(k == 1, "syslog_tcp").otherwise("http_json")
    return L.normalise(raw(ev(spark, d), body, protocol), keep=KEY).select("event_key", "service", "level", "message")


@check("B9_apply_defaults", f"WITH {EV} SELECT event_key, CASE WHEN k % 2 = 0 THEN 'web' ELSE 'main' END AS service, CASE WHEN k % 3 = 0 THEN 'h' ELSE 'node' END AS source_host, CASE WHEN k % 5 = 0 THEN 'warn' ELSE 'info' END AS level FROM ev")
def b9(spark, d):
    k = c("k")
    rows = ev(spark, d).select(
        "event_key", F.when(k % 2 == 0, "web").otherwise("").alias("service"), F.when(k % 3 == 0, "h").alias("source_host"),
        F.when(k % 5 == 0, "warn").otherwise("").alias("level"),
    )
    return N.apply_defaults(rows, "main", "node")


# -- B10, B29: addresses -------------------------------------------------------

def _ranges(spark, d):
    n = A.table(spark, d, "nation").select(
        (c("n_nationkey").cast("long") * 131_072 + 167_772_160).alias("lo"), (c("n_nationkey").cast("long") * 131_072 + 167_772_160 + 131_071).alias("hi"),
        c("n_name").alias("country"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("city"),
    )
    p = A.table(spark, d, "supplier").select(
        (c("s_suppkey") * 4096 + 167_772_160).alias("lo"), (c("s_suppkey") * 4096 + 167_772_160 + 999).alias("hi"),
        F.concat(F.lit("S"), s(c("s_suppkey") % 7)).alias("country"), F.concat(F.lit("R"), s("s_suppkey")).alias("region"), c("s_name").alias("city"),
    )
    return n.unionByName(p)


_IP = "10.' || (k // 4) || '.' || (user_id % 256) || '.' || (k % 200)"
_RANGES = """rg AS (SELECT CAST(n_nationkey AS BIGINT) * 131072 + 167772160 AS lo, CAST(n_nationkey AS BIGINT) * 131072 + 167772160 + 131071 AS hi, n_name AS country, NULL AS region, NULL AS city FROM nation
 UNION ALL SELECT s_suppkey * 4096 + 167772160, s_suppkey * 4096 + 167772160 + 999, 'S' || (s_suppkey % 7), 'R' || s_suppkey, s_name FROM supplier)"""
_NUM = "(167772160 + (k // 4) * 65536 + (user_id % 256) * 256 + (k % 200))"


def _ip() -> Column:
    return text("10.", F.floor(c("k") / 4), ".", c("user_id") % 256, ".", c("k") % 200)


def _geo_sql():
    return f"""WITH {EV}, {_RANGES}, m AS (SELECT event_key, k, country, region, city, row_number() OVER (PARTITION BY event_key ORDER BY hi - lo, lo) AS i FROM ev JOIN rg ON {_NUM} BETWEEN lo AND hi)
SELECT ev.event_key, coalesce(m.country, CASE WHEN ev.k % 2 = 0 THEN 'ZZ' END) AS country, region, city FROM ev LEFT JOIN m ON ev.event_key = m.event_key AND i = 1"""


def _geo(spark, d, **options):
    rows = ev(spark, d).select("event_key", _ip().alias("addr"), F.when(c("k") % 2 == 0, "ZZ").otherwise("").alias("cc"))
    out = N.geo_enrich(rows, _ranges(spark, d), "addr", c("event_key"), edge_country="cc", **options)
    return out.select("event_key", "country", "region", "city")


@check("B10_geo_enrich", _geo_sql())
def b10(spark, d):
    return _geo(spark, d)


@check("B10_geo_enrich_hot", _geo_sql())
def b10b(spark, d):
    return _geo(spark, d, hot_rows=1)


_SIX = """a AS (SELECT event_key, k, user_id % 4096 AS u, event_key % 4 AS form FROM ev)"""


def _both_families(spark, d):
    """Addresses of both families, IPv6 in several spellings, and nested networks."""
    n, u, k = c("event_key") % 4, F.hex(c("user_id") % 4096), F.hex(c("k").cast("long"))
    wide = F.concat(F.lit("2001:0DB8:"), F.lpad(k, 4, "0"), F.lit(":0000:0:0:0:"), u)
    rows = ev(spark, d).select("event_key", F.when(n == 0, text("10.", c("k"), ".1.7")).when(n == 1, F.lower(text("2001:db8:", k, "::", u))).when(n == 2, wide).otherwise("2001:db8::zz").alias("addr"))
    nations, suppliers = A.table(spark, d, "nation"), A.table(spark, d, "supplier")
    key, sup = c("n_nationkey").cast("long"), c("s_suppkey").cast("long")
    none = F.lit(None).cast("string")
    networks = nations.select(text("10.", key, ".0.0/16").alias("cidr"), c("n_name").alias("country"), none.alias("region"), none.alias("city"))
    networks = networks.unionByName(nations.select(F.lower(text("2001:db8:", F.hex(key), "::/48")).alias("cidr"), c("n_name").alias("country"), none.alias("region"), none.alias("city")))
    small = suppliers.select(text("2001:DB8:", F.hex(sup % 25), "::", F.hex(sup * 16), "/124").alias("cidr"), text("S", sup % 7).alias("country"), text("R", sup).alias("region"), c("s_name").alias("city"))
    rest = spark.createDataFrame([("2001:db8::/32", "six", None, None), ("not a network", "x", None, None), ("10.0.0.0/40", "x", None, None)], networks.schema)
    return rows, networks.unionByName(small).unionByName(rest)


@check("B10_geo_networks", f"""WITH {EV}, {_SIX} SELECT event_key,
  CASE WHEN form IN (1, 2) AND s_suppkey IS NOT NULL THEN 'S' || (s_suppkey % 7) WHEN form <= 2 AND n_name IS NOT NULL THEN n_name WHEN form IN (1, 2) THEN 'six' END AS country,
  CASE WHEN form IN (1, 2) AND s_suppkey IS NOT NULL THEN 'R' || s_suppkey END AS region, CASE WHEN form IN (1, 2) THEN s_name END AS city
FROM a LEFT JOIN nation ON n_nationkey = k LEFT JOIN supplier ON s_suppkey = u // 16 AND s_suppkey % 25 = k""")
def b10c(spark, d):
    rows, networks = _both_families(spark, d)
    return N.geo_enrich(rows, networks, "addr", c("event_key")).select("event_key", "country", "region", "city")


@check("B29_flag_internal_networks", f"""WITH {EV}, {_SIX} SELECT event_key, CASE event_key % 3 WHEN 0 THEN form IN (1, 2) AND (k = 5 OR k = 6) WHEN 1 THEN form IN (1, 2) AND k < 16 AND u = 17 AND k = 3 OR form = 0 AND k < 8 ELSE false END AS is_internal FROM a""")
def b29b(spark, d):
    sites = spark.createDataFrame([("site-0", ["2001:db8:5::/48", "2001:db8:6:0::/64", "::/200"]), ("site-1", ["2001:DB8:3::11", "10.0.0.0/13", "1::2::3"]), ("site-2", None)], "id string, exclude_ips array<string>")
    rows = _both_families(spark, d)[0].withColumn("site_id", F.concat(F.lit("site-"), s(c("event_key") % 3)))
    return N.flag_internal(rows, sites, "addr", slice_by=c("event_key")).select("event_key", "is_internal")


@check("B29_flag_internal", f"WITH {EV} SELECT event_key, CASE user_id % 3 WHEN 0 THEN k // 4 BETWEEN 0 AND 3 WHEN 1 THEN k // 4 = 5 AND user_id % 256 = 7 AND k % 200 = 20 ELSE false END AS is_internal FROM ev")
def b29(spark, d):
    sites = spark.createDataFrame([("site-0", ["10.0.0.0/14", "bad"]), ("site-1", ["10.5.7.20"]), ("site-2", [])], "id string, exclude_ips array<string>")
    rows = ev(spark, d).select("event_key", F.concat(F.lit("site-"), s(c("user_id") % 3)).alias("site_id"), _ip().alias("addr"))
    return N.flag_internal(rows, sites, "addr", slice_by=c("event_key")).select("event_key", "is_internal")


# -- B11-B16: shippers ---------------------------------------------------------

@check("B11_normalise_gelf", f"""WITH {EV} SELECT event_key, date_trunc('second', ts) + INTERVAL 250 MILLISECOND AS ts, {sql_pick(_SYS, 'k % 8')} AS level, CASE WHEN k % 2 = 0 THEN 'box' || (k % 5) ELSE 'fac' END AS service,
  event_type AS message, 'h' || (user_id % 6) AS source_host, CAST(k AS VARCHAR) AS extra, CASE WHEN k % 3 = 0 THEN 'long ' || k END AS long_text FROM ev""")
def b11(spark, d):
    body = text(
        '{"version":"1.1","host":"h', c("user_id") % 6, '","short_message":"', c("event_type"), '","level":', c("k") % 8, ',"timestamp":', F.unix_seconds("ts"), '.25,',
        F.when(c("k") % 2 == 0, F.concat(F.lit('"_container_name":"/box'), s(c("k") % 5), F.lit('",'))).otherwise('"facility":"fac",'),
        F.when(c("k") % 3 == 0, F.concat(F.lit('"full_message":"long '), s("k"), F.lit('",'))).otherwise(""), '"_extra":', c("k"), "}",
    )
    out = H.normalise_gelf(raw(ev(spark, d), body, "gelf"), keep=KEY)
    return out.select("event_key", "ts", "level", "service", "message", "source_host", F.get_json_object("attributes", "$._extra").alias("extra"),
                      F.get_json_object("attributes", "$.full_message").alias("long_text"))


@check("B12_reassemble_chunks", """WITH l AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS seq FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, string_agg(l_partkey || ';', '' ORDER BY seq) AS payload FROM l WHERE total <= 128 GROUP BY 1, total HAVING total % 5 <> 0 OR false""")
def b12(spark, d):
    from pyspark.sql import Window as W

    lines = A.table(spark, d, "lineitem")
    per = W.partitionBy("l_orderkey")
    order = per.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    parts = lines.select(
        s("l_orderkey").alias("msg_id"), (F.row_number().over(order) - 1).alias("seq"), F.count("*").over(per).cast("int").alias("total"),
        F.concat(s("l_partkey"), F.lit(";")).alias("payload"),
    )
    lost = (c("total") % 5 == 0) & (c("seq") == 0)
    sent = parts.filter(~lost)
    return H.reassemble_chunks(sent.unionByName(sent.filter("seq = 1")))


@check("B13_normalise_hec", f"""WITH {EV}, two AS (SELECT *, unnest([0, 1]) AS part FROM ev)
SELECT event_key, CASE WHEN part = 0 THEN date_trunc('second', ts) + INTERVAL 500 MILLISECOND ELSE TIMESTAMP '2024-02-01' END AS ts, CASE WHEN part = 0 THEN 'st' || (k % 4) ELSE 'c' || (k % 3) END AS service,
 CASE WHEN part = 1 AND k % 2 = 0 THEN 'error' ELSE 'info' END AS level, CASE WHEN part = 0 THEN 'line ' || k ELSE 'a }} {{ b ' || k END AS message, CASE WHEN part = 1 THEN 'tag' || k END AS tag FROM two""")
def b13(spark, d):
    first = text('{"event":"line ', c("k"), '","time":"', F.unix_seconds("ts"), '.500000","sourcetype":"st', c("k") % 4, '","index":"main"}')
    second = text('{"event":{"line":"a } { b ', c("k"), '","source":"', F.when(c("k") % 2 == 0, "stderr").otherwise("stdout"), '","tag":"tag', c("k"),
                  '"},"fields":{"container_name":"/c', c("k") % 3, '"}}')
    out = H.normalise_hec(raw(ev(spark, d), text(first, "\n ", second), "splunk_hec"), keep=KEY)
    return out.select("event_key", "ts", "service", "level", "message", F.get_json_object("attributes", "$.tag").alias("tag"))


@check("B14_normalise_forward", f"""WITH {EV}, two AS (SELECT *, unnest(CASE WHEN k % 2 = 0 THEN [0] ELSE [0, 1] END) AS part FROM ev)
SELECT event_key, date_trunc('second', ts) + INTERVAL 1 SECOND * part AS ts, CASE WHEN k % 2 = 0 THEN 'c' || (k % 3) ELSE 'tag.' || (k % 7) END AS service, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'error' ELSE 'info' END AS level,
 'm' || part AS message, 'tag.' || (k % 7) AS tag FROM two""")
def b14(spark, d):
    sec = F.unix_seconds("ts")
    single = text('["tag.', c("k") % 7, '",', sec, ',{"log":"m0","source":"', F.when(c("k") % 3 == 0, "stderr").otherwise("stdout"), '","container_name":"/c', c("k") % 3, '"}]')
    batch = text('["tag.', c("k") % 7, '",[[', sec, ',{"message":"m0"}],[', sec + 1, ',{"msg":"m1"}]],{"chunk":"x"}]')
    out = H.normalise_forward(raw(ev(spark, d), F.when(c("k") % 2 == 0, single).otherwise(batch), "fluentd"), keep=KEY)
    return out.select("event_key", "ts", "service", "level", "message", F.get_json_object("attributes", "$.fluentd_tag").alias("tag"))


@check("B15_normalise_k8s_audit", f"""WITH {EV} SELECT event_key, ts, 'get apps/pods ns' || (k % 3) || '/p' || k || ' → ' || (200 + (k % 4) * 100) AS message,
 CASE WHEN k % 11 = 0 THEN 'fatal' WHEN k % 4 = 3 THEN 'error' WHEN k % 4 = 2 THEN 'warn' ELSE 'info' END AS level, 'a' || event_key AS trace_id, '2.2.2.' || (k % 9) AS source_host FROM ev WHERE k % 7 <> 1 OR k % 11 = 0""")
def b15(spark, d):
    stage = F.when(c("k") % 11 == 0, "Panic").when(c("k") % 7 == 1, "RequestReceived").otherwise("ResponseComplete")
    one = text('{"auditID":"a', c("event_key"), '","stage":"', stage, '","verb":"get","level":"Metadata","requestURI":"/x","objectRef":{"apiGroup":"apps","resource":"pods","namespace":"ns', c("k") % 3,
               '","name":"p', c("k"), '"},"responseStatus":{"code":', 200 + (c("k") % 4) * 100, '},"sourceIPs":["1.1.1.1","2.2.2.', c("k") % 9, '"],"stageTimestamp":"', iso(), '"}')
    body = F.when(c("k") % 3 == 0, one).when(c("k") % 3 == 1, text("[", one, "]")).otherwise(text('{"kind":"EventList","items":[', one, "]}"))
    out = H.normalise_k8s_audit(raw(ev(spark, d), body, "k8s_audit"), ("RequestReceived",), keep=KEY)
    return out.select("event_key", "ts", "message", "level", "trace_id", "source_host")


@check("B16_normalise_container_lines", f"""WITH {EV} SELECT event_key, CASE WHEN k % 2 = 0 THEN ts ELSE TIMESTAMP '2024-02-01' END AS ts, event_type || ' ran' AS message, CASE WHEN k % 3 = 0 THEN 'error' ELSE 'info' END AS level,
 'web-' || (k % 5) AS service, 'n' || (user_id % 3) AS source_host FROM ev WHERE k % 5 <> 4""")
def b16(spark, d):
    line = F.when(c("k") % 2 == 0, text(iso(), " ", c("event_type"), " ran")).otherwise(text(c("event_type"), " ran"))
    rows = raw(ev(spark, d), line, "k8s_api").join(
        ev(spark, d).select("event_key", F.concat(F.lit("web-"), s(c("k") % 5)).alias("pod"), F.when(c("k") % 3 == 0, "stderr").otherwise("stdout").alias("stream"),
                            F.concat(F.lit("n"), s(c("user_id") % 3)).alias("node")), "event_key")
    out = H.normalise_container_lines(rows, include=("web-*",), exclude=("*-4",), keep=KEY)
    return out.select("event_key", "ts", "message", "level", "service", "source_host")


# -- B17-B20: telemetry --------------------------------------------------------

def nanos(ts: str = "ts") -> Column:
    return F.unix_micros(ts) * 1000


def resource(records: str, scopes: str, inner: Column) -> Column:
    return text('{"', records, '":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc-', c("user_id") % 8,
                '"}},{"key":"zone","value":{"intValue":"', c("user_id") % 3, '"}}]},"', scopes, '":[{"scope":{"name":"lib"},', inner, "}]}]}")


@check("B17_normalise_otlp_spans", f"""WITH {EV} SELECT 'svc-' || (user_id % 8) AS service, ts, event_type AS message, CASE WHEN event_type='error' THEN 'error' ELSE 'info' END AS level, lpad(lower(to_hex(event_key)), 16, 'a') AS span_id,
 round(CASE WHEN k % 10 = 0 THEN 0 ELSE value END, 3) AS duration_ms, CASE WHEN k % 2 = 0 THEN 'SPAN_KIND_SERVER' ELSE 'SPAN_KIND_CLIENT' END AS kind, CAST(user_id % 3 AS VARCHAR) AS zone, '[1,"x"]' AS list, CAST(k AS VARCHAR) AS nested FROM ev""")
def b17(spark, d):
    end = F.when(c("k") % 10 == 0, F.lit(5)).otherwise(nanos() + F.round(c("value") * 1_000_000).cast("long"))
    inner = text('"spans":[{"traceId":"AB","spanId":"', F.lpad(F.lower(F.hex("event_key")), 16, "A"), '","name":"', c("event_type"), '","kind":', F.when(c("k") % 2 == 0, '"SPAN_KIND_SERVER"').otherwise("3"),
                 ',"startTimeUnixNano":"', nanos(), '","endTimeUnixNano":"', end, '","status":{"code":', F.when(c("event_type") == "error", "2").otherwise('"STATUS_CODE_OK"'),
                 '},"attributes":[{"key":"list","value":{"arrayValue":{"values":[{"intValue":1},{"stringValue":"x"}]}}},{"key":"m","value":{"kvlistValue":{"values":[{"key":"k","value":{"intValue":"', c("k"), '"}}]}}}]}]')
    out = O.normalise_spans(raw(ev(spark, d), resource("resourceSpans", "scopeSpans", inner), "otlp_span"))
    at = lambda p: F.get_json_object("attributes", p)
    return out.select("service", "ts", "message", "level", "span_id", F.round(at("$.duration_ms").cast("double"), 3).alias("duration_ms"), at("$.span_kind").alias("kind"), at("$.zone").alias("zone"),
                      at("$.list").alias("list"), at("$.m.k").alias("nested"))


_SEV = ["info", "debug", "debug", "debug", "debug", "debug", "debug", "debug", "debug", "info", "info", "info", "info", "warn", "warn", "warn", "warn", "error", "error", "error", "error", "fatal", "fatal", "fatal", "fatal"]


@check("B18_normalise_otlp_logs", f"""WITH {EV} SELECT CASE WHEN k % 2 = 0 THEN ts ELSE ts + INTERVAL 1 SECOND END AS ts, {sql_pick(_SEV, 'k % 25')} AS level, CASE WHEN k % 3 = 0 THEN '{{"a":' || k || '}}' ELSE 'text ' || k END AS message, 'e' || event_key AS event_name FROM ev""")
def b18(spark, d):
    when = F.when(c("k") % 2 == 0, text('"timeUnixNano":"', nanos(), '"')).otherwise(text('"observedTimeUnixNano":"', nanos() + 1_000_000_000, '"'))
    content = F.when(c("k") % 3 == 0, text('{"kvlistValue":{"values":[{"key":"a","value":{"intValue":', c("k"), "}}]}}")).otherwise(text('{"stringValue":"text ', c("k"), '"}'))
    inner = text('"logRecords":[{', when, ',"severityNumber":', c("k") % 25, ',"body":', content, ',"eventName":"e', c("event_key"), '"}]')
    out = O.normalise_otlp_logs(raw(ev(spark, d), resource("resourceLogs", "scopeLogs", inner), "otlp_log"))
    return out.select("ts", "level", "message", F.get_json_object("attributes", "$.event_name").alias("event_name"))


_KIND = ["gauge", "sum", "histogram", "exponential_histogram", "summary"]


@check("B19_normalise_otlp_metrics", f"""WITH {EV} SELECT ts, 'm' || event_key AS message, {sql_pick(_KIND, 'k % 5')} AS kind, round(CASE k % 5 WHEN 0 THEN k WHEN 4 THEN 7 ELSE value END, 4) AS value,
 CASE k % 5 WHEN 1 THEN 'cumulative' WHEN 2 THEN 'delta' WHEN 3 THEN 'unspecified' END AS mode, 'ms' AS unit FROM ev""")
def b19(spark, d):
    time = text('"timeUnixNano":"', nanos(), '"')
    k = c("k") % 5
    data = (
        F.when(k == 0, text('"gauge":{"dataPoints":[{', time, ',"asInt":"', c("k"), '"}]}'))
        .when(k == 1, text('"sum":{"isMonotonic":true,"aggregationTemporality":2,"dataPoints":[{', time, ',"asDouble":', c("value"), "}]}"))
        .when(k == 2, text('"histogram":{"aggregationTemporality":"AGGREGATION_TEMPORALITY_DELTA","dataPoints":[{', time, ',"count":"3","sum":', c("value"), "}]}"))
        .when(k == 3, text('"exponentialHistogram":{"dataPoints":[{', time, ',"count":3,"sum":', c("value"), "}]}"))
        .otherwise(text('"summary":{"dataPoints":[{', time, ',"count":7,"sum":0}]}'))
    )
    inner = text('"metrics":[{"name":"m', c("event_key"), '","unit":"ms",', data, "}]")
    out = O.normalise_otlp_metrics(raw(ev(spark, d), resource("resourceMetrics", "scopeMetrics", inner), "otlp_metric"))
    at = lambda p: F.get_json_object("attributes", p)
    return out.select("ts", "message", at("$.metric_type").alias("kind"), F.round(at("$.value").cast("double"), 4).alias("value"), at("$.aggregation_temporality").alias("mode"), at("$.unit").alias("unit"))


@check("B20_otlp_enums", f"WITH {EV} SELECT event_key, CAST(k % 6 AS BIGINT) AS kind, CASE WHEN k % 3 = 2 THEN NULL ELSE CAST(k % 24 + 1 AS BIGINT) END AS severity FROM ev")
def b20(spark, d):
    kind = F.when(c("k") % 2 == 0, s(c("k") % 6)).otherwise(_pick(O.SPAN_KINDS, c("k") % 6))
    severity = F.when(c("k") % 3 == 0, s(c("k") % 24 + 1)).when(c("k") % 3 == 1, F.concat(F.lit("SEVERITY_NUMBER_"), _pick(O.SEVERITIES, c("k") % 24 + 1))).otherwise("LOUD")
    return ev(spark, d).select("event_key", O.enum_number(kind, O.SPAN_KINDS).alias("kind"), O.enum_number(severity, O.SEVERITIES, "SEVERITY_NUMBER_").alias("severity"))


# -- B21: exceptions -----------------------------------------------------------

@check("B21_normalise_error_events", f"""WITH {EV}, r AS (SELECT *, 'E' || (k % 5) AS t, 'bad id ' || user_id || ' in "x"' AS v FROM ev)
SELECT event_key, ts, 'shop' AS service, CASE k % 3 WHEN 0 THEN 'warn' WHEN 1 THEN 'fatal' ELSE 'error' END AS level, t || ': ' || v AS message,
 CASE WHEN k % 4 = 0 THEN {sql_tagged('c', "'own'", 't')} ELSE {sql_tagged('s', 't', sql_norm('v'), "'m'", "'f'", "'a.py'")} END AS fingerprint,
 t || ': ' || v || chr(10) || 'lib @ /lib.py:9' || chr(10) || 'm.f @ a.py:' || k || ' #' AS stack FROM r""")
def b21(spark, d):
    level = _pick(["warning", "critical", "odd"], c("k") % 3)
    frames = text('{"frames":[{"module":"m","function":"f","filename":"a.py","lineno":', c("k"), ',"in_app":true},{"function":"lib","abs_path":"/lib.py","lineno":9}]}')
    own = F.when(c("k") % 4 == 0, text('"fingerprint":["own","E', c("k") % 5, '"],')).otherwise("")
    body = text('{"level":"', level, '",', own, '"timestamp":"', iso(), '","exception":{"values":[{"type":"E', c("k") % 5, '","value":"bad id ', c("user_id"), ' in \\"x\\"","stacktrace":', frames,
                '},{"type":"Last","value":"none"}]},"tags":{"k":"', c("k"), '"}}')
    out = X.normalise_error_events(raw(ev(spark, d), body, "sentry"), F.lit("p1"), {"p1": "shop"}, keep=KEY)
    return out.select("event_key", "ts", "service", "level", "message", "fingerprint", F.get_json_object("attributes", "$.stack").alias("stack"))


@check("C2_with_fingerprint", f"""SELECT doc_id, CASE WHEN quality = 1 THEN 'given' ELSE {sql_tagged('m', 'source', sql_norm('text'))} END AS fingerprint FROM documents JOIN labels USING (doc_id)""")
def c2b(spark, d):
    rows = A.table(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id").select(
        "doc_id", c("source").alias("service"), c("text").alias("message"), F.lit("error").alias("level"), F.when(c("quality") == 1, "given").alias("fingerprint"))
    return with_fingerprint(rows).select("doc_id", "fingerprint")


# -- B22-B28: beacons ----------------------------------------------------------

def _beacon() -> Column:
    k = c("k")
    bad = F.when(k % 9 == 1, '{"e":"zap"}').when(k % 9 == 2, '{"e":"custom","n":"a<b"}').when(k % 9 == 3, '{"e":"pageview","u":"no-slash"}').when(
        k % 9 == 4, '{"e":"vital","v":"x"}').when(k % 9 == 5, '{"e":"custom","p":[1]}').otherwise(
        text('{"e":"pageview","u":"/p/', k, '?utm_source=News&x=', k % 3, '&UTM_Medium=email","r":"https://www.google.com/s","w":70000},{"e":"engagement","v":9000000,"dt":', k * 100, "}"))
    body = text('{"s":"shop","ev":[', bad, "]}")
    return F.when(k % 17 == 0, "").when(k % 19 == 0, '{"s":"shop","ev":[]}').when(k % 23 == 0, '{"ev":[{"e":"pageview"}]}').otherwise(body)


@check("B22_validate_beacons", f"""WITH {EV} SELECT event_key, CASE WHEN k % 17 = 0 THEN 'bad_payload' WHEN k % 19 = 0 THEN 'too_many_events' WHEN k % 23 = 0 THEN 'bad_payload' WHEN k % 9 BETWEEN 1 AND 5 THEN 'bad_payload' END AS reject_reason FROM ev""")
def b22(spark, d):
    return B.validate_beacons(raw(ev(spark, d), _beacon(), "web_event")).select("event_key", "reject_reason")


@check("B23_explode_beacons", f"""WITH {EV}, a AS (SELECT *, unnest([0, 1]) AS part FROM ev WHERE k % 17 <> 0 AND k % 19 <> 0 AND k % 23 <> 0 AND NOT k % 9 BETWEEN 1 AND 5)
SELECT CASE WHEN part = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-02-01' - INTERVAL 1 MILLISECOND * (k * 100) END AS ts, 'shop' AS site_id, CASE WHEN part = 0 THEN 'pageview' ELSE 'engagement' END AS event,
 CASE WHEN part = 0 THEN '/p/' || k END AS path, CASE WHEN part = 0 THEN 'x=' || (k % 3) END AS query, CASE WHEN part = 0 THEN 'News' ELSE 'direct' END AS source, CASE WHEN part = 0 THEN 'email' ELSE 'direct' END AS medium,
 CASE WHEN part = 1 THEN 3600000.0 END AS value, CASE WHEN part = 0 THEN 65535 END AS screen_w, 'ID' AS country, 'mobile' AS device, 'Safari' AS browser, 'iOS' AS os, count(*) AS n FROM a GROUP BY ALL""")
def b23(spark, d):
    checked = B.validate_beacons(raw(ev(spark, d), _beacon(), "web_event"))
    env = B.envelopes(checked, {"ua": F.lit("Mozilla/5.0 (iPhone) Safari/604"), "origin": F.lit("https://shop.example"), "cc": F.lit("ID")})
    salts = spark.createDataFrame([(datetime(2024, 2, 1).date(), "pepper"), (datetime(2024, 1, 31).date(), "salt")], "day date, salt string")
    keys = ["ts", "site_id", "event", "path", "query", "source", "medium", "value", "screen_w", "country", "device", "browser", "os"]
    return B.explode_beacons(env, salts).groupBy(*keys).agg(F.count("*").alias("n"))


_URL = "regexp_replace(url, '^https?://[^/]+', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=s' || page_id || '&&UTM_Campaign=c&utm_odd=1&utm_medium=&z'"


@check("B24_split_url_utm", f"""WITH u AS (SELECT page_id, {_URL} AS u FROM pages), q AS (SELECT page_id, string_split(u, '?')[1] AS path, substr(u, position('?' IN u) + 1) AS q FROM u),
p AS (SELECT page_id, path, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')) AS kept FROM q)
SELECT page_id, path, array_to_string(kept, '&') AS query, 's' || page_id AS source, NULL AS medium, 'c' AS campaign FROM p""")
def b24(spark, d):
    url = F.concat(F.regexp_replace("url", "^https?://[^/]+", ""), F.when(F.contains(c("url"), F.lit("?")), "&").otherwise("?"),
                   F.lit("utm_source=s"), s("page_id"), F.lit("&&UTM_Campaign=c&utm_odd=1&utm_medium=&z"))
    return A.table(spark, d, "pages").select("page_id", split_url_utm(url).alias("u")).select(
        "page_id", "u.path", "u.query", c("u.utm")["source"].alias("source"), c("u.utm")["medium"].alias("medium"), c("u.utm")["campaign"].alias("campaign"))


_REFS = ["https://www.google.com/search", "https://gemini.google.com/app", "https://t.co/x", "https://news.ycombinator.com/", "", "chatgpt.com/c/1", "https://example.org/a"]


def _referrer_sql():
    host = "lower(string_split(CASE WHEN contains(r, '://') THEN substr(r, position('://' IN r) + 3) ELSE r END, '/')[1])"
    src = " ".join(f"WHEN contains(h, '{f}') THEN '{n}'" for _, hosts in REFERRER_GROUPS for f, n in hosts.items())
    med = " ".join(f"WHEN {' OR '.join(f'''contains(h, '{f}')''' for f in hosts)} THEN '{g}'" for g, hosts in REFERRER_GROUPS)
    marks = ", ".join(f"'{m}'" for m in UTM_MEDIUMS)
    return f"""WITH a AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE {sql_pick(_REFS, 'page_id % 7')} END AS r, CASE WHEN page_id % 5 = 0 THEN 'Mail' END AS us,
 CASE page_id % 10 WHEN 0 THEN 'email' WHEN 5 THEN 'banner' END AS um FROM pages), b AS (SELECT *, {host} AS h FROM a)
SELECT page_id, CASE WHEN us IS NOT NULL THEN us WHEN r = '' OR h = 'example.org' THEN 'direct' {src} ELSE left(h, 128) END AS source,
 CASE WHEN us IS NOT NULL THEN CASE WHEN um IN ({marks}) THEN um ELSE 'campaign' END WHEN r = '' OR h = 'example.org' THEN 'direct' {med} ELSE 'referral' END AS medium FROM b"""


@check("B25_classify_referrer", _referrer_sql())
def b25(spark, d):
    p = c("page_id")
    ref = F.when(p % 3 == 0, c("url")).otherwise(_pick(_REFS, (p % 7).cast("int")))
    medium = F.when(p % 10 == 0, "email").when(p % 10 == 5, "banner")
    utm = F.when(p % 5 == 0, F.map_filter(F.create_map(F.lit("source"), F.lit("Mail"), F.lit("medium"), medium), lambda _, v: v.isNotNull()))
    return A.table(spark, d, "pages").select("page_id", classify_referrer(ref, utm, F.lit("EXAMPLE.org")).alias("x")).select("page_id", "x.source", "x.medium")


_AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0) AppleWebKit Chrome/120 Safari/537 Edg/120", "desktop", "Edge", "Windows"),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17 like Mac OS X) CriOS/120 Mobile Safari", "mobile", "Chrome", "iOS"),
    ("Mozilla/5.0 (iPad; CPU OS 17 like Mac OS X) Version/17 Safari", "tablet", "Safari", "iPadOS"),
    ("Mozilla/5.0 (Linux; Android 14; Pixel) Chrome/120 Mobile Safari", "mobile", "Chrome", "Android"),
    ("Mozilla/5.0 (Linux; Android 14; Tab) SamsungBrowser/20 Chrome/110 Safari", "tablet", "Samsung Internet", "Android"),
    ("Mozilla/5.0 (X11; CrOS x86_64) Chrome/120 Safari OPR/90", "desktop", "Opera", "ChromeOS"),
    ("Mozilla/5.0 (X11; Linux x86_64) Firefox/120", "desktop", "Firefox", "Linux"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Version/17 Safari", "desktop", "Safari", "macOS"),
    ("Mozilla/5.0 Trident/7.0 Windows NT", "desktop", "IE", "Windows"),
    ("Mozilla/5.0 (compatible; SomeBot/2.1)", "bot", "", ""),
    ("curl/8.0", "bot", "", ""),
    ("", "", "", ""),
]


@check("B26_classify_user_agent", f"""WITH {EV} SELECT event_key, {sql_pick([a[1] for a in _AGENTS], 'k % 12')} AS device, {sql_pick([a[2] for a in _AGENTS], 'k % 12')} AS browser,
 {sql_pick([a[3] for a in _AGENTS], 'k % 12')} AS os, k % 12 IN (9, 10) AS is_bot FROM ev""")
def b26(spark, d):
    agent = _pick([a[0] for a in _AGENTS], c("k") % 12)
    return ev(spark, d).select("event_key", classify_user_agent(agent).alias("u")).select("event_key", "u.device", "u.browser", "u.os", "u.is_bot")


@check("B27_hashes", f"""WITH {EV} SELECT event_key, lpad(lower(to_hex(('0x' || substr(sha256('salt' || strftime(ts, '%d') || '|shop|10.0.0.' || (user_id % 9) || '|ua' || (k % 3)), 1, 16))::UBIGINT)), 16, '0') AS visitor,
 CASE WHEN k % 2 = 0 THEN substr(sha256('cl-user-v1|shop|u' || user_id), 1, 16) END AS person FROM ev""")
def b27(spark, d):
    visitor = visitor_hash(F.concat(F.lit("salt"), F.date_format("ts", "dd")), F.lit("shop"), F.concat(F.lit("10.0.0."), s(c("user_id") % 9)), F.concat(F.lit("ua"), s(c("k") % 3)))
    person = user_hash(F.lit("shop"), F.when(c("k") % 2 == 0, F.concat(F.lit("u"), s("user_id"))).otherwise(""))
    as_hex = lambda n: F.lower(F.lpad(F.conv(n.cast("string"), 10, 16), 16, "0"))
    return ev(spark, d).select("event_key", as_hex(visitor).alias("visitor"), as_hex(person).alias("person"))


@check("B28_split_traceparent", f"WITH {EV} SELECT event_key, CASE WHEN k % 3 = 0 THEN md5('t' || k) ELSE '' END AS trace_id, CASE WHEN k % 3 = 0 THEN left(md5('s' || k), 16) ELSE '' END AS span_id FROM ev")
def b28(spark, d):
    t, p = F.upper(F.md5(F.concat(F.lit("t"), s("k")))), F.substring(F.md5(F.concat(F.lit("s"), s("k"))), 1, 16)
    header = F.when(c("k") % 3 == 0, text("00-", t, "-", p, "-01")).when(c("k") % 3 == 1, text("01-", t, "-", p, "-01")).otherwise(text(t, "-", p))
    return ev(spark, d).select("event_key", split_traceparent(header).alias("x")).select("event_key", "x.trace_id", "x.span_id")
