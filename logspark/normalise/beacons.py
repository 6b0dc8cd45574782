"""Browser beacons to web-event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logspark import schemas
from logspark.functions import json as J
from logspark.functions.hashing import user_hash, visitor_hash
from logspark.functions.text import blank_to_null, strip_space
from logspark.functions.web import (
    classify_referrer,
    classify_user_agent,
    origin_host,
    split_traceparent,
    split_url_utm,
)
from logspark.functions.json import items
from logspark.normalise.common import only

MAX_BEACON_BYTES = 16_384
MAX_EVENTS = 20
MAX_SITE, MAX_NAME, MAX_URL, MAX_REFERRER, MAX_PROPS = 64, 128, 2048, 2048, 4096
DAY_MS, HOUR_MS = 86_400_000.0, 3_600_000.0
KINDS = ["pageview", "custom", "outbound", "download", "engagement", "vital", "error"]
_NAME = r"^[A-Za-z0-9_\-.: /]+$"
_TRACEPARENT = r"^00-[0-9a-fA-F-]{32}-[0-9a-fA-F-]{16}-[0-9a-fA-F-]{2}$"


def _text(fields: Column, name: str) -> Column:
    return J.as_text(fields[name])


def _bad_event(e: Column) -> Column:
    return J.let(J.object_fields(e), _bad_fields)


def _bad_fields(e: Column) -> Column:
    blank = F.lit("")
    parts = {k: _text(e, k) for k in ("e", "r")} | {k: F.coalesce(_text(e, k), blank) for k in ("n", "u")} | {k: e[k] for k in ("v", "p")}
    return J.let(F.struct(*[c.alias(k) for k, c in parts.items()]), _bad_parts)


def _bad_parts(parts: Column) -> Column:
    kind, name, url, referrer, value, props = (parts[k] for k in ("e", "n", "u", "r", "v", "p"))
    blank = F.lit("")
    bad_name = (name != "") & ((F.octet_length(name) > MAX_NAME) | ~name.rlike(_NAME))
    bad_url = (url != "") & (
        ~F.startswith(url, F.lit("/")) | (F.octet_length(url) > MAX_URL) | F.contains(url, F.lit("\u0000"))
    )
    bad_referrer = F.octet_length(F.coalesce(referrer, blank)) > MAX_REFERRER
    bad_value = ~J.one_of(F.coalesce(J.kind(value), F.lit("null")), ["integer", "number", "null"])
    kind_of_props = F.coalesce(J.kind(props), F.lit("null"))
    bad_props = ~J.one_of(kind_of_props, ["object", "null"]) | (
        F.coalesce(F.octet_length(F.to_json(props)), F.lit(0)) > MAX_PROPS
    )
    good_kind = F.coalesce(J.one_of(strip_space(kind), KINDS), F.lit(False))
    return ~good_kind | bad_name | bad_url | bad_referrer | bad_value | bad_props


def validate_beacons(
    raw: DataFrame, max_bytes: int = MAX_BEACON_BYTES, max_events: int = MAX_EVENTS
) -> DataFrame:
    """Beacon bodies (``raw``) with ``reject_reason`` (NULL when accepted), ``site``, ``events``, ``tp``."""
    body = F.when(F.octet_length("raw").between(1, max_bytes), F.col("raw"))
    df = raw.withColumn("_b", J.object_fields(J.parse(body)))
    b = F.col("_b")
    df = df.withColumns({"_site": strip_space(_text(b, "s")), "_events": items(b["ev"]), "_tp": _text(b, "tp")})
    site, events, tp = F.col("_site"), F.col("_events"), F.col("_tp")
    reason = (
        F.when(site.isNull() | (site == "") | (F.octet_length(site) > MAX_SITE), "bad_payload")
        .when(events.isNull(), "bad_payload")
        .when((F.size(events) == 0) | (F.size(events) > max_events), "too_many_events")
        .when(F.exists(events, _bad_event), "bad_payload")
    )
    return df.select(
        *raw.columns, reason.alias("reject_reason"), site.alias("site"), events.alias("events"),
        F.when(tp.rlike(_TRACEPARENT), tp).alias("tp"),
    )


def envelopes(accepted: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Accepted beacons as envelopes; ``columns`` supplies ua, lang, origin, uid, cc, internal."""
    wanted = ["ua", "lang", "origin", "uid", "cc", "internal"]
    parts = {n: columns.get(n, F.lit(None)) for n in wanted}
    body = F.struct(
        F.lit(1).alias("v"), F.col("site"),
        *[c.alias(n) for n, c in parts.items()],
        F.col("events").alias("ev"), F.col("tp"),
    )
    return only(accepted, F.col("reject_reason").isNull()).select(
        "receive_ts", "source_addr", F.lit("web_event").alias("protocol"), F.to_json(body).alias("raw")
    )


def _clamped(v: Column, name: str, low: float, high: float) -> Column:
    return J.let(J.as_number(v[name]), lambda n: clamp_between(n, low, high))


def clamp_between(n: Column, low: float, high: float) -> Column:
    """NULL stays NULL (``greatest`` alone would skip it)."""
    return F.when(n < low, F.lit(low)).when(n > high, F.lit(high)).otherwise(n)


def explode_beacons(
    raw: DataFrame, salts: DataFrame, geo: DataFrame | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Envelopes to web-event rows, one per event.

    ``salts`` has one row per day (day, salt); the visitor hash uses the salt of the event's
    day and the address itself is not kept. With ``geo`` ranges the address decides the
    country and the edge code fills gaps.
    """
    env = raw.withColumns({"_v": J.object_fields(J.parse(F.col("raw")))})
    v = F.col("_v")
    agent = F.coalesce(_text(v, "ua"), F.lit(""))
    env = env.select(
        "receive_ts",
        F.trim("source_addr").alias("ip"),
        _text(v, "site").alias("site_id"),
        items(v["ev"]).alias("ev"),
        agent.alias("ua"),
        F.coalesce(origin_host(_text(v, "origin")), F.lit("")).alias("hostname"),
        user_hash(_text(v, "site"), _text(v, "uid")).alias("user_id"),
        split_traceparent(_text(v, "tp")).alias("trace"),
        F.coalesce(_text(v, "cc"), F.lit("")).alias("country"),
        F.coalesce(F.when(J.kind(v["internal"]) == "boolean",
                          F.try_variant_get(v["internal"], "$", "boolean")), F.lit(False)).alias("is_internal"),
        F.xxhash64("raw", "receive_ts", "source_addr").alias("envelope_key"),
    )
    env = only(env, F.col("site_id").isNotNull() & F.col("ev").isNotNull())
    env = env.withColumn("agent", classify_user_agent(F.col("ua")))
    if geo is not None:
        from logspark.normalise.enrich import geo_enrich

        options = {} if hot_rows is None else {"hot_rows": hot_rows}
        env = geo_enrich(env, geo, "ip", F.col("envelope_key"), edge_country="country", **options)
    else:
        none = F.lit(None).cast("string")
        env = env.withColumns({"region": none, "city": none})
    each = env.select("*", F.posexplode("ev").alias("nth", "e")).drop("ev")
    each = each.withColumn("e", J.object_fields(F.col("e")))
    e = F.col("e")
    each = only(each, _text(e, "e").isNotNull())
    behind = F.floor(F.coalesce(_clamped(e, "dt", 0.0, DAY_MS), F.lit(0.0)))
    each = each.withColumns(
        {
            "ts": F.timestamp_micros(F.unix_micros("receive_ts") - behind.cast("bigint") * 1000),
            "url": split_url_utm(F.coalesce(_text(e, "u"), F.lit(""))),
            "referrer": F.coalesce(_text(e, "r"), F.lit("")),
            "event": _text(e, "e"),
        }
    )
    each = each.withColumn(
        "via", classify_referrer(F.col("referrer"), F.col("url.utm"), F.col("hostname"))
    ).withColumn("day", F.to_date("ts"))
    salted = each.join(salts.select("day", "salt"), "day", "left")
    valid_ip = F.when(
        F.col("ip").rlike(r"^(\d{1,3}\.){3}\d{1,3}$|^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$"), F.col("ip")
    )
    visitor = F.when(
        F.col("salt").isNotNull(), visitor_hash(F.col("salt"), F.col("site_id"), valid_ip, F.col("ua"))
    ).otherwise(F.lit(0).cast("decimal(20,0)"))
    amount = J.as_number(e["v"])
    value = F.when(
        F.col("event") == "engagement", clamp_between(amount, 0.0, HOUR_MS)
    ).otherwise(amount)
    text = {
        "name": _text(e, "n"),
        "hostname": F.col("hostname"),
        "path": F.col("url.path"),
        "query": F.col("url.query"),
        "referrer": F.col("referrer"),
        "source": F.col("via.source"),
        "medium": F.col("via.medium"),
        "country": F.col("country"),
        "region": F.col("region"),
        "city": F.col("city"),
        "device": F.col("agent.device"),
        "browser": F.col("agent.browser"),
        "os": F.col("agent.os"),
        "trace_id": F.col("trace.trace_id"),
        "span_id": F.col("trace.span_id"),
    }
    rows = salted.select(
        "ts",
        F.col("receive_ts").alias("insert_ts"),
        "site_id",
        "event",
        value.alias("value"),
        F.col("url.utm").alias("utm"),
        visitor.alias("visitor_id"),
        F.lit(None).cast("long").alias("session_id"),
        "user_id",
        "is_internal",
        _clamped(e, "w", 0.0, 65535.0).cast("int").alias("screen_w"),
        F.col("agent.is_bot").alias("is_bot"),
        F.when(J.kind(e["p"]) == "object", F.to_json(e["p"])).alias("props"),
        F.xxhash64("envelope_key", "nth").alias("event_key"),
        *[blank_to_null(c).alias(n) for n, c in text.items()],
    )
    return schemas.conform(rows, schemas.WEB_EVENTS, ("event_key",))
