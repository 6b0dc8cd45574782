"""Traces, logs and metrics of the open telemetry JSON encoding.

Bodies are read with typed schemas whose leaves are text, because the encoding allows numbers
and enums to come as numbers or as text. Each body is exploded resource by resource, scope by
scope and record by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions import json as J
from logspark.functions.levels import normalise_level
from logspark.functions.text import blank_to_null
from logspark.normalise.common import Promoted, as_input, log_rows

UNKNOWN_SERVICE = "unknown_service"
# Enum names by number.
SPAN_KINDS = [
    "SPAN_KIND_UNSPECIFIED", "SPAN_KIND_INTERNAL", "SPAN_KIND_SERVER", "SPAN_KIND_CLIENT",
    "SPAN_KIND_PRODUCER", "SPAN_KIND_CONSUMER",
]
STATUS_CODES = ["STATUS_CODE_UNSET", "STATUS_CODE_OK", "STATUS_CODE_ERROR"]
TEMPORALITIES = [
    "AGGREGATION_TEMPORALITY_UNSPECIFIED", "AGGREGATION_TEMPORALITY_DELTA",
    "AGGREGATION_TEMPORALITY_CUMULATIVE",
]
TEMPORALITY_WORDS = ["unspecified", "delta", "cumulative"]
SEVERITIES = ["UNSPECIFIED"] + [
    word + (str(i) if i > 1 else "")
    for word in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
    for i in range(1, 5)
]
_LEVEL_BY_BAND = ["debug", "debug", "info", "warn", "error", "fatal"]


# -- values ----------------------------------------------------------------

_SCALARS = "stringValue string, boolValue string, intValue string, doubleValue string, bytesValue string"
DEPTH = 2


def _value_type(depth: int) -> str:
    """A tagged value; below ``depth`` nested lists stay JSON text."""
    if depth == 0:
        return f"struct<{_SCALARS}, arrayValue string, kvlistValue string>"
    inner = _value_type(depth - 1)
    return (
        f"struct<{_SCALARS}, arrayValue struct<values: array<{inner}>>, "
        f"kvlistValue struct<values: array<struct<key string, value {inner}>>>>"
    )


ATTRS = f"array<struct<key string, value {_value_type(DEPTH)}>>"
SPAN = (
    "struct<traceId string, spanId string, parentSpanId string, traceState string, name string, "
    "kind string, startTimeUnixNano string, endTimeUnixNano string, "
    f"status struct<code string, message string>, attributes {ATTRS}, "
    f"events array<struct<name string, timeUnixNano string, attributes {ATTRS}>>>"
)
LOG_RECORD = (
    "struct<timeUnixNano string, observedTimeUnixNano string, severityNumber string, "
    "severityText string, eventName string, traceId string, spanId string, "
    f"body {_value_type(DEPTH)}, attributes {ATTRS}>"
)
_POINT = (
    f"struct<timeUnixNano string, attributes {ATTRS}, asDouble string, asInt string, count string, "
    "sum string, min string, max string>"
)
_DATA = f"struct<dataPoints array<{_POINT}>, isMonotonic string, aggregationTemporality string>"
METRIC = (
    f"struct<name string, unit string, description string, metadata {ATTRS}, gauge {_DATA}, "
    f"sum {_DATA}, histogram {_DATA}, exponentialHistogram {_DATA}, summary {_DATA}>"
)


def whole(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), c.try_cast("decimal(20,0)").try_cast("bigint"))


def real(c: Column) -> Column:
    return c.try_cast("double")


def enum_number(c: Column, names: list[str], prefix: str = "") -> Column:
    """An enum given by number or by name."""
    at = F.array_position(F.array(*[F.lit(prefix + n) for n in names]), c)
    return F.coalesce(c.try_cast("int"), F.when(at > 0, (at - 1).cast("int")))


def enum_name(code: Column, names: list[str]) -> Column:
    return F.when(code >= 0, F.get(F.array(*[F.lit(n) for n in names]), code))


def nanos_ts(n: Column) -> Column:
    return F.when(n > 0, F.timestamp_micros(F.call_function("div", n, F.lit(1000))))


def any_value(v: Column, depth: int = DEPTH) -> Column:
    """A tagged value as plain JSON."""
    scalar = [
        v["stringValue"].cast("variant"),
        v["boolValue"].try_cast("boolean").cast("variant"),
        whole(v["intValue"]).cast("variant"),
        real(v["doubleValue"]).cast("variant"),
        v["bytesValue"].cast("variant"),
    ]
    if depth == 0:
        lists = [F.try_parse_json(v["arrayValue"]), F.try_parse_json(v["kvlistValue"])]
    else:
        lists = [
            F.to_variant_object(F.transform(v["arrayValue"]["values"], lambda x: any_value(x, depth - 1))),
            F.to_variant_object(key_values(v["kvlistValue"]["values"], depth - 1)),
        ]
    return F.coalesce(*scalar, *lists)


def key_values(pairs: Column, depth: int = DEPTH) -> Column:
    """``[{key, value}]`` as MAP<STRING, VARIANT>; the last of equal keys wins, blank keys go."""
    named = F.filter(pairs, lambda p: F.coalesce(p["key"], F.lit("")) != "")
    return F.map_from_entries(
        F.transform(
            named,
            lambda p: F.struct(
                p["key"].alias("key"),
                F.coalesce(any_value(p["value"], depth), F.parse_json(F.lit("null"))).alias("value"),
            ),
        )
    )


def _fields(*maps: Column) -> Column:
    """Later maps win."""
    out = maps[0]
    for m in maps[1:]:
        out = J.merge(m, out)
    return out


# -- unfolding -------------------------------------------------------------


def unfold(raw: DataFrame, resources: str, scopes: str, records: str, record_type: str) -> DataFrame:
    """One row per record with its service and the attributes of resource and scope."""
    scope_type = f"struct<scope: struct<name string, version string, attributes {ATTRS}>, {records}: array<{record_type}>>"
    schema = f"{resources} array<struct<resource: struct<attributes {ATTRS}>, {scopes}: array<{scope_type}>>>"
    body = as_input(raw).withColumn("v", F.from_json("raw", schema))
    kept = ["receive_ts", "source_addr", "protocol", "raw_len", "body"]
    by_resource = body.select(*kept, F.explode(f"v.{resources}").alias("res")).select(
        *kept, F.col(f"res.{scopes}").alias("scopes"), key_values(F.col("res.resource.attributes")).alias("res_attrs")
    )
    by_scope = by_resource.select(*kept, "res_attrs", F.explode("scopes").alias("sc"))
    scope = J.object_of(
        {
            "otel_scope_name": blank_to_null(F.col("sc.scope.name")),
            "otel_scope_version": blank_to_null(F.col("sc.scope.version")),
        }
    )
    service = F.coalesce(blank_to_null(J.as_text(F.col("res_attrs")["service.name"])), F.lit(UNKNOWN_SERVICE))
    base = _fields(J.without(F.col("res_attrs"), ["service.name"]), scope, key_values(F.col("sc.scope.attributes")))
    return by_scope.select(
        *kept, service.alias("service"), base.alias("base"), F.explode(f"sc.{records}").alias("rec")
    )


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _finish(df: DataFrame, fixed: dict[str, Column], attrs: Column, promoted, drop_keys) -> DataFrame:
    fields = _fields(J.object_of(fixed), attrs)
    return log_rows(df.withColumn("fields", fields), promoted, drop_keys)


def normalise_spans(raw: DataFrame, promoted: tuple[Promoted, ...] = (), drop_keys=()) -> DataFrame:
    df = unfold(raw, "resourceSpans", "scopeSpans", "spans", SPAN)
    s = F.col("rec")
    start, end = whole(s["startTimeUnixNano"]), whole(s["endTimeUnixNano"])
    df = df.withColumns(
        {
            "start": start,
            "end": end,
            "code": F.coalesce(enum_number(s["status"]["code"], STATUS_CODES), F.lit(0)),
            "kind": F.coalesce(enum_number(s["kind"], SPAN_KINDS), F.lit(0)),
        }
    )
    start, end, code = F.col("start"), F.col("end"), F.col("code")
    duration = F.when((end >= start) & (end > 0), (end - start) / F.lit(1_000_000.0)).otherwise(0.0)
    events = F.transform(
        s["events"],
        lambda e: F.struct(
            F.coalesce(e["name"], F.lit("")).alias("name"),
            F.coalesce(whole(e["timeUnixNano"]), F.lit(0)).cast("string").alias("time_unix_nano"),
            F.coalesce(key_values(e["attributes"]), F.create_map().cast(J.FIELDS)).alias("attributes"),
        ),
    )
    fixed = {
        "service": F.col("service"),
        "level": F.when(code == 2, "error").otherwise("info"),
        "msg": F.coalesce(s["name"], F.lit("")),
        "ts": _iso(F.coalesce(nanos_ts(start), F.col("receive_ts"))),
        "duration_ms": duration,
        "trace_id": F.lower(blank_to_null(s["traceId"])),
        "span_id": F.lower(blank_to_null(s["spanId"])),
    }
    own = {
        "parent_span_id": F.lower(blank_to_null(s["parentSpanId"])),
        "span_kind": enum_name(F.col("kind"), SPAN_KINDS),
        "status_code": F.when(
            s["status"].isNotNull(), F.coalesce(enum_name(code, STATUS_CODES), code.cast("string"))
        ),
        "status_message": blank_to_null(s["status"]["message"]),
        "trace_state": blank_to_null(s["traceState"]),
        "events": F.when(F.size(s["events"]) > 0, F.to_variant_object(events)),
    }
    attrs = _fields(F.col("base"), key_values(s["attributes"]), J.object_of(own))
    return _finish(df, fixed, attrs, promoted, drop_keys)


def severity_level(code: Column, words: Column) -> Column:
    band = F.floor((code - 1) / 4).cast("int")
    by_number = F.when(code.between(1, 24), F.get(F.array(*[F.lit(x) for x in _LEVEL_BY_BAND]), band))
    return F.coalesce(by_number, normalise_level(words), F.lit("info"))


def normalise_otlp_logs(raw: DataFrame, promoted: tuple[Promoted, ...] = (), drop_keys=()) -> DataFrame:
    df = unfold(raw, "resourceLogs", "scopeLogs", "logRecords", LOG_RECORD)
    r = F.col("rec")
    df = df.withColumns(
        {
            "words": blank_to_null(r["severityText"]),
            "code": enum_number(r["severityNumber"], SEVERITIES, "SEVERITY_NUMBER_"),
            "content": any_value(r["body"]),
        }
    )
    fixed = {
        "service": F.col("service"),
        "level": severity_level(F.col("code"), F.col("words")),
        "msg": F.coalesce(J.as_json(F.col("content")), F.lit("")),
        "ts": _iso(
            F.coalesce(
                nanos_ts(whole(r["timeUnixNano"])), nanos_ts(whole(r["observedTimeUnixNano"])),
                F.col("receive_ts"),
            )
        ),
        "trace_id": F.lower(blank_to_null(r["traceId"])),
        "span_id": F.lower(blank_to_null(r["spanId"])),
    }
    own = J.object_of({"severity_text": F.col("words"), "event_name": blank_to_null(r["eventName"])})
    attrs = _fields(F.col("base"), key_values(r["attributes"]), own)
    return _finish(df, fixed, attrs, promoted, drop_keys)


# Field of a metric, its type name, and whether it carries a temporality.
_KINDS = [
    ("gauge", "gauge", False),
    ("sum", "sum", True),
    ("histogram", "histogram", True),
    ("exponentialHistogram", "exponential_histogram", True),
    ("summary", "summary", False),
]


def normalise_otlp_metrics(raw: DataFrame, promoted: tuple[Promoted, ...] = (), drop_keys=()) -> DataFrame:
    """One row per data point of the five metric kinds."""
    df = unfold(raw, "resourceMetrics", "scopeMetrics", "metrics", METRIC)
    m = F.col("rec")
    typed = [
        F.when(
            m[field].isNotNull(),
            F.struct(F.lit(name).alias("type"), F.lit(timed).alias("timed"), m[field].alias("data")),
        )
        for field, name, timed in _KINDS
    ]
    df = df.withColumn("metric", F.coalesce(*typed)).filter(F.col("metric").isNotNull())
    mode = F.coalesce(enum_number(F.col("metric.data.aggregationTemporality"), TEMPORALITIES), F.lit(0))
    df = df.select(
        "receive_ts", "source_addr", "protocol", "raw_len", "body", "service", "base",
        m["name"].alias("name"), m["unit"].alias("unit"), m["description"].alias("description"),
        key_values(m["metadata"]).alias("metadata"),
        F.col("metric.type").alias("kind"), F.col("metric.timed").alias("timed"),
        F.col("metric.data.isMonotonic").alias("monotonic"), mode.alias("mode"),
        F.explode("metric.data.dataPoints").alias("p"),
    )
    p, kind = F.col("p"), F.col("kind")
    simple = kind.isin("gauge", "sum")
    spread_kind = kind.isin("histogram", "exponential_histogram")
    count, total = F.coalesce(whole(p["count"]), F.lit(0)), real(p["sum"])
    summed = F.when(spread_kind, total).otherwise(F.nullif(total, F.lit(0.0)))
    value = F.when(
        simple, F.coalesce(real(p["asDouble"]), whole(p["asInt"]).cast("double"), F.lit(0.0))
    ).otherwise(F.coalesce(summed, count.cast("double")))
    about = J.object_of(
        {
            "metric_type": kind,
            "is_monotonic": F.when(
                kind == "sum", F.coalesce(F.col("monotonic").try_cast("boolean"), F.lit(False))
            ),
            "aggregation_temporality": F.when(
                F.col("timed"), F.coalesce(enum_name(F.col("mode"), TEMPORALITY_WORDS), F.lit("unspecified"))
            ),
            "unit": blank_to_null(F.col("unit")),
            "description": blank_to_null(F.col("description")),
        }
    )
    own = J.object_of(
        {
            "value": value,
            "hist_count": F.when(spread_kind, count.cast("string")),
            "hist_sum": F.when(spread_kind, total),
            "hist_min": F.when(spread_kind, real(p["min"])),
            "hist_max": F.when(spread_kind, real(p["max"])),
            "summary_count": F.when(kind == "summary", count.cast("string")),
            "summary_sum": F.when(kind == "summary", summed),
        }
    )
    fixed = {
        "service": F.col("service"),
        "level": F.lit("info"),
        "msg": F.coalesce("name", F.lit("")),
        "ts": _iso(F.coalesce(nanos_ts(whole(p["timeUnixNano"])), F.col("receive_ts"))),
    }
    attrs = _fields(F.col("base"), about, F.col("metadata"), key_values(p["attributes"]), own)
    return _finish(df, fixed, attrs, promoted, drop_keys)
