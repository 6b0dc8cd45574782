"""Table schemas. Every operator takes and returns DataFrames shaped like these."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_TS, _S, _L, _D, _B, _I = (
    T.TimestampType(),
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.IntegerType(),
)
U64 = T.DecimalType(20, 0)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RAW = _struct(("receive_ts", _TS), ("source_addr", _S), ("protocol", _S), ("raw", _S))

LOGS = _struct(
    ("ts", _TS), ("insert_ts", _TS), ("source_host", _S), ("service", _S), ("level", _S),
    ("message", _S), ("fingerprint", _S), ("trace_id", _S), ("span_id", _S),
    ("attributes", _S), ("geo_country", _S), ("raw_len", _I), ("protocol", _S),
)

ROLLUP = _struct(
    ("bucket", _TS), ("service", _S), ("level", _S), ("n", _L),
    ("p50", _D), ("p95", _D), ("p99", _D), ("bytes", _L),
)

ERROR_ROLLUP = _struct(("bucket", _TS), ("fingerprint", _S), ("count", _L))

SERVICES = _struct(("name", _S), ("first_seen", _TS), ("last_seen", _TS), ("total", _L))

SAMPLE = _struct(("variant_hash", _S), ("first_seen", _TS), ("stack", _S))

ERROR_GROUPS = _struct(
    ("fingerprint", _S), ("service", _S), ("level", _S), ("title", _S),
    ("exception_type", _S), ("first_seen", _TS), ("last_seen", _TS), ("total_count", _L),
    ("status", _S), ("resolved_at", _TS), ("samples", T.ArrayType(SAMPLE)),
    ("variant_hashes", T.ArrayType(_S)),
)

ANOMALIES = _struct(
    ("ts", _TS), ("metric", _S), ("score", _D), ("method", _S), ("severity", _S)
)

ALERT_EVENTS = _struct(
    ("rule_id", _L), ("ts", _TS), ("metric", _S), ("value", _D), ("message", _S),
    ("notified", _B), ("error", _S), ("channel", _S), ("severity", _S),
)

WEB_EVENTS = _struct(
    ("ts", _TS), ("insert_ts", _TS), ("site_id", _S), ("event", _S), ("name", _S),
    ("value", _D), ("hostname", _S), ("path", _S), ("query", _S), ("referrer", _S),
    ("source", _S), ("medium", _S), ("utm", T.MapType(_S, _S)), ("visitor_id", U64),
    ("session_id", _L), ("user_id", U64), ("is_internal", _B), ("country", _S),
    ("region", _S), ("city", _S), ("device", _S), ("browser", _S), ("os", _S),
    ("screen_w", _I), ("is_bot", _B), ("props", _S), ("trace_id", _S), ("span_id", _S),
)

WEB_SESSIONS = _struct(
    ("session_id", _L), ("site_id", _S), ("visitor_id", U64), ("user_id", U64),
    ("is_internal", _B), ("start_ts", _TS), ("end_ts", _TS), ("entry_path", _S),
    ("exit_path", _S), ("pageviews", _L), ("events", _L), ("engaged_ms", _L),
    ("is_bounce", _B), ("source", _S), ("medium", _S), ("country", _S), ("region", _S),
    ("city", _S), ("device", _S), ("browser", _S), ("os", _S),
)

WEB_ROLLUP_MINUTE = _struct(("bucket", _TS), ("site_id", _S), ("pageviews", _L), ("events", _L))

WEB_ROLLUP_DAILY = _struct(
    ("day", T.DateType()), ("site_id", _S), ("dim", _S), ("dim_value", _S),
    ("pageviews", _L), ("visitors", _L), ("sessions", _L), ("bounces", _L),
    ("engaged_ms", _L),
)

WEB_SITES = _struct(
    ("id", _S), ("allowed_origins", T.ArrayType(_S)), ("user_header", _S),
    ("exclude_ips", T.ArrayType(_S)),
)


def conform(df: DataFrame, schema: T.StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """Select a table's columns by name, in order; absent ones become typed NULLs.

    ``extra`` names columns kept after the fixed ones (promoted attributes, event keys).
    """
    have = set(df.columns)
    cols = [
        F.col(f.name).cast(f.dataType).alias(f.name)
        if f.name in have
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*cols, *[F.col(c) for c in extra if c in have])
