"""JSON, syslog and free-text records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions import json as J
from logspark.functions.levels import level_from_text, syslog_level
from logspark.functions.timestamps import rfc3339_ts
from logspark.normalise.common import Promoted, as_input, log_rows

SYSLOG_PROTOCOLS = ["syslog_udp", "syslog_tcp"]
# Facility names by number.
FACILITIES = [
    "LOG_KERN", "LOG_USER", "LOG_MAIL", "LOG_DAEMON", "LOG_AUTH", "LOG_SYSLOG", "LOG_LPR",
    "LOG_NEWS", "LOG_UUCP", "LOG_CRON", "LOG_AUTHPRIV", "LOG_FTP", "LOG_NTP", "LOG_AUDIT",
    "LOG_ALERT", "LOG_CLOCKD", "LOG_LOCAL0", "LOG_LOCAL1", "LOG_LOCAL2", "LOG_LOCAL3",
    "LOG_LOCAL4", "LOG_LOCAL5", "LOG_LOCAL6", "LOG_LOCAL7",
]
_PRI = r"^<(\d{1,3})>"
_NEW = r"(?s)^<(\d{1,3})>(\d{1,2}) (\S+) (\S+) (\S+) (\S+) (\S+) ?(.*)$"
_DATA = r"(?s)^((?:\[(?:[^\]\"\\]|\\.|\"(?:[^\"\\]|\\.)*\")*\])+|-) ?(.*)$"
_OLD = (
    r"(?s)^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d (?:\d{4} )?\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T\S+)"
    r":? (\S+) ([^\s:\[]+)(?:\[([^\]]*)\])?: ?(.*)$"
)
_OLD_BARE = r"(?s)^<(\d{1,3})>(.*)$"


def normalise_json(
    raw: DataFrame, promoted: tuple[Promoted, ...] = (), drop_keys: tuple[str, ...] = (),
    lift_message: bool = True, keep: tuple[str, ...] = (),
) -> DataFrame:
    """JSON objects to log rows; records that are not JSON objects are left out."""
    parsed = as_input(raw).withColumn("fields", J.parse_fields(F.col("raw")))
    return log_rows(parsed.filter(F.col("fields").isNotNull()), promoted, drop_keys, lift_message, keep)


def normalise_text(raw: DataFrame, keep: tuple[str, ...] = (), drop_keys: tuple[str, ...] = ()) -> DataFrame:
    """Opaque lines: receive time, first 2,048 characters, level from keywords.

    ``raw`` may be BINARY; bytes that are not UTF-8 are described instead of shown.
    """
    df = as_input(_decoded(raw)).withColumn("fields", _text_fields()).withColumn("plain", F.lit(True))
    return log_rows(df, (), drop_keys, keep=keep)


def _decoded(raw: DataFrame) -> DataFrame:
    if raw.schema["raw"].dataType.typeName() != "binary":
        return raw
    text = F.col("raw").cast("string")
    valid = F.is_valid_utf8(text)
    note = F.concat(F.lit("<"), F.octet_length("raw").cast("string"), F.lit(" non-utf8 bytes>"))
    return raw.withColumn("raw", F.when(valid, text).otherwise(note))


def _text_fields() -> Column:
    return J.object_of({"level": level_from_text(F.col("body")), "msg": F.col("body")})


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _syslog_parts(df: DataFrame) -> DataFrame:
    """Header parts of both syslog layouts; the newer one wins where it fits."""
    body = F.col("body")

    def of(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(body, pattern, group), F.lit(""))

    is_new, is_old = body.rlike(_NEW), body.rlike(_OLD)

    def dash(c: Column) -> Column:
        return F.when(c != "-", c)

    rest = F.regexp_extract(body, _NEW, 8)
    data = F.regexp_extract(rest, _DATA, 1)
    year = F.year("receive_ts").cast("string")
    stamp = of(_OLD, 2)
    short = F.regexp_replace(stamp, r"^([A-Z][a-z]{2}) +(\d{1,2}) (?:(\d{4}) )?", "$1 $2 $3|")
    dated = F.when(short.rlike(r" \d{4}\|"), short).otherwise(
        F.regexp_replace(short, r" \|", F.concat(F.lit(" "), year, F.lit("|")))
    )
    old_ts = F.coalesce(
        rfc3339_ts(stamp), F.try_to_timestamp(dated, F.lit("MMM d yyyy|HH:mm:ss"))
    )
    return df.select(
        "*",
        F.regexp_extract(body, _PRI, 1).try_cast("int").alias("pri"),
        F.when(is_new, rfc3339_ts(dash(of(_NEW, 3)))).when(is_old, old_ts).alias("stamp"),
        F.when(is_new, dash(of(_NEW, 4))).when(is_old, of(_OLD, 3)).alias("host"),
        F.when(is_new, dash(of(_NEW, 5))).when(is_old, of(_OLD, 4)).alias("app"),
        F.when(is_new, dash(of(_NEW, 6))).when(is_old, of(_OLD, 5)).alias("procid"),
        F.when(is_new, dash(of(_NEW, 7))).alias("msgid"),
        F.when(is_new & data.startswith("["), data).alias("data"),
        F.when(is_new & rest.rlike(_DATA), F.regexp_extract(rest, _DATA, 2))
        .when(is_new, rest)
        .when(is_old, F.regexp_extract(body, _OLD, 6))
        .when(body.rlike(_OLD_BARE), F.regexp_extract(body, _OLD_BARE, 2))
        .otherwise(body)
        .alias("text"),
    )


def _structured_data(data: Column) -> Column:
    """``[id key="value" ...]`` elements as ``syslog_sd_<id>_<key>`` fields."""
    quoted = r'"(?:[^"\\]|\\.)*"'
    elements = F.regexp_extract_all(data, F.lit(rf"\[((?:[^\]\"\\]|\\.|{quoted})*)\]"), F.lit(1))

    def params(element: Column) -> Column:
        name = F.substring_index(element, " ", 1)
        pairs = F.regexp_extract_all(element, F.lit(rf"([^\s=]+={quoted})"), F.lit(1))
        return F.transform(
            pairs,
            lambda p: F.struct(
                F.concat(F.lit("syslog_sd_"), name, F.lit("_"), F.substring_index(p, "=", 1)).alias("key"),
                F.regexp_replace(
                    F.regexp_replace(p, r'(?s)^[^=]+="(.*)"$', "$1"), r'\\(["\\\]])', "$1"
                ).cast("variant").alias("value"),
            ),
        )

    empty = F.create_map().cast(J.FIELDS)
    return F.coalesce(F.map_from_entries(F.flatten(F.transform(elements, params))), empty)


def syslog_like(body: Column) -> Column:
    return body.rlike(_PRI) | body.startswith("<")


def _syslog_fields(p: DataFrame) -> Column:
    facility = F.get(F.array(*[F.lit(f) for f in FACILITIES]), F.floor(F.col("pri") / 8).cast("int"))
    fixed = {
        "ts": _iso(F.col("stamp")),
        "host": F.col("host"),
        "service": F.col("app"),
        "level": F.coalesce(syslog_level(F.pmod("pri", F.lit(8))), F.lit("info")),
        "msg": F.col("text"),
        "syslog_facility": facility,
        "syslog_procid": F.col("procid"),
        "syslog_msgid": F.col("msgid"),
    }
    return J.merge(J.object_of(fixed), _structured_data(F.col("data")))


def normalise_syslog(raw: DataFrame, keep: tuple[str, ...] = (), drop_keys: tuple[str, ...] = ()) -> DataFrame:
    """Syslog lines of either layout; lines without a priority are left out."""
    lines = _syslog_parts(as_input(raw).filter(syslog_like(F.col("raw"))))
    df = lines.withColumn("fields", _syslog_fields(lines)).withColumn("plain", F.lit(True))
    return log_rows(df, (), drop_keys, keep=keep)


def normalise(
    raw: DataFrame, promoted: tuple[Promoted, ...] = (), drop_keys: tuple[str, ...] = (),
    lift_message: bool = True, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Any raw record: JSON object first, then syslog by protocol, then free text.

    One pass: every record gets its field map from the first reading that fits, and the shared
    last step does the rest. No shuffle is involved.
    """
    df = as_input(_decoded(raw)).withColumn("json", J.parse_fields(F.col("raw")))
    is_syslog = F.col("protocol").isin(SYSLOG_PROTOCOLS) & syslog_like(F.col("body"))
    df = df.withColumn("whole_body", F.col("body")).withColumn(
        "body", F.when(F.col("json").isNull() & is_syslog, F.col("body"))
    )
    parts = _syslog_parts(df)
    sys_fields = F.when(F.col("body").isNotNull(), _syslog_fields(parts))
    parts = parts.withColumn("syslog", sys_fields).withColumn("body", F.col("whole_body"))
    fields = F.coalesce("json", "syslog", F.when(F.col("json").isNull(), _text_fields()))
    rows = parts.withColumns({"fields": fields, "plain": F.col("json").isNull()})
    return log_rows(rows, promoted, drop_keys, lift_message, keep)
