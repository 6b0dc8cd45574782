"""The shared last step: a map of fields becomes one typed log row.

Every format first turns its record into ``fields`` (MAP<STRING, VARIANT>) with the reserved
names below; the rest of the map is the row's attributes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions import json as J
from logspark.functions.levels import json_number_level, level_of_word
from logspark.functions.text import ascii_lower, blank_to_null, message_fingerprint, strip_space
from logspark.functions.timestamps import epoch_ts, flexible_ts

# Field names with a meaning of their own.
TS_KEYS = ["ts", "timestamp", "time", "@timestamp"]
LEVEL_KEYS = ["level", "severity", "loglevel", "lvl"]
MESSAGE_KEYS = ["msg", "message", "Message"]
SERVICE_KEYS = ["service", "logger"]
TRACE_KEYS = ["trace_id", "traceId"]
SPAN_KEYS = ["span_id", "spanId"]
RESERVED = [
    "ts", "timestamp", "time", "@timestamp", "host", "hostname", "service", "logger", "level",
    "severity", "msg", "message", "Message", "fingerprint", "trace_id", "traceId", "span_id",
    "spanId",
]
# Spellings of the promoted types.
_TYPE_WORDS = {
    "BIGINT": ["bigint", "i64", "int", "long"],
    "DOUBLE": ["double", "f64", "float"],
    "VARCHAR": ["varchar", "text", "string"],
    "BOOLEAN": ["boolean", "bool"],
}
_SPARK_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@dataclass(frozen=True)
class Promoted:
    """An attribute lifted to its own typed column."""

    name: str
    kind: str = "VARCHAR"
    path: str = ""

    @property
    def segments(self) -> list[str]:
        return J.path_of(self.path or self.name)

    @property
    def spark_type(self) -> str:
        return _SPARK_TYPES[self.kind]


def promoted_spec(text: str) -> Promoted:
    """``name``, ``name:type`` or ``name:type:path``."""
    name, _, rest = text.partition(":")
    kind, _, path = rest.partition(":")
    kind = (kind or "varchar").lower()
    found = [k for k, words in _TYPE_WORDS.items() if kind in words]
    if not found:
        raise ValueError(f"unknown type {kind!r} in {text!r}")
    if not name or not name.isascii() or not name.isidentifier():
        raise ValueError(f"invalid column name {name!r}")
    return Promoted(name, found[0], path or f"$.{name}")


def only(df: DataFrame, condition: Column) -> DataFrame:
    """The rows of ``df`` that meet a condition, by way of a generator.

    The optimiser moves a plain filter below the columns it reads and computes them there again, and
    again for each filter on the way; it can't move one past a generator.
    """
    row = F.when(condition, F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return df.select(F.explode_outer(row).alias("_row")).filter("_row IS NOT NULL").select("_row.*")


def ts_of(v: Column) -> Column:
    return J.let(
        J.kind(v),
        lambda k: F.when(k == "string", flexible_ts(J.as_text(v))).when(
            J.one_of(k, ["integer", "number"]), epoch_ts(F.try_variant_get(v, "$", "double"))
        ),
    )


def first_ts(values: list[Column]) -> Column:
    """The first candidate that reads as a time."""
    tried = F.transform(F.array_compact(F.array(*values)), ts_of)
    return F.try_element_at(F.array_compact(tried), F.lit(1))


def first_level(values: list[Column]) -> Column:
    """The first candidate that is text or a number."""
    usable = F.filter(
        F.array_compact(F.array(*values)), lambda v: J.one_of(J.kind(v), ["string", "integer", "number"])
    )
    return F.get(usable, 0)


def level_of(v: Column, word: Column) -> Column:
    """Level of a candidate; ``word`` is its text, trimmed and in lower case."""
    k = J.kind(v)
    whole = F.when(k == "integer", F.try_variant_get(v, "$", "bigint")).otherwise(F.lit(0))
    return F.coalesce(level_of_word(word), F.when(v.isNotNull(), json_number_level(whole)), F.lit("info"))


def _split(df: DataFrame, fields: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>known`` (fields with a meaning), ``<prefix>text`` (their text) and
    ``<prefix>rest`` (attributes), so later expressions look into small maps."""
    known = F.map_filter(fields, lambda k, _: J.one_of(k, [*RESERVED, *LEVEL_KEYS]))
    return df.withColumns({f"{prefix}known": known, f"{prefix}rest": J.without(F.col(fields), RESERVED)}).withColumn(
        f"{prefix}text", F.transform_values(f"{prefix}known", lambda _, v: J.as_text(v))
    )


def log_rows(
    df: DataFrame,
    promoted: tuple[Promoted, ...] = (),
    drop_keys: tuple[str, ...] = (),
    lift_message: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``receive_ts, source_addr, protocol, raw_len, body, fields`` to log rows.

    A JSON object inside the message fills gaps (outer values win); promoted attributes become
    columns; ``drop_keys`` are stripped from the attributes. Rows whose optional column
    ``plain`` is true take no part in lifting and promotion.
    """
    plain = F.col("plain") if "plain" in df.columns else F.lit(False)
    df = _split(df, "fields", "o_")
    words = F.col("o_text")
    df = df.withColumn("message_text", F.coalesce(*[words[k] for k in MESSAGE_KEYS]))
    inner = F.lit(None).cast(J.FIELDS)
    if lift_message:
        inner = J.parse_fields(F.when(~plain, F.col("message_text")))
    df = _split(df.withColumn("inner", inner), "inner", "i_")

    def text(*keys: str, inner_keys: tuple[str, ...] | None = None) -> Column:
        return F.coalesce(
            *[F.col("o_text")[k] for k in keys], *[F.col("i_text")[k] for k in inner_keys or keys]
        )

    def candidates(keys: list[str]) -> list[Column]:
        return [F.col(known)[k] for known in ("o_known", "i_known") for k in keys]

    df = df.withColumn("level_value", first_level(candidates(LEVEL_KEYS))).withColumn(
        "level_word", ascii_lower(strip_space(J.as_text(F.col("level_value"))))
    )
    columns = {
        "ts": F.coalesce(first_ts(candidates(TS_KEYS)), F.col("receive_ts")),
        "insert_ts": F.col("receive_ts"),
        "source_host": F.coalesce(text("host", inner_keys=("host", "hostname")), F.col("source_addr")),
        "service": text(*SERVICE_KEYS),
        "level": level_of(F.col("level_value"), F.col("level_word")),
        "message": F.coalesce("message_text", "body"),
        "fingerprint": text("fingerprint"),
        "trace_id": text(*TRACE_KEYS),
        "span_id": text(*SPAN_KEYS),
        "attrs": J.merge(F.col("o_rest"), F.col("i_rest")),
    }
    if promoted:
        columns["merged"] = F.when(~plain, J.merge(F.col("fields"), F.col("inner")))
    rows = df.select(*[c.alias(n) for n, c in columns.items()], "raw_len", "protocol", *keep)
    return finish(promote(rows, promoted), drop_keys, promoted, keep)


def promote(rows: DataFrame, promoted: tuple[Promoted, ...]) -> DataFrame:
    """Typed columns from ``merged``; a promoted top-level key leaves ``attrs``."""
    if not promoted:
        return rows
    found, gone = {}, []
    for p in promoted:
        head, *rest = p.segments
        v = F.col("merged")[head]
        if rest:
            v = F.try_variant_get(v, J.variant_path(rest), "variant")
        else:
            gone.append(head)
        found[f"_{p.name}"] = v
    rows = rows.withColumns(found).withColumn("attrs", J.without(F.col("attrs"), gone))
    return rows.withColumns({p.name: J.coerce(F.col(f"_{p.name}"), p.kind) for p in promoted})


def drop_attributes(attrs: Column, keys: tuple[str, ...]) -> Column:
    return J.without(attrs, keys)


def finish(
    rows: DataFrame, drop_keys: tuple[str, ...] = (), promoted: tuple[Promoted, ...] = (),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Log columns from ``attrs`` and friends; empty text becomes NULL, errors get a fingerprint."""
    attrs = drop_attributes(F.col("attrs"), drop_keys)
    blank = F.lit("")
    missing = F.col("level").isin("error", "fatal") & (F.coalesce("fingerprint", blank) == "")
    fingerprint = F.when(
        missing, message_fingerprint(F.coalesce("service", blank), F.col("message"))
    ).otherwise(F.col("fingerprint"))
    return rows.select(
        "ts",
        "insert_ts",
        blank_to_null(F.col("source_host")).alias("source_host"),
        blank_to_null(F.col("service")).alias("service"),
        blank_to_null(F.col("level")).alias("level"),
        blank_to_null(F.col("message")).alias("message"),
        blank_to_null(fingerprint).alias("fingerprint"),
        blank_to_null(F.col("trace_id")).alias("trace_id"),
        blank_to_null(F.col("span_id")).alias("span_id"),
        F.to_json(attrs).alias("attributes"),
        F.lit(None).cast("string").alias("geo_country"),
        F.col("raw_len").cast("int").alias("raw_len"),
        "protocol",
        *[F.col(p.name) for p in promoted],
        *keep,
    )


def as_input(raw: DataFrame) -> DataFrame:
    """Raw records with their length and body."""
    return raw.withColumns({"raw_len": F.octet_length("raw"), "body": F.col("raw")})
