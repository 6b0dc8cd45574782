"""Typed access to semi-structured fields kept as MAP<STRING, VARIANT>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FIELDS = "map<string,variant>"
# Variant types and the kind they stand for.
KINDS = {
    "STRING": "string", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number",
    "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "VOID": "null",
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_of(c: Column, values) -> Column:
    """As ``isin``, for lambdas: there ``isin`` leaves its loop by an exception at every hit."""
    return F.array_contains(F.array(*[F.lit(x) for x in values]), c)


def parse(raw: Column) -> Column:
    """A whole text as one JSON value, NULL otherwise.

    Spark's parser stops after the first value, so the text is parsed as the head of a
    two-element array; anything behind the value then breaks the array. A text that closes the
    array itself (it holds ``,1]``) must also be one element of an array of its own.
    """

    def head(raw: Column, pair: Column) -> Column:
        exactly_two = (F.size(pair) == 2) & F.try_variant_get(F.get(pair, F.lit(1)), "$", "int").eqNullSafe(F.lit(1))
        alone = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))).eqNullSafe(F.lit(1))
        whole = exactly_two & (~raw.rlike(r",\s*1\s*\]") | alone)
        return F.when(whole, F.get(pair, F.lit(0)))

    def pair(raw: Column) -> Column:
        return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit(",1]"))), "$", "array<variant>")

    return let(raw, lambda r: let(pair(r), lambda p: head(r, p)))


def parse_fields(raw: Column) -> Column:
    """A JSON object's members; NULL for anything that is not a JSON object."""
    looks_like = raw.rlike(r"^\s*\{")
    return F.try_variant_get(parse(F.when(looks_like, raw)), "$", FIELDS)


def object_fields(v: Column) -> Column:
    """Members of a variant object, NULL otherwise."""
    return let(v, lambda x: F.when(kind(x) == "object", F.try_variant_get(x, "$", FIELDS)))


def kind(v: Column) -> Column:
    """string, integer, number, boolean, object, array or null; NULL when absent."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), name)


def as_text(v: Column) -> Column:
    """The value when it is a JSON string."""
    return let(v, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))


def as_number(v: Column) -> Column:
    """The value as a double when it is a JSON number."""
    return let(v, lambda x: F.when(one_of(kind(x), ["integer", "number"]), F.try_variant_get(x, "$", "double")))


def as_json(v: Column) -> Column:
    """Plain text of strings, JSON text of everything else."""
    return let(v, lambda x: F.when(x.isNotNull(), F.coalesce(as_text(x), F.to_json(x))))


def get(v: Column, *path: str) -> Column:
    """A nested member as VARIANT."""
    return F.try_variant_get(v, variant_path(list(path)), "variant")


def items(v: Column, *path: str) -> Column:
    """A nested array as ARRAY<VARIANT>."""
    return F.try_variant_get(v, variant_path(list(path)), "array<variant>")


def first_text(fields: Column, *keys: str) -> Column:
    return F.coalesce(*[as_text(fields[k]) for k in keys])


def variant(c: Column) -> Column:
    return c.cast("variant")


def object_of(pairs: dict[str, Column]) -> Column:
    """MAP<STRING, VARIANT> from columns; entries with NULL values are left out."""
    entries = [F.struct(F.lit(k).alias("key"), v.cast("variant").alias("value")) for k, v in pairs.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def without(fields: Column, keys) -> Column:
    drop = list(keys)
    return F.map_filter(fields, lambda k, _: ~one_of(k, drop)) if drop else fields


def merge(winner: Column, loser: Column) -> Column:
    """Union of two maps; on a shared key the first argument wins. NULL maps count as empty.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` (see ``logspark.session.prepare``).
    """
    empty = F.create_map().cast(FIELDS)
    return F.map_concat(F.coalesce(loser, empty), F.coalesce(winner, empty))


def path_of(path: str) -> list[str]:
    """Segments of ``$.a.b``, ``a.b`` or ``a``."""
    body = path[2:] if path.startswith("$.") else path
    return [seg for seg in body.split(".") if seg]


def variant_path(segments: list[str]) -> str:
    return "$" + "".join(f"['{seg}']" for seg in segments)


def coerce(v: Column, kind_name: str) -> Column:
    """A variant as BIGINT, DOUBLE, VARCHAR or BOOLEAN; a mismatch is NULL."""
    k = kind(v)
    text = as_text(v)
    flag = F.try_variant_get(v, "$", "boolean")
    whole = F.try_variant_get(v, "$", "bigint")
    real = F.try_variant_get(v, "$", "double")
    if kind_name == "BIGINT":
        return (
            F.when(k == "boolean", flag.cast("int").cast("bigint"))
            .when(k == "integer", whole)
            .when(k == "number", real.try_cast("bigint"))
            .when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
        )
    if kind_name == "DOUBLE":
        decimal = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
        special = r"(?i)^[+-]?(inf|infinity|nan)$"
        return (
            F.when(k == "boolean", flag.cast("int").cast("double"))
            .when(k.isin("integer", "number"), real)
            .when(text.rlike(decimal) | text.rlike(special), text.try_cast("double"))
        )
    if kind_name == "VARCHAR":
        return F.when(k == "string", text).when(k.isin("boolean", "integer", "number"), F.to_json(v))
    if kind_name == "BOOLEAN":
        word = F.lower(text)
        return (
            F.when(k == "boolean", flag)
            .when((k == "integer") & whole.isin(0, 1), whole == 1)
            .when(word.isin("true", "yes", "1", "on"), True)
            .when(word.isin("false", "no", "0", "off"), False)
        )
    raise ValueError(f"unknown promoted type {kind_name!r}")
