"""Structured predicates compiled to one Catalyst expression.

A spec is a nested list:

* ``["service", "=", "api"]`` compares a column; operators are ``=``, ``!=``, ``>``, ``>=``,
  ``<``, ``<=`` and ``~`` (case-insensitive substring);
* ``["text", "timeout"]`` searches the message;
* ``["and", p, q, ...]``, ``["or", p, q, ...]`` and ``["not", p]`` combine specs.

Compiling checks column names, operators and values against the schema, so a bad spec fails
before any job starts, and the result is pushed into the scan like any other filter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, functions as F, types as T

from logspark.functions.text import glob_regex
import re

BUILT_IN = (
    "service", "level", "source_host", "host", "protocol", "trace_id", "span_id",
    "geo_country", "message", "fingerprint", "raw_len", "ts", "insert_ts",
)
_ALIASES = {"host": "source_host"}
_EQUALITY = ("=", "!=")
_ORDER = (">", ">=", "<", "<=")
_SUBSTRING = "~"


class PredicateError(ValueError):
    """A spec that does not fit the table."""


def compile_predicate(
    spec: Sequence | None,
    schema: T.StructType,
    promoted: Iterable[str] = (),
    exact: bool = False,
) -> Column:
    """One boolean column for ``spec``; an empty spec keeps every row.

    On text columns an equality value holding ``%`` or ``_`` is a substring pattern, unless
    ``exact`` is set.
    """
    if not spec:
        return F.lit(True)
    head = spec[0]
    if head in ("and", "or"):
        parts = [compile_predicate(p, schema, promoted, exact) for p in spec[1:]]
        if not parts:
            raise PredicateError(f"'{head}' needs at least one clause")
        out = parts[0]
        for part in parts[1:]:
            out = (out & part) if head == "and" else (out | part)
        return out
    if head == "not":
        if len(spec) != 2:
            raise PredicateError("'not' takes one clause")
        return ~compile_predicate(spec[1], schema, promoted, exact)
    if head == "text" and len(spec) == 2:
        return _substring(F.col("message"), str(spec[1]))
    if len(spec) != 3:
        raise PredicateError(f"cannot read clause {list(spec)!r}")
    return _comparison(spec[0], spec[1], spec[2], schema, promoted, exact)


def _comparison(key, op, value, schema, promoted, exact) -> Column:
    if key not in BUILT_IN and key not in set(promoted):
        raise PredicateError(f"unknown column '{key}'")
    name = _ALIASES.get(key, key)
    if name not in schema.names:
        raise PredicateError(f"column '{key}' is not in the table")
    kind = schema[name].dataType
    text = isinstance(kind, T.StringType)
    ordered = isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))
    column = F.col(name)
    if op == _SUBSTRING:
        if not text:
            raise PredicateError(f"'~' needs a text column, '{key}' is not")
        return _substring(column, str(value))
    if op in _ORDER and not ordered:
        raise PredicateError(f"'{op}' does not fit text column '{key}'")
    if op not in _EQUALITY and op not in _ORDER:
        raise PredicateError(f"unknown operator '{op}'")
    if text and op in _EQUALITY and not exact and re.search("[%_]", str(value)):
        hit = _substring(column, str(value))
        return hit if op == "=" else ~hit
    typed = F.lit(_literal(key, value, kind)).cast(kind)
    return {
        "=": column == typed,
        "!=": column != typed,
        ">": column > typed,
        ">=": column >= typed,
        "<": column < typed,
        "<=": column <= typed,
    }[op]


def _literal(key, value, kind):
    try:
        if isinstance(kind, T.IntegralType):
            if isinstance(value, bool) or (isinstance(value, float) and value != int(value)):
                raise ValueError
            return int(value)
        if isinstance(kind, (T.FractionalType, T.DecimalType)):
            return float(value)
    except (TypeError, ValueError):
        raise PredicateError(f"value {value!r} does not fit column '{key}'") from None
    if isinstance(kind, T.BooleanType):
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("true", "false"):
            return str(value).lower() == "true"
        raise PredicateError(f"value {value!r} does not fit column '{key}'")
    if isinstance(kind, T.StringType):
        return str(value)
    return value


def _substring(column: Column, value: str) -> Column:
    """``%`` and ``_`` are wildcards and a backslash is a plain character."""
    unused = next(ch for ch in "\u0001\u0002\u0003\u0004" if ch not in value)
    return F.ilike(column, F.lit(f"%{value}%"), F.lit(unused))


def clauses(spec: Sequence | None) -> Iterator[tuple[Sequence, bool]]:
    """Every leaf with a flag telling whether it stands under a ``not``."""

    def walk(node, negated):
        if not node:
            return
        if node[0] in ("and", "or"):
            for part in node[1:]:
                yield from walk(part, negated)
        elif node[0] == "not":
            yield from walk(node[1], not negated)
        else:
            yield node, negated

    yield from walk(spec, False)


def check_service_window(spec, window_seconds: int, limits: Sequence[tuple[str, int]]) -> None:
    """Reject a window wider than the cap of a service that the predicate pins by equality.

    ``limits`` lists (service glob, most seconds).
    """
    for clause, negated in clauses(spec):
        if negated or len(clause) != 3 or clause[0] != "service" or clause[1] != "=":
            continue
        for pattern, most in limits:
            if re.match(glob_regex(pattern), str(clause[2])) and window_seconds > most:
                raise PredicateError(
                    f"window of {window_seconds}s for service '{clause[2]}' is over the cap "
                    f"of {most}s (pattern '{pattern}')"
                )
