"""Places of regular-expression matches, and texts rebuilt around them, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

BLOCK = 64


def parts_of(text: Column, pattern: str) -> Column:
    """The text between the leftmost non-overlapping matches; one more than there are matches."""
    return F.split(text, pattern, -1)


def matches_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once: what stands inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(parts: Column, matches: Column) -> Column:
    """Array of (start, end, value) in code points, end exclusive, for ``matches`` between ``parts``.

    The prefix sums of the lengths go by blocks, so a text with m matches costs about m * sqrt(m)
    small steps.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def lengths(x: Column) -> Column:
        lens = F.zip_with(F.slice(x["parts"], 1, F.size(x["matches"])), x["matches"], lambda p, m: F.char_length(p) + F.char_length(m))
        return bound(lens, lambda lens: bound(sums(lens), lambda blocks: placed(x, lens, blocks)))

    def sums(lens: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(lens) / BLOCK).cast("int")), lambda b: total(F.slice(lens, b * BLOCK + 1, BLOCK)))

    def placed(x: Column, lens: Column, blocks: Column) -> Column:
        def place(m: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            before = total(F.slice(blocks, 1, b)) + total(F.slice(lens, b * BLOCK + 1, i - b * BLOCK)) + F.char_length(F.get(x["parts"], i))
            return F.struct(before.alias("start"), (before + F.char_length(m)).alias("end"), m.alias("value"))

        return F.transform(x["matches"], place)

    return bound(F.struct(parts.alias("parts"), matches.alias("matches")), lengths)


def replaced(parts: Column, matches: Column, change: Callable[[Column], Column]) -> Column:
    """The text with every match changed."""
    new = F.concat(F.transform(matches, change), F.array(F.lit("")))
    return F.array_join(F.flatten(F.zip_with(parts, new, lambda p, m: F.array(p, m))), "")
