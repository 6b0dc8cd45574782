"""Timestamps in many shapes, and time buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logspark.functions.json import let

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"

# Seconds of years 1 to 9999, the range a Spark timestamp keeps.
_MIN_SECONDS = -62135596800
_MAX_SECONDS = 253402300799

BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}


def flexible_ts(c: Column) -> Column:
    """RFC 3339 or one of the fixed patterns; anything else is NULL."""
    return let(
        c,
        lambda x: F.coalesce(
            _rfc3339(x),
            F.try_to_timestamp(x, F.lit("yyyy-M-d H:m:s")),
            F.try_to_timestamp(x, F.lit("yyyy/M/d H:m:s")),
        ),
    )


def epoch_ts(seconds: Column) -> Column:
    """Epoch seconds (with fraction) to a timestamp; values out of range are NULL."""

    def stamp(x: Column) -> Column:
        micros = (F.floor(x) * 1_000_000).cast("long") + F.floor((x - F.floor(x)) * 1_000_000).cast("long")
        return F.when(x.between(_MIN_SECONDS, _MAX_SECONDS), F.timestamp_micros(micros))

    return let(seconds, stamp)


def _rfc3339(c: Column) -> Column:
    # The pattern leaves no letters but these; ``upper`` would load the tables of all scripts in every executor.
    return F.when(c.rlike(_RFC3339), F.translate(c, "tz", "TZ")).try_cast("timestamp")


def rfc3339_ts(c: Column) -> Column:
    return let(c, _rfc3339)


def bucket(ts: Column, width: str) -> Column:
    """Start of the 1m, 5m, 1h or 1d bucket that holds ``ts``."""
    if width == "1m":
        return F.date_trunc("minute", ts)
    if width == "1h":
        return F.date_trunc("hour", ts)
    if width == "1d":
        return F.date_trunc("day", ts)
    if width == "5m":
        return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 300) * 300)
    raise ValueError(f"unknown bucket width {width!r}")


def ms_between(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)
