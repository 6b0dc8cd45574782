"""Severity names and ranks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logspark.functions.text import ascii_lower, strip_space

# Accepted spellings per level.
LEVEL_WORDS = {
    "debug": ["TRACE", "FINEST", "VERBOSE", "DBG", "DEBUG"],
    "info": ["INFO", "INFORMATIONAL", "NOTICE", "LOG", "I"],
    "warn": ["WARN", "WARNING", "WRN", "W"],
    "error": ["ERR", "ERROR", "ERRORS", "E", "FAULT"],
    "fatal": ["CRIT", "CRITICAL", "FATAL", "ALERT", "EMERG", "EMERGENCY", "F"],
}

# Words that raise an opaque line to error.
ERROR_WORDS = ["error", "exception", "traceback", "failed", "fatal"]


def normalise_level(c: Column) -> Column:
    """Synonyms to the five levels; other words of at most 32 bytes are kept in lower case."""
    return level_of_word(ascii_lower(strip_space(c)))


def level_of_word(word: Column) -> Column:
    """As ``normalise_level`` for text already trimmed and in lower case."""
    out = F.when(word.isNull(), F.lit(None).cast("string"))
    for level, words in LEVEL_WORDS.items():
        out = out.when(word.isin([w.lower() for w in words]), F.lit(level))
    return out.when(F.octet_length(word) <= 32, word).otherwise(F.lit("info"))


def json_number_level(n: Column) -> Column:
    """Numeric severity inside JSON logs."""
    return (
        F.when(n.between(0, 2), "fatal")
        .when(n.between(3, 4), "error")
        .when(n.between(5, 6), "warn")
        .when(n.between(7, 10), "info")
        .when(n.isNotNull(), "debug")
    )


def syslog_level(n: Column) -> Column:
    """Syslog severity 0-7, also used by the datagram log format."""
    return (
        F.when(n.between(0, 2), "fatal")
        .when(n == 3, "error")
        .when(n == 4, "warn")
        .when(n.between(5, 6), "info")
        .when(n.isNotNull(), "debug")
    )


def level_from_text(c: Column) -> Column:
    """Best-effort level of an opaque line, from keywords."""
    low = ascii_lower(c)
    return (
        F.when(low.rlike("|".join(ERROR_WORDS)), "error")
        .when(low.contains("warn"), "warn")
        .when(low.contains("debug"), "debug")
        .otherwise("info")
    )


def level_rank(c: Column) -> Column:
    return F.when(c == "fatal", 3).when(c == "error", 2).when(c == "warn", 1).otherwise(0)


def rank_of(level: str) -> int:
    return {"fatal": 3, "error": 2, "warn": 1}.get(level, 0)


def anomaly_severity(score: Column) -> Column:
    s = F.abs(score)
    return F.when(s >= 6, "critical").when(s >= 4, "high").when(s >= 3, "medium").otherwise("low")


def anomaly_rank(c: Column) -> Column:
    """Rank of a stored anomaly severity; ``warning`` and unknown words rank lowest."""
    return F.when(c == "critical", 3).when(c == "high", 2).when(c == "medium", 1).otherwise(0)
