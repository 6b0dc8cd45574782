"""Text normalisation, fingerprints, globs and label cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

UNIT_SEPARATOR = "\u001f"
_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
# Fixed value: the characters Unicode calls white space.
_SPACES = (
    "\t\n\u000b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Quoted runs: closed by the same quote, cut by a newline, or open to the end of the text.
_QUOTED = (
    "\"[^\"\\n]*(?:(\")|(\\n)|\\z)"
    "|'[^'\\n]*(?:(')|(\\n)|\\z)"
)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, _ASCII_UPPER, _ASCII_LOWER)


def strip_space(c: Column) -> Column:
    """Trim every kind of Unicode whitespace on both ends."""
    return F.trim(c, F.lit(_SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_label(c: Column, default: str) -> Column:
    """A display label: trimmed, with blanks and NULLs replaced by ``default``."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def normalise_error_text(c: Column) -> Column:
    """Drop volatile detail so equal errors group together.

    Quoted text becomes ``'S`` (an unterminated quote ends at the newline), whitespace
    collapses, digit words become N and hex words of 8 or more become H.
    """
    marked = F.regexp_replace(c, _QUOTED, "\u0001$1$2$3$4")
    bare = marked
    for mark, shown in (("\u0001\"", "'S"), ("\u0001'", "'S"), ("\u0001\n", " "), ("\u0001", "")):
        bare = F.replace(bare, F.lit(mark), F.lit(shown))
    spaced = F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
    numbers = F.regexp_replace(spaced, r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])", "N")
    return F.regexp_replace(
        numbers, r"(?<![A-Za-z0-9_])[0-9a-fA-F]{8,}(?![A-Za-z0-9_])", "H"
    )


def tagged_hash(tag: str, *parts: Column) -> Column:
    """16 hex characters of SHA-256 over a tag and separator-joined parts."""
    joined = F.concat_ws(UNIT_SEPARATOR, F.lit(tag), *[F.coalesce(p, F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)


def tagged_hash_of_array(tag: str, parts: Column) -> Column:
    """As ``tagged_hash`` with the parts in an array column."""
    safe = F.transform(parts, lambda p: F.coalesce(p, F.lit("")))
    joined = F.concat_ws(UNIT_SEPARATOR, F.concat(F.array(F.lit(tag)), safe))
    return F.substring(F.sha2(joined, 256), 1, 16)


def message_fingerprint(service: Column, message: Column) -> Column:
    text = F.coalesce(message, F.lit(""))
    return tagged_hash("m", service, normalise_error_text(text))


def client_fingerprint(values: Column) -> Column:
    return tagged_hash_of_array("c", values)


def exception_fingerprint(kind: Column, value: Column, frames: Column) -> Column:
    """``frames`` is an array of structs with module, function and filename, newest first."""
    head = F.array(F.coalesce(kind, F.lit("")), normalise_error_text(F.coalesce(value, F.lit(""))))
    top = F.flatten(
        F.transform(
            F.slice(frames, 1, 5),
            lambda f: F.array(
                F.coalesce(f["module"], F.lit("")),
                F.coalesce(f["function"], F.lit("")),
                F.coalesce(f["filename"], F.lit("")),
            ),
        )
    )
    return tagged_hash_of_array("s", F.concat(head, F.coalesce(top, F.array().cast("array<string>"))))


def variant_hash(stack: Column) -> Column:
    return tagged_hash("v", normalise_error_text(F.coalesce(stack, F.lit(""))))


def truncate_stack(stack: Column, max_frames: int, max_bytes: int) -> Column:
    """Struct (stack, truncated): at most ``max_frames`` lines and ``max_bytes`` characters.

    The byte cut counts characters, so text outside ASCII may keep more bytes.
    """
    lines = F.split(F.regexp_replace(stack, r"\r?\n\z", ""), r"\r?\n")
    kept = F.array_join(F.slice(lines, 1, max_frames), "\n")
    return F.struct(
        F.substring(kept, 1, max_bytes).alias("stack"),
        ((F.size(lines) > max_frames) | (F.length(kept) > max_bytes)).alias("truncated"),
    )


def glob_regex(pattern: str) -> str:
    """A whole-string regular expression for a glob with ``*`` and ``?``."""
    body = "".join(
        ".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern
    )
    return f"(?s)^{body}$"


def glob_match(c: Column, pattern: str) -> Column:
    return c.rlike(glob_regex(pattern))


def glob_like(pattern: str) -> str:
    """A LIKE pattern for a glob with ``*`` only; LIKE's own signs stay literal."""
    swap = {"*": "%", "%": "\\%", "_": "\\_", "\\": "\\\\"}
    return "".join(swap.get(ch, ch) for ch in pattern)


def contains_ci(c: Column, text: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the text are plain characters."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.ilike(f"%{escaped}%")
