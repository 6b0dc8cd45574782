"""Byte-level BPE: texts to token ids and back to their bytes, by the tiktoken library and a local rank file.

A text over ``CHUNK`` characters is cut before it reaches the library, which keeps its native
stack and memory bounded. A cut never changes the ids: it lies where the split pattern must end one
match and begin the next whatever stands around it:

* between a character that isn't white space and a blank or line break (in a match white space
  only leads), or
* before the last character of a run of white space that a visible character follows (the run but
  its last character is one match by itself).

A stretch without such a place (one endless word) stays whole. Ids of the chunks are joined.

Null texts count as empty: no ids. Repeated rows, ties and other columns, whatever their names,
pass through unchanged; an empty table gives an empty table. Ids that the ranks don't hold, or
null ids, make the decoded value null, since there are no bytes for them.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from logspark.llm.common import prepare

#: Characters handed to the library at once; a chunk ends at the first safe place after that many.
CHUNK = 1 << 18
#: A safe place, as the empty string there. Python's white space contains that of the library's pattern.
SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])|(?<=[ \n\r\t])(?=[ \n\r\t][^\s\x1c-\x1f])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoder for a rank file (a token in base64 and its rank on each line); no special tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """``text`` cut at safe places, each chunk of ``size`` characters or as many more as there is no such place."""
    begin = 0
    while len(text) - begin > size:
        place = SAFE.search(text, begin + size)
        if place is None:
            break
        yield text[begin : place.start()]
        begin = place.start()
    yield text[begin:]


def encode_text(enc: tiktoken.Encoding, text: str | None, size: int = CHUNK) -> list[int]:
    ids: list[int] = []
    for chunk in chunks(text or "", size):
        ids += enc.encode_ordinary(chunk)
    return ids


def decode_ids(enc: tiktoken.Encoding, ids) -> bytes | None:
    try:
        return enc.decode_bytes([int(i) for i in ids])
    except (KeyError, TypeError, ValueError, OverflowError):
        return None


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of its texts in ``ids_col`` (array of int, never null)."""
    prepare(df.sparkSession)

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path, pattern)
        for batch in batches:
            yield pd.Series([encode_text(enc, t) for t in batch], dtype=object)

    # Marked as not repeatable, so that the planner keeps one evaluation where the ids are used several times.
    ids = F.pandas_udf(ids, "array<int>").asNondeterministic()
    return df.withColumn(ids_col, ids(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for in ``bytes_col``: raw bytes, since a token may end inside a character."""
    prepare(df.sparkSession)

    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path, pattern)
        for batch in batches:
            yield pd.Series([None if ids is None else decode_ids(enc, ids) for ids in batch], dtype=object)

    raw = F.pandas_udf(raw, "binary").asNondeterministic()
    return df.withColumn(bytes_col, raw(F.col(f"`{ids_col}`")))


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded bytes of every text of ``docs``."""
    ids = encode(docs.select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    return decode(ids, path, pattern)
