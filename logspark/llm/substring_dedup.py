"""Removal of repeated word windows, found through difference-cover anchors.

Positions modulo 21 in the cover {0, 1, 4, 14, 16} carry an anchor: the hash of the 15 words that
start there. Every difference modulo 21 is a difference of two cover members, so two equal
windows of 35 words, wherever they start, have an offset below 21 at which both carry an anchor,
and the anchor lies inside the window. A window can repeat only if it holds a repeated anchor.
The match is then extended: the windows around repeated anchors are hashed whole (96 bits), and
those met at least twice are repeated.

Occurrences are never paired: repeats are found by sorting on the hash. A hash that is frequent
within one Arrow batch settles its own occurrences there and sends one row, so a passage that a
third of all documents hold arrives as one row per batch. Rows carry positions, no text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logspark.llm.common import WordHasher, mix, prepare, release, stored

WINDOW = 35
#: Covers: period and members, such that all differences modulo the period occur.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
PERIOD = 21

_U64 = np.uint64
_B1, _B2 = _U64(0x9E3779B97F4A7C15), _U64(0xD6E8FEB86659FD93)
_FOUND = pa.schema([("key", pa.int64()), ("check", pa.int32()), ("rid", pa.int64()), ("pos", pa.int32()), ("sure", pa.bool_())])
_KIND = "key long, check int, rid long, pos int, sure boolean"


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: np.uint64):
        self.base, self.back = base, _U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            for name, x in (("up", self.base), ("down", self.back)):
                steps = np.full(m, x)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


class Rolling:
    """Hashes of all runs of ``width`` words of a text."""

    def __init__(self, base: np.uint64):
        self.powers = _Powers(base)

    def __call__(self, h: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            up, down = self.powers.to(len(h) + 1)
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * up[: len(h)], out=total[1:])
            return mix((total[at + width] - total[at]) * down[at] + _U64(width))


def _rows(rid: list[int], at: list[np.ndarray], key: list[np.ndarray], check: list[np.ndarray] | None) -> pa.RecordBatch:
    """Occurrences of a batch: those settled within it, and one of every hash to ask for."""
    keys, pos = np.concatenate(key), np.concatenate(at).astype(np.int32)
    rids = np.repeat(np.array(rid, np.int64), [len(x) for x in at])
    checks = np.concatenate(check) if check is not None else np.zeros(len(keys), np.uint32)
    order = np.lexsort((checks, keys)) if check is not None else np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    many = np.repeat(np.diff(np.flatnonzero(np.append(new, True))) > 1, np.diff(np.flatnonzero(np.append(new, True)))) if len(k) else new
    ask, told = order[new], order[many]
    every = np.concatenate([ask, told])
    sure = np.zeros(len(every), bool)
    sure[len(ask) :] = True
    with np.errstate(over="ignore"):  # settled rows travel under a key per document, which spreads them
        out = np.where(sure, mix(rids[every].view(np.uint64) * _B2), keys[every])
        checks = np.where(sure, np.uint32(0), checks[every])
    return pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(checks.view(np.int32)), pa.array(rids[every]), pa.array(pos[every]), pa.array(sure)], schema=_FOUND)


def _anchors(window: int, period: int) -> Callable:
    width, cover = window - period + 1, np.zeros(period, bool)
    cover[list(COVERS[period])] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, roll = WordHasher(), Rolling(_B1)
        for batch in batches:
            rid, at, key = [], [], []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = hasher.words(text)
                if len(words) >= window:
                    spots = np.arange(len(words) - width + 1)
                    spots = spots[cover[spots % period]]
                    rid.append(r)
                    at.append(spots)
                    key.append(roll(hasher.hashes(words), width, spots))
            if rid:
                yield _rows(rid, at, key, None)

    return run


def _windows(window: int, period: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, roll, other = WordHasher(), Rolling(_B1), Rolling(_B2)
        for batch in batches:
            rid, at, key, check = [], [], [], []
            for r, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = hasher.words(text)
                last = len(words) - window
                a = np.array(marks, np.int64)
                edge = np.zeros(len(words) + 2, np.int64)
                np.add.at(edge, np.maximum(a - period + 1, 0), 1)
                np.add.at(edge, a + 1, -1)
                spots = np.flatnonzero(np.cumsum(edge)[: last + 1] > 0)
                h = hasher.hashes(words)
                rid.append(r)
                at.append(spots)
                key.append(roll(h, window, spots))
                check.append((other(h, window, spots) >> _U64(32)).astype(np.uint32))
            if rid:
                yield _rows(rid, at, key, check)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, pos) of settled rows and of rows whose neighbours in the sorted order have the same hash."""
    schema = pa.schema([("rid", pa.int64()), ("pos", pa.int32())])
    last: tuple | None = None  # the previous batch's last row: key, check, rid, pos, whether reported
    for batch in batches:
        if not batch.num_rows:
            continue
        key, check, rid, pos, sure = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        same = (key[1:] == key[:-1]) & (check[1:] == check[:-1]) & ~sure[1:] & ~sure[:-1]
        out = sure.copy()
        out[1:] |= same
        out[:-1] |= same
        rids, poss = rid[out], pos[out]
        if last is not None and not sure[0] and (last[0], last[1]) == (key[0], check[0]):
            if not out[0]:
                rids, poss, out[0] = np.append(rids, rid[0]), np.append(poss, pos[0]), True
            if not last[4]:
                rids, poss = np.append(rids, last[2]), np.append(poss, last[3])
        last = None if sure[-1] else (key[-1], check[-1], rid[-1], pos[-1], out[-1])
        if len(rids):
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(poss, pa.int32())], schema=schema)


def _with_row_id(docs: DataFrame) -> DataFrame:
    """Adds ``rid``: the id, or a hash of id and text where the id is null or repeated."""
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL")
    again = stored(again.select(F.col("doc_id").alias("again")), "repeated-ids")
    plain = F.col("doc_id").isNotNull() & F.col("again").isNull()
    marked = docs.join(again, docs["doc_id"] == again["again"], "left")
    return marked.withColumn("rid", F.when(plain, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text"))).drop("again")


def _met_again(found: DataFrame, tag: str) -> DataFrame:
    """Per row id the positions whose hash occurs at least twice."""
    rows = found.repartition("key").sortWithinPartitions("key", "check", "sure").mapInArrow(_repeated, "rid long, pos int")
    return stored(rows.groupBy("rid").agg(F.collect_set("pos").alias("marks")), tag)


def _kept(window: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            rows = []
            for doc, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = hasher.words(text)
                gone = np.zeros(len(words) + 1, np.int64)
                if marks:
                    a = np.array(marks, np.int64)
                    np.add.at(gone, a, 1)
                    np.add.at(gone, a + window, -1)
                    keep = np.cumsum(gone)[:-1] == 0
                    left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    left = words
                kept = b" ".join(left)
                rows.append((doc, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256, kept_text.

    Words are separated by ASCII white space and otherwise unchanged. A word goes if a window of
    ``window`` words that covers it has the same words as a window that starts anywhere else, in
    another row or in the same one; windows are judged on the input. Texts below ``window``
    words, empty and null texts lose nothing. A row is a document: rows that repeat an id and
    text repeat each other and lose their windows; null ids are kept as they are. Other columns
    are neither read nor returned. No rows give no rows.
    """
    if window < period:
        raise ValueError("the window is shorter than the period of the cover")
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = _with_row_id(docs)
    marked = _met_again(docs.select("rid", "text").mapInArrow(_anchors(window, period), _KIND), "anchors")
    release(docs.sparkSession)  # nothing holds the anchors' shuffle any more
    near = docs.select("rid", "text").join(marked, "rid").select("rid", "text", "marks")
    repeats = _met_again(near.mapInArrow(_windows(window, period), _KIND), "windows")
    del near
    release(docs.sparkSession)
    rows = docs.join(repeats, "rid", "left").select("doc_id", "text", "marks")
    out = rows.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
