"""Best-fit packing of documents into sequences of fixed length.

The lengths of all pieces form a histogram of at most ``length`` numbers, however many pieces
there are. A configuration says how many pieces of each length share a sequence. The linear
program "fewest sequences whose configurations cover the histogram" is solved by multiplicative
weights: lengths carry prices, a knapsack dynamic program finds the configurations worth most at
these prices, and prices of lengths they cover fall. The solution is rounded down; what it leaves
open is packed best-fit, longest first, again on counts. The plan is a few thousand
rows of (length, first rank, sequence, offset); each piece finds its place by its rank among the
pieces of its length, so placing is one broadcast lookup and no task holds a length whole.
"""

from __future__ import annotations

import math
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logspark.llm.common import frequency_ranks, prepare, ranked, stored

LENGTH = 1024
END_ID = 2
#: Rounds of multiplicative weights, lengths served in a round, share of its cover that a
#: configuration gets in a step, and how fast the worth of covered lengths falls.
ROUNDS, BATCH, STEP, SHARPNESS = 600, 32, 0.1, 50.0
#: Scales at which the solution is rounded down.
SCALES = (1.0, 0.6, 0.3, 0.1)
#: Encoded words remembered per Python worker.
PIECES_KEPT = 1 << 20
#: White space but blanks and line ends, and that of it in ASCII.
OTHER_SPACE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
OTHER_ASCII = [c for c in OTHER_SPACE if c.isascii()]


class Encoder:
    """ids of byte-level BPE texts; words met before come from a bounded table."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library would only wait for each other
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.seen: dict[str, bytes] = {}

    def _encode(self, *texts: str) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, text: str) -> bytes:
        """ids as unsigned 32-bit numbers in the machine's byte order.

        Single blanks and single line ends between visible characters are borders for the
        byte-level pre-tokeniser too, so such texts are looked up word by word; any other white
        space sends the text to the tokeniser whole. The table holds words without their blank.
        """
        spaced = text.replace("\n", " \n")
        odd = not text or spaced[0] == " " or spaced[-1] in " \n" or "  " in spaced or "\n " in spaced
        if odd or any(c in text for c in (OTHER_ASCII if text.isascii() else OTHER_SPACE)):
            return self._encode(text)[0]
        first, *words = spaced.split(" ")
        seen = self.seen
        try:
            rest = b"".join(map(seen.__getitem__, words))
        except KeyError:
            if len(seen) > PIECES_KEPT:
                seen.clear()
            new = list(set(words).difference(seen))
            seen.update(zip(new, self._encode(*[w if w[0] == "\n" else " " + w for w in new]), strict=True))
            rest = b"".join(map(seen.__getitem__, words))
        return self._encode(first)[0] + rest


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The Python worker's encoder, whose table of words lives on from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only its first piece may be shorter."""
    head = total % length or min(total, length)
    starts = [0, *range(head, total, length)]
    return [(s, (starts[i + 1] if i + 1 < len(starts) else total) - s) for i, s in enumerate(starts)]


def _pieces(path: str, end_id: int, length: int, keep_ids: bool, keep_order: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids + [("_order", pa.int64())] * keep_order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assert sys.byteorder == "little" and array("I").itemsize == 4
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text, *order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text or "") + end
                for i, (start, n) in enumerate(cut(len(ids) // 4, length)):
                    part = ids[4 * start : 4 * (start + n)]
                    row = (doc, i, start, n, zlib.crc32(part))
                    rows.append((*row, *[np.frombuffer(part, "<u4").astype(np.int32)] * keep_ids, *order))
            cols = zip(*rows, strict=True) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def knapsack(price: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Worth of the best filling of every space up to ``room``, and its last piece (0: an idle token).

    ``price[n]`` is the worth of one piece of length n, minus infinity where there is none.
    """
    best, pick, sums = np.zeros(room + 1), np.zeros(room + 1, np.int64), np.empty(room)
    for space in range(1, room + 1):
        worth = np.add(best[:space][::-1], price[1 : space + 1], out=sums[:space])
        j = int(worth.argmax())
        if worth[j] > best[space - 1]:
            best[space], pick[space] = worth[j], j + 1
        else:
            best[space] = best[space - 1]
    return best, pick


def filling(space: int, pick: np.ndarray) -> list[int]:
    """The pieces of the best filling of ``space``."""
    out = []
    while space > 0:
        n = int(pick[space])
        if n:
            out.append(n)
        space -= n or 1
    return out


def fractional_cover(need: np.ndarray, room: int, rounds: int) -> dict[tuple[int, ...], float]:
    """Configurations and how often each is used, so that lengths are covered about once each.

    A token of a length is worth exp(-SHARPNESS * share covered); one knapsack table per round
    prices the best configuration around each of the ``BATCH`` lengths covered least, and each of
    these is used for ``STEP`` of what it could cover.
    """
    have = np.flatnonzero(need > 0)
    done, uses = np.zeros(len(need)), {}
    for _ in range(rounds):
        price = np.full(len(need), -np.inf)
        price[have] = have * np.exp(-SHARPNESS * (done[have] - done[have].min()))
        _, pick = knapsack(price, room)
        for n in have[np.argsort(done[have], kind="stable")[:BATCH]].tolist():
            config = tuple(sorted([n, *filling(room - n, pick)], reverse=True))
            at, many = np.unique(config, return_counts=True)
            step = float((need[at] / many).min()) * STEP
            done[at] += step * many / need[at]
            uses[config] = uses.get(config, 0.0) + step
    scale = float(np.quantile(done[have], 0.9))  # above it lie short fillers that many configurations share
    return {config: n / scale for config, n in uses.items()}


def pack_histogram(hist: dict[int, int], room: int = LENGTH, rounds: int = ROUNDS) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, longest first; number of such sequences), holding every piece once.

    Full configurations are rounded down, at several scales; the plan with the fewest sequences,
    with what is left packed best-fit, is taken.
    """
    need = np.zeros(room + 1, np.int64)
    for n, c in hist.items():
        need[n] = c
    plan = [([room], int(need[room]))] if need[room] else []
    need[room] = 0
    if not need.any():
        return plan
    uses = sorted(fractional_cover(need.astype(np.float64), room, rounds).items(), key=lambda x: (-x[1], x[0]))
    plans = []
    for scale in SCALES:
        left, out = need.copy(), []
        for config, n in uses:
            if sum(config) == room and (times := math.floor(n * scale)) > 0:
                at, many = np.unique(config, return_counts=True)
                times = int(min(times, (left[at] // many).min()))
                if times > 0:
                    left[at] -= times * many
                    out.append((list(config), times))
        plans.append(out + best_fit(dict(enumerate(left.tolist())), room))
    return plan + min(plans, key=lambda p: sum(n for _, n in p))


def best_fit(left: dict[int, int], room: int) -> list[tuple[list[int], int]]:
    """Longest piece first, then always the longest that still fits; equal sequences in one step."""
    left = {n: c for n, c in left.items() if c > 0}
    plan = []
    while left:
        names = sorted(left, reverse=True)
        space, config = room, {}
        for n in names:
            take = min(left[n], space // n)
            if take:
                config[n] = take
                space -= take * n
        times = min(left[n] // c for n, c in config.items())
        for n, c in config.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        plan.append(([n for n, c in config.items() for _ in range(c)], times))
    return plan


def places(plan: list[tuple[list[int], int]]) -> pd.DataFrame:
    """length, first rank, pieces per sequence, first sequence, first offset: where ranks go."""
    rows, used, first = [], {}, 0
    for config, times in plan:
        offset, i = 0, 0
        while i < len(config):
            n, many = config[i], config[i:].count(config[i])
            rows.append((n, used.get(n, 0), many, first, offset))
            used[n] = used.get(n, 0) + many * times
            offset += n * many
            i += many
        first += times
    return pd.DataFrame(rows, columns=["length", "rank", "many", "sequence", "offset"])


def _place(spots: dict[int, np.ndarray], keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            seq, off = np.zeros(len(df), np.int64), np.zeros(len(df), np.int64)
            lengths, ranks = df["length"].to_numpy(), df["_rank"].to_numpy()
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                t = spots[n]
                row = t[np.searchsorted(t[:, 0], ranks[at], "right") - 1]
                past = ranks[at] - row[:, 0]
                seq[at] = row[:, 2] + past // row[:, 1]
                off[at] = row[:, 3] + past % row[:, 1] * n
            yield df[keep].assign(sequence_id=seq, offset=off)

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, rounds: int = ROUNDS, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and with ``keep_ids`` its ids.

    A document is its token ids and ``end_id``; a null text is an empty one (its end id alone).
    Longer documents are cut into pieces of ``length``, the first may be shorter. Every piece is
    placed exactly once; a sequence is filled from 0 without gaps. A row is a document, also where
    ids repeat or are null. Other columns are neither read nor returned; no rows give no rows.

    With ``order`` (a long for each document) sequences are numbered from 0 by the least order in
    them, so that a reader of ascending sequences meets the documents about in that order.
    """
    spark = prepare(docs.sparkSession)
    by = [] if order is None else [order.cast("long").alias("_order")]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *by)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", _order long" * len(by)
    pieces = stored(docs.mapInArrow(_pieces(tokenizer_path, end_id, length, keep_ids, bool(by)), kind), "pieces")
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``length`` rows
    spots = places(pack_histogram(hist, length, rounds))
    lookup = {int(n): g[["rank", "many", "sequence", "offset"]].to_numpy(np.int64) for n, g in spots.groupby("length")}
    numbered = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32", "start"])
    out = numbered.mapInPandas(_place(lookup, [c for c in pieces.columns]), kind + ", sequence_id long, offset long")
    if by:
        out = stored(out, "placed")
        firsts = out.groupBy(F.col("sequence_id").alias("_old")).agg(F.min("_order").alias("_first"))
        names = frequency_ranks(firsts, [F.col("_first"), F.col("_old")], "_new").select("_old", "_new")
        out = out.join(names, F.col("sequence_id") == F.col("_old"))
        out = out.withColumn("sequence_id", F.col("_new").cast("long")).drop("_old", "_new", "_order")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
