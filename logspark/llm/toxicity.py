"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, give the probability of each word by interpolated
Kneser-Ney smoothing over three levels: the word after the word before it (documents), the word (the number of
different words before it), and at the bottom
counts that both classes share, the document counts of all words over the whole corpus. Every level takes a
discount off its counts and hands that mass to the level below, so rare and unseen expressions are
smoothed. Most words of a toxic text are ordinary ones: a word of it comes from the toxic model with
probability ``MIX``, else from the ordinary one. The mean log-likelihood ratio per word of this mixture over the ordinary model is the
raw score, so long and short texts compare; a logistic curve fitted to labelled texts that the models haven't seen, weighted
by the true sizes of the classes, maps it to 0 .. 1, with 0.5 where fewest of these texts are on the wrong side.

Labelled rows form a bounded sample (``FIT_ROWS`` per class for the counts, ``CURVE_ROWS`` per class
for the curve); the shared counts and the scores cover every document. Counts and ratios are made by
joins and aggregations; tasks get the ratios of the sample's expressions (16 bytes each) as sorted arrays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logspark.llm.common import prepare, stored

FIT_ROWS, CURVE_ROWS = 4_000, 2_000
#: Discounts of words and of pairs, most of which occur in one class by chance.
DISCOUNT, PAIR_DISCOUNT = 0.75, 8.0
MIX = 0.002
#: Words counted in a task before they are handed on.
HELD = 400_000
#: Stands before the first word of a text; no word of a text.
START = "^"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall((text or "").lower())


def _key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


PAIRS_DDL = "before long, word long, toxic int, n long"


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word before, word, class, documents) of labelled texts, summed per batch."""
    schema = pa.schema([("before", pa.int64()), ("word", pa.int64()), ("toxic", pa.int32()), ("n", pa.int64())])
    for batch in batches:
        n: Counter = Counter()
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            n.update({(a, b, toxic) for a, b in zip([START, *words], words)})
        keys = {w: _key(w) for a, b, _ in n for w in (a, b)}
        rows = [(keys[a], keys[b], c, x) for (a, b, c), x in n.items()]
        if rows:
            yield _batch(rows, schema)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents) of all texts, summed within a task as far as memory allows."""
    schema = pa.schema([("word", pa.int64()), ("d", pa.int64())])
    held: Counter = Counter()

    def told() -> pa.RecordBatch:
        out = _batch([(_key(w), d) for w, d in held.items()], schema)
        held.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(set(words_of(text)))
            if len(held) > HELD:
                yield told()
    if held:
        yield told()


def _after(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a word after another: the first key, turned by 17 bits, xor the second."""
    b = before.view(np.uint64)
    return (((b << np.uint64(17)) | (b >> np.uint64(47))) ^ word.view(np.uint64)).view(np.int64)


class Table:
    """Ratios by key, as sorted arrays."""

    def __init__(self, rows: pa.Table):
        keys = rows.column(0).to_numpy()
        order = np.argsort(keys)
        self.keys, self.ratios = keys[order], rows.column(1).to_numpy()[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios, and whether the key is there."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        order = np.argsort(keys)  # neighbours in the table are looked up one after the other
        at = np.empty(len(keys), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        return self.ratios[at], self.keys[at] == keys


class Ratios:
    """Log-likelihood ratio of toxic over ordinary per word, by backoff."""

    def __init__(self, pairs: Table, words: Table, befores: Table, unseen: float):
        self.pairs, self.words, self.befores, self.unseen = pairs, words, befores, unseen
        self._forget()

    def _forget(self) -> None:
        """Place of each word met in ``facts``: key, ratio as a word, backoff ratio as the word before."""
        self.seen: dict[str, int] = {}
        self.facts = (np.empty(0, np.int64), np.empty(0), np.empty(0))

    def _learn(self, words: set[str]) -> None:
        """``words`` are new ones."""
        new = list(words)
        keys = np.array([_key(w) for w in new], np.int64)
        word, known = self.words.find(keys)
        before, met = self.befores.find(keys)
        fresh = keys, np.where(known, word, self.unseen), np.where(met, before, 0.0)
        self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
        self.facts = tuple(np.concatenate(x) for x in zip(self.facts, fresh, strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        """Per text the logarithm of the mean ratio per word, which is above -``2 * MIX``, plus that; of ``2 * MIX`` for a text without words."""
        spoken = [[START, *words_of(t)] for t in texts]
        words = [w for ws in spoken for w in ws]
        if not words:
            return []
        if new := set(words).difference(self.seen):
            if len(self.seen) + len(new) > HELD:
                new = set(words)
                self._forget()
            self._learn(new)
        at = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        keys, own, backoff = (f[at] for f in self.facts)
        pair, known = self.pairs.find(_after(keys[:-1], keys[1:]))  # those from a text to the next START are left out below
        ratio = np.where(known, pair, backoff[:-1] + own[1:])
        gain = np.log1p(MIX * np.expm1(ratio))
        ends = np.cumsum([len(ws) for ws in spoken])
        return [float(np.log(2 * MIX + (gain[e - len(ws) : e - 1].mean() if len(ws) > 1 else 0.0))) for e, ws in zip(ends.tolist(), spoken, strict=True)]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def middle(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The score from which on toxic errs least on the weighted rows, halfway to the score below it."""
    scores, place = np.unique(x, return_inverse=True)
    toxic, clean = (np.bincount(place, weight * (y == c), len(scores)) for c in (1, 0))
    wrong = np.concatenate([[0.0], np.cumsum(toxic)]) + clean.sum() - np.concatenate([[0.0], np.cumsum(clean)])
    edges = np.concatenate([[scores[0]], (scores[1:] + scores[:-1]) / 2, [scores[-1] + 1e-9]])
    return float(edges[np.argmin(wrong)])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve of weighted rows; a small penalty holds the slope where classes are apart."""
    weight = weight / weight.sum()
    scale = float(x.std()) or 1.0
    z, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + np.array([1e-4 * w[0], 0])
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(curve, grad)
        w -= step / max(1.0, np.abs(step).max() / 5)
    return w[0] / scale, w[1]


def _scores(ratios: Ratios, slope: float, shift: float, name: str):
    schema = pa.schema([(name, pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.array(ratios.scores(batch.column(1).to_pylist()), np.float64)
            out = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out)], schema=schema)

    return run


def fold_of(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, curve_rows: int = CURVE_ROWS) -> tuple[Ratios, float, float] | None:
    """Models and curve from ``docs`` (id, text) and ``labels`` (doc_id, toxic); none without both classes.

    Rows with remainder 1 to 3 give the counts, rows with remainder 4 the curve, rows with
    remainder 0 nothing; of each class those of smallest hash.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"), fold_of("doc_id").alias("fold"))

    def pick(where: str, rows: int) -> DataFrame:
        each = [known.filter(where).filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(rows).select("id", "toxic") for c in (0, 1)]
        return F.broadcast(each[0].union(each[1]))  # at most 2 * rows rows

    sample = docs.join(pick("fold BETWEEN 1 AND 3", fit_rows), "id").select("toxic", "text")
    ratios = models(sample, docs)
    if ratios is None:
        return None
    curve = docs.join(pick("fold = 4", curve_rows), "id").select("toxic", "text")
    points = curve.mapInArrow(_scores_raw(ratios), "toxic long, score double").toPandas()  # at most 2 * curve_rows rows
    x, y = points["score"].to_numpy(), points["toxic"].to_numpy()
    if len(set(y.tolist())) < 2:
        return ratios, 2.0, 8.0  # 0.05 without evidence, 0.5 at a mean ratio of 0.014
    true = {r["toxic"]: r["n"] for r in known.filter("fold = 4").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.array([true[c] / (y == c).sum() for c in (0, 1)])
    slope, shift = logistic(x, y, weight[y])
    return ratios, slope, -slope * middle(x, y, weight[y]) if slope > 0 else shift


def models(sample: DataFrame, docs: DataFrame) -> Ratios | None:
    """Ratios of all expressions of ``sample`` (toxic, text) over the shared counts of ``docs``; none without words of both classes."""
    by = lambda x: [F.sum(F.when(F.col("toxic") == c, F.col(x)).otherwise(0)).alias(f"{x}{c}") for c in (0, 1)]
    different = lambda x, y: [F.count(F.when(F.col(f"{x}{c}") > 0, 1)).alias(f"{y}{c}") for c in (0, 1)]
    pairs = stored(sample.mapInArrow(_class_counts, PAIRS_DDL).groupBy("before", "word").agg(*by("n")), "pairs")
    befores = stored(pairs.groupBy("before").agg(*[F.sum(f"n{c}").alias(f"h{c}") for c in (0, 1)], *[F.sum(F.least(f"n{c}", F.lit(PAIR_DISCOUNT))).alias(f"t{c}") for c in (0, 1)]), "words-before")
    words = stored(pairs.groupBy("word").agg(*different("n", "c")), "words")
    corpus = stored(docs.select("text").mapInArrow(_document_counts, "word long, d long").groupBy("word").agg(F.sum("d").alias("d")), "document-counts")

    one = lambda df, *cols: df.agg(*[F.sum(c).alias(c) for c in cols]).first()
    total, large = one(words, "c0", "c1"), one(corpus, "d")["d"]
    if not (total["c0"] and total["c1"]):
        return None
    kinds = words.agg(*different("c", "k")).first()
    level = lambda count, kind, below, whole: (F.greatest(F.col(count) - DISCOUNT, F.lit(0.0)) + DISCOUNT * kind * below) / whole
    top = lambda c: (F.greatest(F.col(f"n{c}") - PAIR_DISCOUNT, F.lit(0.0)) + F.col(f"t{c}") * F.col(f"p{c}")) / F.col(f"h{c}")
    ratio = lambda p: F.log(F.col(f"{p}1") / F.col(f"{p}0"))
    words = words.join(corpus, "word")
    words = stored(words.select("word", *[level(f"c{c}", kinds[f"k{c}"], F.col("d") / large, total[f"c{c}"]).alias(f"p{c}") for c in (0, 1)]), "word-models")
    weight = [F.when(F.col(f"h{c}") > 0, F.col(f"t{c}") / F.col(f"h{c}")).otherwise(F.lit(1.0)).alias(f"b{c}") for c in (0, 1)]
    after = [F.when(F.col(f"h{c}") > 0, top(c)).otherwise(F.col(f"p{c}")).alias(f"r{c}") for c in (0, 1)]
    key = F.shiftleft("before", 17).bitwiseOR(F.shiftrightunsigned("before", 47)).bitwiseXOR(F.col("word"))
    seen = pairs.join(words, "word").join(befores, "before").select(key.alias("key"), *after)
    handed = [DISCOUNT * kinds[f"k{c}"] / total[f"c{c}"] for c in (0, 1)]
    # all bounded by the sample
    return Ratios(
        Table(seen.select("key", ratio("r")).toArrow()), Table(words.select("word", ratio("p")).toArrow()),
        Table(befores.select("before", *weight).select("before", ratio("b")).toArrow()), float(np.log(handed[1] / handed[0])),
    )


def _scores_raw(ratios: Ratios):
    schema = pa.schema([("toxic", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = ratios.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(raw, pa.float64())], schema=schema)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score`` (0 to 1, higher: likelier toxic) and ``predicted``.

    The score reads the text alone. Null and empty texts have the score of a text in which
    nothing speaks for either class. Labels other than 0 and 1, and labels without an id, teach
    nothing; without labelled rows of both classes all scores are 0. A null id is held out of
    training (``held_out`` false). Repeated rows are scored each. Other columns are neither read
    nor returned. No rows give no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    model = fit(rows, labels)
    if model is None:
        scored = rows.select("id", F.lit(0.0).alias("score"))
    else:
        scored = rows.mapInArrow(_scores(*model, "id"), "id long, score double")
    held = F.coalesce(fold_of("id") == 0, F.lit(False)).alias("held_out")
    return scored.select(F.col("id").alias(id_col), held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
