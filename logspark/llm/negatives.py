"""Hard negatives for contrastive training, by angles to reference directions.

Components become integers (``floor(256 * x)``), scores are integer inner products. For each anchor (a
stated query set) the positives are the best other rows of its label; for each positive the
negatives are the best rows of other labels whose score lies in a window set by the positive's.

Every row keeps its norm and its angles to a few reference directions (far-apart rows of a bounded
sample; any directions give the same result). By the triangle inequality on the sphere, the angle
between an anchor at angle s and a row at angle t of a reference lies in |s - t| .. min(s + t, 2 pi - s - t).
The best of these over all references gives an interval of cosines, times both norms an interval of
scores, widened by more than rounding can amount to. A row is scored exactly only if its interval
reaches what its anchor still looks for:

* positives: scores of the rows with the highest upper bounds give a floor; rows below it are out;
* negatives: likewise a floor in every window; rows whose interval misses all windows are out.

Rows are dealt into groups of about ``GROUP`` rows and anchors into groups of ``ANCHORS``; each
pair of groups is one step, so neither a label with a third of all rows nor equal rows gather
in one task. Every step returns a few rows per anchor, and the best of these win.

Rows with a null label, a null vector, or a null or non-finite component take no part. A null id is
no anchor and follows all others among equal scores. Rows that repeat an id are rows of their own,
but none counts as "other" to an anchor of the same id; each anchor row has its own result. Shorter
vectors count as filled with zeros. Zero vectors score 0. An empty table gives an empty result;
other columns are not read. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logspark.llm.common import prepare, stored

#: Reference directions, and rows of the sample they are taken from.
REFERENCES = 16
SAMPLE = 2_000
#: Rows and anchors of one step. Rows travel once per group of anchors, so those are large.
GROUP = 1 << 12
ANCHORS = 1 << 14
#: Anchors bounded at once against a group of rows, and pairs scored at once.
AT_ONCE = 64
PAIRS = 1 << 16
#: Share of pairs from which a matrix product scores them all at once.
MANY = 0.02
#: Below every score.
UNSCORED = np.iinfo(np.int64).min
#: Highest upper bounds that are scored first.
FIRST = 32
#: Radians and relative score by which bounds are widened; double rounding stays far below.
ANGLE_SLACK = 1e-6
SCORE_SLACK = 1e-9

ROW_DDL = "rid long, vec_id long, label long, ints binary, norm double"


# -- integers and angles -----------------------------------------------------------------------------


def to_ints(vector: list[float]) -> np.ndarray | None:
    """floor(256 x) of each component; None if one is null or not finite."""
    x = np.array([np.nan if v is None else v for v in vector], np.float64)
    if not np.isfinite(x).all():
        return None
    x = np.floor(256 * x)
    if len(x) and not np.abs(x).max() < 2.0**62:
        raise OverflowError("a component is beyond the range of integer scores")
    return x.astype(np.int64)


def unit(ints: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    x = ints.astype(np.float64)
    norms = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def padded(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        v = np.frombuffer(r, np.int64)
        out[i, : len(v)] = v
    return out


def pick_references(sample: np.ndarray, count: int) -> np.ndarray:
    """Far-apart directions of a sample: each next one is the row least like those taken."""
    u = unit(sample)
    u = u[(u != 0).any(1)]
    if not len(u):
        return np.zeros((0, sample.shape[1]))
    taken, near = [0], u @ u[0]
    while len(taken) < min(count, len(u)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, u @ u[taken[-1]])
    return u[taken]


class Rows:
    """Rows of one group in order of id (null ids last): ids, labels, integers, norms and angles to the references."""

    def __init__(self, table: pa.Table, dim: int, refs: np.ndarray):
        rid, ids = table.column("rid").to_numpy(), table.column("vec_id")
        has_id, vec_id = ids.is_valid().to_numpy(), ids.fill_null(0).to_numpy()
        order = np.lexsort((rid, vec_id, ~has_id))
        self.rid, self.has_id, self.vec_id = rid[order], has_id[order], vec_id[order]
        self.label = table.column("label").to_numpy()[order]
        self.norm = table.column("norm").to_numpy()[order]
        self.ints = padded([x.as_buffer() for x in table.column("ints").take(pa.array(order))], dim)
        self.angle = np.arccos(np.clip(unit(self.ints) @ refs.T, -1, 1))


def bounds(a: Rows, at: np.ndarray, b: Rows, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of anchors ``at`` with the rows ``cols``."""
    s, t = a.angle[at], b.angle[cols]
    least, most = np.zeros((len(s), len(t))), np.full((len(s), len(t)), math.pi)
    for r in range(s.shape[1]):
        x, y = s[:, r, None], t[None, :, r]
        np.maximum(least, np.abs(x - y), out=least)
        both = x + y
        np.minimum(most, np.minimum(both, 2 * math.pi - both), out=most)
    size = a.norm[at, None] * b.norm[None, cols]
    slack = SCORE_SLACK * size + SCORE_SLACK
    high = np.cos(np.maximum(least - ANGLE_SLACK, 0)) * size + slack
    low = np.cos(np.minimum(most + ANGLE_SLACK, math.pi)) * size - slack
    return low, high


def scored(a: Rows, at: np.ndarray, b: Rows, cols: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Integer scores where ``pairs`` holds, UNSCORED elsewhere."""
    out = np.full(pairs.shape, UNSCORED)
    # No partial sum is larger than the product of the norms.
    largest = float(a.norm[at].max(initial=0)) * float(b.norm[cols].max(initial=0))
    if largest < 2.0**52 and pairs.mean() > MANY:
        full = a.ints[at].astype(np.float64) @ b.ints[cols].T.astype(np.float64)  # whole numbers, exact
        return np.where(pairs, full.astype(np.int64), out)
    x, y = np.nonzero(pairs)
    for k in range(0, len(x), PAIRS):
        i, j = at[x[k:k + PAIRS]], cols[y[k:k + PAIRS]]
        if largest < 2.0**62:
            score = np.einsum("pd,pd->p", a.ints[i], b.ints[j])
        else:
            score = [_checked(sum(int(p) * int(q) for p, q in zip(a.ints[u], b.ints[v]))) for u, v in zip(i, j)]
        out[x[k:k + PAIRS], y[k:k + PAIRS]] = score
    return out


def _checked(score: int) -> int:
    if not -(2**63) < score < 2**63:
        raise OverflowError("a score is beyond 64 bits")
    return score


def best(scores: np.ndarray, count: int) -> np.ndarray:
    """Which entries are among the ``count`` best of their line; of equal ones the first, and none that is unscored."""
    n = scores.shape[1]
    if n <= count:
        return scores != UNSCORED
    last = np.partition(scores, n - count, axis=1)[:, n - count, None]
    above, tie = scores > last, (scores == last) & (scores != UNSCORED)
    return above | (tie & (tie.cumsum(1) <= count - above.sum(1, keepdims=True)))


# -- one step: a group of anchors against a group of rows --------------------------------------------


def same_label(a: Rows, b: Rows, count: int) -> list[np.ndarray]:
    """Anchors, rows and scores: each anchor's ``count`` best other rows of its label in the group."""
    parts = []
    for label in np.unique(a.label):
        cols, mine = np.flatnonzero(b.label == label), np.flatnonzero(a.label == label)
        for k in range(0, len(mine) if len(cols) else 0, AT_ONCE):
            at = mine[k:k + AT_ONCE]
            low, high = bounds(a, at, b, cols)
            other = ~((a.vec_id[at, None] == b.vec_id[None, cols]) & a.has_id[at, None] & b.has_id[None, cols])
            high[~other], low[~other] = -np.inf, -np.inf
            floor = np.full((len(at), 1), -np.inf)
            if len(cols) > count:
                # At least ``count`` rows reach the count-th lower bound, and the least exact score of ``count`` rows.
                first = np.zeros_like(other)
                np.put_along_axis(first, np.argpartition(-high, count - 1, axis=1)[:, :count], True, 1)
                scores = scored(a, at, b, cols, first & other)
                known = (scores != UNSCORED).sum(1, keepdims=True) >= count
                least = np.where(scores == UNSCORED, np.inf, scores).min(1, keepdims=True)
                floor = np.maximum(np.where(known, least, -np.inf), np.partition(low, len(cols) - count, axis=1)[:, len(cols) - count, None])
            scores = scored(a, at, b, cols, other & (high >= floor))
            x, y = np.nonzero(best(scores, count))
            parts.append((at[x], cols[y], scores[x, y]))
    return [np.concatenate(p) for p in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3


def in_windows(a: Rows, low_end: np.ndarray, high_end: np.ndarray, b: Rows, count: int) -> list[np.ndarray]:
    """Anchors, windows, rows and scores: each window's ``count`` best rows of other labels in the group.

    ``low_end`` and ``high_end`` are scores, a column per window; a window with low > high is shut.
    """
    parts, cols = [], np.arange(len(b.rid))
    asking = np.flatnonzero((low_end <= high_end).any(1))
    for k in range(0, len(asking), AT_ONCE):
        at = asking[k:k + AT_ONCE]
        windows = [(low_end[at, w, None], high_end[at, w, None]) for w in range(low_end.shape[1])]
        low, high = bounds(a, at, b, cols)
        high[a.label[at, None] == b.label[None, :]] = -np.inf

        def reach(floors: list[np.ndarray]) -> np.ndarray:
            """Pairs whose interval reaches some window from its floor up."""
            some = np.zeros(high.shape, bool)
            for floor, (least, most) in zip(floors, windows):
                some |= (high >= np.where(least <= most, floor, np.inf)) & (low <= most)
            return some

        def inside(scores: np.ndarray, w: int) -> np.ndarray:
            least, most = windows[w]
            return np.where((scores >= least) & (scores <= most), scores, UNSCORED)

        near = reach([least for least, _ in windows])
        # Rows with the highest bounds go first; their scores raise the floors of the windows.
        first = np.zeros_like(near)
        n_first = min(FIRST, len(cols))
        np.put_along_axis(first, np.argpartition(np.where(near, -high, np.inf), n_first - 1, axis=1)[:, :n_first], True, 1)
        scores = scored(a, at, b, cols, first & near)
        floors = []
        for w, (least, _) in enumerate(windows):
            held = inside(scores, w)
            pick = best(held, count)
            lowest = np.where(pick, held, np.iinfo(np.int64).max).min(1, keepdims=True)
            floors.append(np.where(pick.sum(1, keepdims=True) >= count, lowest, least))
        scores = np.maximum(scores, scored(a, at, b, cols, near & ~first & reach(floors)))
        for w in range(len(windows)):
            held = inside(scores, w)
            x, y = np.nonzero(best(held, count))
            parts.append((at[x], np.full(len(x), w), y, held[x, y]))
    return [np.concatenate(p) for p in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


# -- distributed search ------------------------------------------------------------------------------


def integer_rows(vectors: DataFrame) -> DataFrame:
    """The rows that take part, with integer components and an id of their own, stored."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ints = [to_ints(v) for v in b.column(3).to_pylist()]
            keep = [i for i, v in enumerate(ints) if v is not None]
            norms = [math.sqrt(float((ints[i].astype(np.float64) ** 2).sum())) for i in keep]
            columns = [b.column(c).take(pa.array(keep, pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([ints[i].tobytes() for i in keep], pa.binary()), pa.array(norms, pa.float64())], ["rid", "vec_id", "label", "ints", "norm"])

    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END")
    rows = vectors.filter("label IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return stored(rows.mapInArrow(convert, ROW_DDL), "negatives-rows")


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   group: int = GROUP, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; a negative's score is between ``low`` and
    ``high`` percent of the positive's. ``vectors`` has vec_id, embedding and label (an integer).
    """
    prepare(vectors.sparkSession)
    rows = integer_rows(vectors)
    # Few numbers: sizes, and the bounded sample that references are taken from.
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(f"vec_id % {every} = 0")).alias("a"), F.coalesce(F.max(F.length("ints")), F.lit(0)).alias("bytes")).first()
    dim = max(size["bytes"] // 8, 1)
    sample = rows.select("ints", F.xxhash64("rid", "ints").alias("h")).orderBy("h").limit(SAMPLE).collect()
    refs = pick_references(padded([r["ints"] for r in sample], dim), REFERENCES)
    n_groups, n_anchor_groups = max(1, -(-size["n"] // group)), max(1, -(-size["a"] // anchors))
    dealt = rows.withColumn("g", F.expr(f"pmod(xxhash64(rid, 1), {n_groups})").cast("int")).withColumn("ag", F.explode(F.sequence(F.lit(0), F.lit(n_anchor_groups - 1))))
    chosen = rows.filter(f"vec_id % {every} = 0").withColumn("ag", F.expr(f"pmod(xxhash64(rid, 2), {n_anchor_groups})").cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))

    def step_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], _schema(("arid", "prid", "positive_id", "score")))
        a, b = Rows(left, dim, refs), Rows(right, dim, refs)
        x, y, score = same_label(a, b, positives)
        return pa.table([pa.array(a.rid[x]), pa.array(b.rid[y]), pa.array(b.vec_id[y], mask=~b.has_id[y]), pa.array(score)], _schema(("arid", "prid", "positive_id", "score")))

    sides = chosen.withColumn("g", spread).groupBy("g", "ag").cogroup(dealt.groupBy("g", "ag"))
    found = sides.applyInArrow(step_positives, "arid long, prid long, positive_id long, score long")
    order = Window.partitionBy("arid").orderBy(F.col("score").desc(), F.col("positive_id").asc_nulls_last(), "prid")
    chosen_positives = stored(found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives), "negatives-positives")
    scores = chosen_positives.groupBy("arid").agg(F.collect_list(F.struct("nth", "score")).alias("scores"))
    asking = stored(chosen.join(scores.withColumnRenamed("arid", "rid"), "rid"), "negatives-anchors")

    def step_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = _schema(("arid", "nth", "nrid", "negative_id", "negative_score"))
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], schema)
        a, b = Rows(left, dim, refs), Rows(right, dim, refs)
        low_end, high_end = np.ones((len(a.rid), positives), np.int64), np.zeros((len(a.rid), positives), np.int64)  # shut
        where = {r: i for i, r in enumerate(a.rid.tolist())}
        for rid, of in zip(left.column("rid").to_pylist(), left.column("scores").to_pylist()):
            for s in of:
                low_end[where[rid], s["nth"] - 1], high_end[where[rid], s["nth"] - 1] = window(s["score"], low, high)
        x, w, y, score = in_windows(a, low_end, high_end, b, negatives)
        return pa.table([pa.array(a.rid[x]), pa.array(w + 1), pa.array(b.rid[y]), pa.array(b.vec_id[y], mask=~b.has_id[y]), pa.array(score)], schema)

    sides = asking.withColumn("g", spread).groupBy("g", "ag").cogroup(dealt.groupBy("g", "ag"))
    found = sides.applyInArrow(step_negatives, "arid long, nth long, nrid long, negative_id long, negative_score long")
    order = Window.partitionBy("arid", "nth").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), "nrid")
    last = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    names = chosen_positives.join(chosen.select(F.col("rid").alias("arid"), F.col("vec_id").alias("anchor_id")), "arid")
    return names.join(last, ["arid", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def _schema(names: tuple[str, ...]) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])
