"""Hard negatives against scoring every anchor with every row."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from logspark.llm.negatives import UNSCORED, Rows, best, bounds, hard_negatives, pick_references, scored, to_ints, window

DDL = "vec_id long, label int, embedding array<float>, rid string, norm int, ints int"


def plain(rows, every=50, n_pos=5, n_neg=3):
    data = []
    for i, (vec_id, label, v, *_) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        data.append((i, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    key = lambda t: (-t[0], t[1] is None, t[1] or 0, t[2])
    for i, a, label, v in data:
        if a is None or a % every:
            continue
        scores = [(sum(p * q for p, q in zip(v, w)), b, j, m) for j, b, m, w in data if b != a]
        for ps, p, _, _ in sorted((s for s in scores if s[3] == label), key=key)[:n_pos]:
            good = sorted((s for s in scores if s[3] != label and 50 * ps <= 100 * s[0] <= 95 * ps), key=key)
            out += [(a, p, rank, n, ps, ns) for rank, (ns, n, _, _) in enumerate(good[:n_neg], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def vectors(n, seed=0, dim=8):
    """A hot label and a hot group of copies, near copies, zero vectors, ties, nulls, odd lengths and repeated ids."""
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        v = [x + rnd.gauss(0, 0.5) for x in c] if i % 3 else list(centres[0])
        label = 0 if i % 3 == 0 else rnd.randrange(10)
        rows.append((i, label if i % 6 else rnd.randrange(10), v))
    rows += [(n, None, rows[1][2]), (50 * n, 3, None), (50 * n + 50, 3, [None] * dim), (n + 1, 3, [float("nan")] * dim), (n + 2, 3, [float("inf")] + [0.0] * (dim - 1)),
             (100 * n, 2, [0.0] * dim), (n + 3, 2, [0.0] * dim), (None, 1, rows[0][2]), (n + 4, 4, rows[4][2][:3]), (n + 5, 5, []), (100, 6, rows[7][2]), (n + 6, 1, [-x for x in centres[0]])]
    return [(*r, "x", 1, 2) for r in rows]


@pytest.mark.parametrize("group,anchors", [(1 << 12, 1 << 14), (40, 3)])
def test_negatives_equal_scoring_all_rows(sp, group, anchors):
    rows = vectors(420)
    got = found(hard_negatives(sp.createDataFrame(rows, DDL).repartition(3), group=group, anchors=anchors))
    assert got == plain(rows) and len(got) > 50


def test_all_equal_rows_and_few_rows(sp):
    rows = [(i, i % 2, [1.0, 2.0], "", 0, 0) for i in range(101)] + [(1000 + i, 1 - i % 2, [0.5, 1.2], "", 0, 0) for i in range(30)]
    assert found(hard_negatives(sp.createDataFrame(rows, DDL))) == plain(rows)
    assert found(hard_negatives(sp.createDataFrame(rows[:1], DDL))) == [] == found(hard_negatives(sp.createDataFrame([], DDL)))


def test_large_components_are_exact_or_refused(sp):
    rows = [(i, i % 3, [float(2**16 + i), float(2**15 - i * i)], "", 0, 0) for i in range(60)]
    assert found(hard_negatives(sp.createDataFrame(rows, DDL.replace("float", "double")))) == plain(rows)
    with pytest.raises(OverflowError):
        to_ints([1e30])
    assert to_ints([1.0, None]) is None and to_ints([0.999, -0.001]).tolist() == [255, -1]


def as_rows(ints, labels, refs):
    n = len(ints)
    t = pa.table({"rid": list(range(n)), "vec_id": list(range(n)), "label": labels, "ints": [r.astype(np.int64).tobytes() for r in ints], "norm": np.sqrt((ints.astype(float) ** 2).sum(1))})
    return Rows(t, ints.shape[1], refs)


def test_bounds_hold_and_exclude_most_of_other_clusters():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (8, 16))
    of = rng.integers(0, 8, 600)
    ints = np.floor(centres[of] + rng.normal(0, 25, (600, 16))).astype(np.int64)
    ints[5], ints[6] = ints[4], -ints[4]
    rows = as_rows(ints, of.tolist(), pick_references(ints, 16))
    every = np.arange(600)
    low, high = bounds(rows, every, rows, every)
    exact = ints @ ints.T
    assert (low <= exact).all() and (exact <= high).all()
    top = np.sort(exact, axis=1)[:, -6, None]
    assert (high >= top).mean() < 0.35  # the sixth part of all rows or so is scored for the best five
    pairs = rng.random((600, 600)) < 0.01
    thin, full = scored(rows, every, rows, every, pairs), scored(rows, every, rows, every, pairs | True)
    assert (thin[pairs] == exact[pairs]).all() and (thin[~pairs] == UNSCORED).all() and (full == exact).all()


def test_best_takes_the_first_of_equal_scores():
    s = np.array([[5, 7, 7, 7, 1], [UNSCORED, 2, UNSCORED, UNSCORED, UNSCORED]])
    assert best(s, 2).tolist() == [[False, True, True, False, False], [False, True, False, False, False]]
    for score in (-7, -1, 0, 1, 7, 33, 100):
        lo, hi = window(score, 50, 95)
        assert [x for x in range(-50, 120) if 50 * score <= 100 * x <= 95 * score] == list(range(lo, hi + 1))
