"""Phrase collocations against plain counting of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from logspark.llm.common import frequency_ranks
from logspark.llm.phrases import LONGEST, block_rows, collocations, count_level, neighbours, rewrite_pairs, tile_counts, word_slices
from pyspark.sql import functions as F


def plain(rows, least, top):
    """rows of (lang, text)."""
    words, phrases = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, LONGEST + 1):
                phrases[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in phrases.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in cands.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    if 100 * a >= 80 * cands[p[i:i + n]]:
                        covered.add(p[i:i + n])
        found = []
        for p, a in cands.items():
            if p in covered:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, words[lang], -s))
    return sorted(out)


def corpus(n, seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "ß", "漢", "tab"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = []
    for i in range(n):
        w = rnd.choices(vocab, weights, k=rnd.randint(0, 60))
        for j in range(0, len(w), 7):
            w[j:j] = rnd.choice([["In", "spite", "of"], ["new", "york", "city", "hall"], ["x."], ["a\tb", ","], ["\n"], ["A", "a", "a", "a"]])
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und"]), rnd.choice([" ", "  ", " \t"]).join(w)))
    return rows + [("en", None), ("fr", ""), ("fr", " .,; "), ("en", rows[0][1]), ("en", rows[0][1])]


def frame(sp, rows):
    return sp.createDataFrame([(l, t, "x", 1, 2) for l, t in rows], "lang string, text string, phrase string, id int, _part int").repartition(3)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("block", [1 << 19, 50])
def test_phrases_equal_plain_counting(sp, block):
    rows = corpus(150)
    for top in (8, 2000):
        assert found(collocations(frame(sp, rows), least=10, top=top, block=block)) == plain(rows, 10, top)


def test_all_phrases_are_ranked_without_a_limit(sp):
    rows = corpus(60, 5)
    assert found(collocations(frame(sp, rows), least=3, top=None)) == plain(rows, 3, 10**9)


def test_one_very_long_text_and_one_endless_piece(sp):
    rows = [("en", "the old mill . " * 30_000 + "end of it"), ("en", "round and round " * 30_000), ("de", "z" * 300_000)]
    assert found(collocations(frame(sp, rows), least=30, top=50, block=1000)) == plain(rows, 30, 50)


def test_empty_tables_and_scores_beyond_64_bits(sp):
    assert found(collocations(frame(sp, []))) == []
    big = sp.range(1).selectExpr("2000000 * cast(9000000000000000 as decimal(18, 0)) div (cast(9000000000000000 as decimal(19, 0)) + 9000000000000000) AS s")
    assert big.first()["s"] == 1_000_000


def test_blocks_hold_every_word_once_and_three_of_context():
    rng = random.Random(1)
    rows = [(rng.choice("ab"), " ".join(rng.choices(["x", "y", "Z,", "é."], k=rng.randint(0, 90))).encode()) for _ in range(60)]
    want = Counter()
    for lang, raw in rows:
        want.update((lang, w) for w in b"".join([raw]).lower().replace(b",", b" ").replace(b".", b" ").split())
    for size, cut in ((7, 5), (20, 1 << 20), (10_000, 3)):
        got = Counter()
        for lang, words, counts, own, codes in block_rows(iter(rows), size, cut):
            n = len(codes) // 4
            assert own <= n <= own + 3 and own <= size + 1 and len(words) == len(counts) and words[0] == b","
            got.update({(lang, w): c for w, c in zip(words, counts) if c})
        assert got == want
    assert [w for s in word_slices(b"A b,c  d\te;", 2) for w in s] == [b"a", b"b", b",", b"c", b"d", b"e", b","]


def test_tiles_dense_and_thin_agree():
    rng = np.random.default_rng(2)
    a, b = rng.zipf(1.4, 5000).clip(max=300) - 1, rng.zipf(1.4, 5000).clip(max=300) - 1
    want = Counter(((int(x) << 32) | int(y)) for x, y in zip(a, b))
    for tile, dense in ((16, 40), (16, 1), (16, 10**9), (1024, 100)):
        keys, counts = tile_counts(a.astype(np.int32), b.astype(np.int32), tile, dense)
        assert len(set(keys.tolist())) == len(keys) and dict(zip(keys.tolist(), counts.tolist())) == want
    keys, counts = neighbours(np.array([1, 2, -1, 1, 2, 3], np.int32), 3)
    assert dict(zip(keys.tolist(), counts.tolist())) == {(1 << 32) | 2: 1, (2 << 32) | 3: 0}


def test_ranks_follow_the_order_over_many_ranges(sp):
    df = sp.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(90)).alias("f"), F.col("id").alias("k"))
    got = frequency_ranks(df, [F.col("f").desc(), F.col("k")]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: (-r["f"], r["k"]))] == list(range(5000))


def test_rows_of_a_level_carry_the_ids_of_their_pairs(sp):
    """So that no row of a block is joined with the ids."""
    rng = np.random.default_rng(3)
    ids = [(i, 400, rng.integers(0, 9, 400).astype(np.int32).tobytes()) for i in range(6)]
    kept, pairs = count_level(sp.createDataFrame(ids, "block long, own int, ids binary"), 20, False)
    of = {r["key"]: (r["a"], r["id"]) for r in pairs.collect()}
    rows = kept.collect()
    assert len(rows) > len(of) > 50 and all(of[r["key"]] == (r["a"], r["id"]) for r in rows)
    assert len({i for _, i in of.values()}) == len(of) and min(a for a, _ in of.values()) >= 20
    blocks = rewrite_pairs(sp.createDataFrame(ids, "block long, own int, ids binary"), kept)
    assert blocks.count() == 6
