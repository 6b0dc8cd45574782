"""Phrase collocations: frequent phrases of 2 to 4 words per language, ranked by how firmly they hold together.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words at blanks and
tabs. A phrase stands wholly inside a piece. It is counted level by level:

1. Every task writes its words as blocks: a dictionary of the block's words and a code for each
   word of the text. Dictionary entries, not word occurrences, are summed over all blocks.
2. Words found often enough get ids by falling frequency, and blocks are rewritten in ids.
3. Within a block a pair of neighbouring ids (a, b) has the address a % TILE * TILE + b % TILE in
   the tile (a // TILE, b // TILE). As ids are ranks, the tiles of frequent words are full: those are
   counted by one dense bincount each. Pairs in thin tiles are counted as sorted coordinates.
4. The blocks' counts meet by pair; pairs found often enough are ranked in turn and become the
   ids of the next level, on which neighbours (i, i + 1) share all but one word. So the same step
   counts phrases of three and four words, and a phrase is counted only if all its parts are frequent.

Nothing is kept per word of a language or per document, so a language, word or pair with a third
of all rows costs one row per block. Blocks hold at most ``BLOCK`` words and three more of context
where a text goes on in the next block, so the longest text needs no more memory than any other.

Null texts and texts without words have no phrases; a null language counts as ``und``. Repeated rows
count as often as they stand there. Equal scores are ordered by count, then by phrase. An empty
table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from logspark.llm.common import frequency_ranks, prepare, stored

#: Words of a block, and of the context after it: one less than the longest phrase.
BLOCK = 1 << 19
LONGEST = 4
CONTEXT = LONGEST - 1
#: Bytes of a text that are split into words at once.
SLICE = 1 << 22
#: Side of a tile, and the pairs from which a tile is counted densely.
TILE = 1 << 10
DENSE = TILE * TILE // 8
#: Deals of the pairs of a level, each numbered by itself.
DEALS = 1 << 10
#: First choice within so many parts of a language's phrases before the final ranking.
PARTS = 64

_MARK = b","
_ENDS = bytes.maketrans(b".;:!?\n\x0b\x0c\r", _MARK * 9)
_GAP = re.compile(rb"[ \t,]")


# -- blocks of words --------------------------------------------------------------------------------


def word_slices(raw: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """Words and marks (``,`` at each end of a piece) of a text, slice by slice."""
    raw, begin = raw.lower().translate(_ENDS), 0
    while begin < len(raw):
        gap = _GAP.search(raw, begin + size) if len(raw) - begin > size else None
        end = gap.start() if gap else len(raw)
        yield raw[begin:end].replace(_MARK, b" , ").split()
        begin = end


class OpenBlock:
    """Codes of the words of one language, until there are enough; code 0 ends a piece."""

    def __init__(self):
        self.codes_of: defaultdict[bytes, int] = defaultdict()
        self.codes_of.default_factory = self.codes_of.__len__
        self.codes_of[_MARK] = 0
        self.runs: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.runs.append(np.fromiter(map(self.codes_of.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def close(self, context: list[bytes]) -> tuple[list[bytes], list[int], int, bytes]:
        """Words (the first stands for code 0), their counts, how many codes count here, and all codes."""
        own = self.size
        self.add(context)
        codes = np.concatenate(self.runs)
        counts = np.bincount(codes[:own], minlength=len(self.codes_of))
        counts[0] = 0
        return list(self.codes_of), counts.tolist(), own, codes.tobytes()


def block_rows(rows: Iterator[tuple[str, bytes]], block: int = BLOCK, slice_bytes: int = SLICE) -> Iterator[tuple]:
    """(lang, words, counts, own, codes) of full blocks, then of what is left."""
    openings: dict[str, OpenBlock] = {}
    for lang, raw in rows:
        rest: list[bytes] = []
        for words in word_slices(raw, slice_bytes):
            rest += words
            now = openings.setdefault(lang, OpenBlock())
            while len(rest) >= block - now.size + CONTEXT:
                room = block - now.size
                now.add(rest[:room])
                yield lang, *now.close(rest[room:room + CONTEXT])
                rest, now = rest[room:], OpenBlock()
                openings[lang] = now
        now = openings.setdefault(lang, OpenBlock())
        room = block - now.size
        if len(rest) > room:
            now.add(rest[:room])
            yield lang, *now.close(rest[room:])
            rest, now = rest[room:], OpenBlock()
            openings[lang] = now
        now.add([*rest, _MARK])
        if now.size >= block:
            yield lang, *openings.pop(lang).close([])
        if sum(o.size for o in openings.values()) > 3 * block:  # many languages: the fullest block goes early
            name = max(openings, key=lambda x: openings[x].size)
            yield name, *openings.pop(name).close([])
    for lang, now in openings.items():
        yield lang, *now.close([])


BLOCK_DDL = "block long, lang string, words array<string>, counts array<long>, own int, codes binary"


def word_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of all texts, stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for lang, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                    yield lang, raw.as_py()

        first = TaskContext.get().partitionId() << 32
        for i, (lang, words, counts, own, codes) in enumerate(block_rows(rows(), block)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + i], pa.int64()), pa.array([lang], pa.string()), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([own], pa.int32()), pa.array([codes], pa.binary())],
                ["block", "lang", "words", "counts", "own", "codes"],
            )

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter("text <> ''")
    return stored(texts.mapInArrow(cut, BLOCK_DDL), "phrase-blocks")


# -- one level ---------------------------------------------------------------------------------------


def tile_counts(a: np.ndarray, b: np.ndarray, tile: int = TILE, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs (a << 32 | b) of two id arrays, and how often each occurs."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    width = int(max(a.max(), b.max())) // tile + 1
    tiles, place, sizes = np.unique((a // tile) * width + b // tile, return_inverse=True, return_counts=True)
    keys, counts = [], []
    full = sizes >= dense
    for t in np.flatnonzero(full):
        here = place == t
        seen = np.bincount((a[here] % tile) * tile + b[here] % tile, minlength=tile * tile)
        at = np.flatnonzero(seen)
        ta, tb = divmod(int(tiles[t]), width)
        keys.append(((ta * tile + at // tile) << 32) | (tb * tile + at % tile))
        counts.append(seen[at])
    thin = ~full[place]
    coo = np.sort((a[thin] << 32) | b[thin])
    if len(coo):
        starts = np.flatnonzero(np.r_[True, coo[1:] != coo[:-1]])
        keys.append(coo[starts])
        counts.append(np.diff(np.r_[starts, len(coo)]))
    return np.concatenate(keys), np.concatenate(counts)


def neighbours(ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring ids in a block and their counts; pairs that begin in the context count 0 unless they also stand before it."""
    a, b = ids[:-1], ids[1:]
    there = (a >= 0) & (b >= 0)
    at = np.flatnonzero(there)
    mine, later = at[at < own], at[at >= own]
    keys, counts = tile_counts(a[mine], b[mine])
    if len(later):
        more = np.setdiff1d((a[later].astype(np.int64) << 32) | b[later], keys)
        keys, counts = np.r_[keys, more], np.r_[counts, np.zeros(len(more), np.int64)]
    return keys, counts


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(block, key, c): how often each pair of neighbouring ids stands in each block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, own, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                keys, counts = neighbours(np.frombuffer(ids.as_buffer(), np.int32), own)
                for i in range(0, len(keys), 1 << 16):
                    k, c = keys[i:i + (1 << 16)], counts[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k), pa.array(c.astype(np.int64))], ["block", "key", "c"])

    return blocks.select("block", "own", "ids").mapInArrow(count, "block long, key long, c long")


def rewrite_words(blocks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(block, own, ids) of the blocks: ids of frequent words, -1 for all others and between pieces."""
    entries = blocks.select("block", "lang", F.posexplode("words").alias("code", "word")).filter("code > 0")
    known = entries.join(vocabulary.select("lang", "word", "id"), ["lang", "word"])
    maps = known.groupBy("block").agg(F.collect_list("code").alias("codes_known"), F.collect_list("id").alias("ids_known"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, own, codes, known, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4)):
                codes = np.frombuffer(codes.as_buffer(), np.int32)
                to = np.full(int(codes.max(initial=0)) + 1, -1, np.int32)
                to[known.values.to_numpy(zero_copy_only=False)] = ids.values.to_numpy(zero_copy_only=False)
                yield _block(block, own, to[codes])

    rows = blocks.select("block", "own", "codes").join(maps, "block")
    return stored(rows.select("block", "own", "codes", "codes_known", "ids_known").mapInArrow(rewrite, "block long, own int, ids binary"), "phrase-ids")


def rewrite_pairs(blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """The blocks one level up: at each place the id of the frequent pair that begins there, else -1."""
    maps = kept.groupBy("block").agg(F.collect_list("key").alias("keys"), F.collect_list("id").alias("ids_known"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, own, seq, keys, to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4)):
                seq = np.frombuffer(seq.as_buffer(), np.int32).astype(np.int64)
                keys, to = keys.values.to_numpy(zero_copy_only=False), to.values.to_numpy(zero_copy_only=False)
                order = np.argsort(keys)
                keys, to = keys[order], to[order]
                pairs = np.where((seq[:-1] >= 0) & (seq[1:] >= 0), (seq[:-1] << 32) | seq[1:], -1)
                at = np.searchsorted(keys, pairs).clip(max=len(keys) - 1)
                yield _block(block, own, np.where(keys[at] == pairs, to[at], -1).astype(np.int32))

    rows = blocks.join(maps, "block").select("block", "own", "ids", "keys", "ids_known")
    return stored(rows.mapInArrow(rewrite, "block long, own int, ids binary"), "phrase-ids")


def _block(block: int, own: int, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([own], pa.int32()), pa.array([ids.tobytes()], pa.binary())], ["block", "own", "ids"])


def count_level(blocks: DataFrame, least: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """(kept: block, key, id of each frequent pair), (ids: key, a, id), both stored; ids only for the last level.

    Pairs are dealt to ``DEALS`` deals by hash and numbered by falling frequency within their deal, so that ids
    (number * DEALS + deal) follow the frequency closely, and sums, numbers and the rows of all blocks come
    from one shuffle: no row of a block is joined with the ids of its pairs.
    """
    counts = pair_counts(blocks)
    if last:
        totals = counts.groupBy("key").agg(F.sum("c").alias("a")).filter(F.col("a") >= least)
        return None, stored(totals.withColumn("id", F.lit(None).cast("int")), "phrase-pairs")
    dealt = counts.withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(DEALS)).cast("int")).repartition("deal")
    kept = dealt.withColumn("a", F.sum("c").over(Window.partitionBy("deal", "key"))).filter(F.col("a") >= least)
    number = F.dense_rank().over(Window.partitionBy("deal").orderBy(F.desc("a"), "key")) - 1
    kept = stored(kept.withColumn("id", number * DEALS + F.col("deal")).select("block", "key", "a", "id"), "phrase-kept")
    return kept, stored(kept.groupBy("key").agg(F.first("a").alias("a"), F.first("id").alias("id")), "phrase-pairs")


# -- phrases -----------------------------------------------------------------------------------------


def _ends(ids: DataFrame, below: DataFrame) -> DataFrame:
    """Pairs of a level with the rows of both halves on the level below, in columns u and v."""
    pairs = ids.select("id", "a", F.shiftright("key", 32).cast("int").alias("_u"), F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias("_v"))
    half = F.struct(*below.columns)
    left, right = below.select(F.col("id").alias("_u"), half.alias("u")), below.select(F.col("id").alias("_v"), half.alias("v"))
    return pairs.join(left, "_u").join(right, "_v").drop("_u", "_v")


def _cut(k: int, l: str, r: str) -> Column:
    """One cut; the quotient is exact, as it is taken over 38 decimal digits."""
    score = f"cast(2000000 as decimal(20, 0)) * cast(a as decimal(18, 0)) div (cast({l} as decimal(19, 0)) + {r})"
    return F.struct(F.expr(score).alias("score"), F.lit(k).alias("k"), F.expr(l).alias("l"), F.expr(r).alias("r"))


def _level(ids: DataFrame, below: DataFrame, cuts: list[Column], pre: str, suf: str, tag: str) -> DataFrame:
    out = _ends(ids, below).withColumn("_cut", F.array_min(F.array(*cuts)))
    return stored(out.select(
        "id", F.col("u.lang").alias("lang"), F.concat_ws(" ", "u.phrase", "v.tail").alias("phrase"), F.col("v.tail").alias("tail"), "a",
        F.col("u.first").alias("first"), F.col("v.last").alias("last"), F.expr(pre).alias("pre"), F.expr(suf).alias("suf"),
        F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"), F.col("u.id").alias("u"), F.col("v.id").alias("v"),
    ), tag)


def collocations(docs: DataFrame, least: int = 30, top: int | None = 2000, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases (all with None).

    ``a`` is the count of the phrase, ``l`` and ``r`` those of its parts at the lowest-scoring cut, ``n`` the
    words of the language. Phrases that stand inside a longer one with at least 80 % of their count are left out.
    """
    prepare(docs.sparkSession)
    blocks = word_blocks(docs, block)
    totals = blocks.select("lang", F.arrays_zip("words", "counts").alias("e")).select("lang", F.inline("e")).filter("counts > 0")
    words = totals.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("a"))
    sizes = blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("c")).groupBy("lang").agg(F.sum("c").alias("n"))
    vocabulary = stored(frequency_ranks(words.filter(F.col("a") >= least), [F.col("a").desc(), F.col("lang"), F.col("word")]), "phrase-words")
    ids1 = rewrite_words(blocks, vocabulary)
    kept2, pairs2 = count_level(ids1, least, False)
    ids2 = rewrite_pairs(ids1, kept2)
    kept3, pairs3 = count_level(ids2, least, False)
    ids3 = rewrite_pairs(ids2, kept3)
    _, pairs4 = count_level(ids3, least, True)

    none = F.lit(None).cast("long")
    level1 = vocabulary.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("tail"), "a", F.col("a").alias("first"), F.col("a").alias("last"), none.alias("pre"), none.alias("suf"))
    level2 = _level(pairs2, level1, [_cut(1, "u.a", "v.a")], "a", "a", "phrase-2")
    level3 = _level(pairs3, level2.drop("l", "r", "score", "u", "v"), [_cut(1, "u.first", "v.a"), _cut(2, "u.a", "v.last")], "u.a", "v.a", "phrase-3")
    level4 = _level(pairs4, level3.drop("l", "r", "score", "u", "v"), [_cut(1, "u.first", "v.a"), _cut(2, "u.pre", "v.suf"), _cut(3, "u.a", "v.last")], "u.a", "v.a", "phrase-4")

    # A phrase inside a longer one is inside one that is longer by a word and at least as frequent.
    whole = level4.select("lang", "phrase", "a", "l", "r", "score")
    for level, longer in ((level3, level4), (level2, level3)):
        cover = longer.select(F.col("u").alias("id"), F.col("a").alias("_more")).union(longer.select("v", "a")).groupBy("id").agg(F.max("_more").alias("_more"))
        free = level.join(cover, "id", "left").filter(F.expr("_more IS NULL OR 100 * cast(_more as decimal(20, 0)) < 80 * cast(a as decimal(20, 0))"))
        whole = whole.union(free.select("lang", "phrase", "a", "l", "r", "score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:
        part = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
        whole = whole.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("_near", part).filter(F.col("_near") <= top).drop("_part", "_near")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
        whole = whole.withColumn("rank", rank).filter(F.col("rank") <= top)
    else:
        placed = stored(frequency_ranks(whole, [F.col("lang"), *order], "_place"), "phrase-all")
        firsts = placed.groupBy("lang").agg(F.min("_place").alias("_first"))
        whole = placed.join(firsts, "lang").withColumn("rank", (F.col("_place") - F.col("_first") + 1).cast("long"))
    return whole.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
