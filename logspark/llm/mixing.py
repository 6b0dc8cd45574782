"""Mixing of sources to target weights by Pfair scheduling.

The documents of a source, in hashed order, are cut into blocks of equal size; a document belongs
to the block in which it starts. Block i (from 0) of a source of weight w may not come before
slot floor(i / w) and not after slot ceil((i + 1) / w) - 1; among the blocks released, the one
with the earliest deadline gets the slot. On one sequence of slots this meets all deadlines when
the weights sum to 1, so after any number of slots a source is less than one block off its share.

Weights are fractions of a period of ``period`` slots, so the schedule repeats: one period is
planned on the driver, and block i goes to slot (i div a) * period + place[i mod a] with a the
source's slots in a period. When a source has no blocks left, the others go on with their weights
scaled up: at most one phase per source. No document is dropped or repeated.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from logspark.llm.common import prepare, rank_bucket, ranked, stored

#: Characters of a block, and slots of a period (more where there are more sources).
BLOCK_CHARS = 1 << 18
PERIOD = 1_000
#: Characters ordered by one task.
BUCKET_CHARS = 1 << 22
#: Target weights of the registered query and of the pipeline; sources that aren't named weigh as the smallest one.
TARGETS = {"src0": 6.0, "src1": 4.0, "src2": 3.0, "src3": 1.5, "src4": 1.0}


def period_shares(weights: dict[str | None, float], period: int) -> dict[str | None, int]:
    """Slots of each source in a period: at least one, in sum the period (largest remainders)."""
    total = sum(weights.values())
    free = period - len(weights)
    exact = {s: w / total * free for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    spare = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[:spare]:
        out[s] += 1
    return out


def plan_period(shares: dict[str | None, int], period: int) -> dict[str | None, list[int]]:
    """The slots of each source in one period, earliest deadline first among released blocks."""
    names = sorted(shares, key=str)
    waiting = [(0, n) for n in range(len(names))]  # (release, source)
    heapq.heapify(waiting)
    done, ready = [0] * len(names), []
    out: dict[str | None, list[int]] = {s: [] for s in names}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, n = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[n] + 1) * period // shares[names[n]]), n))
        if not ready:
            continue
        _, n = heapq.heappop(ready)
        out[names[n]].append(slot)
        done[n] += 1
        if done[n] < shares[names[n]]:
            heapq.heappush(waiting, (done[n] * period // shares[names[n]], n))
    return out


def plan(blocks: dict[str | None, int], weights: dict[str | None, float], period: int) -> list[tuple]:
    """Rows (source, phase, first block, last block, first slot, slots per period, slots of a period)."""
    left, passed, base, rows = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    phase = 0
    while left:
        shares = period_shares({s: weights[s] for s in left}, period)
        slots = plan_period(shares, period)
        end = min((left[s] - 1) // shares[s] * period + slots[s][(left[s] - 1) % shares[s]] for s in left) + 1
        whole, rest = divmod(end, period)
        for s in sorted(left, key=str):
            n = whole * shares[s] + sum(x < rest for x in slots[s])
            if n:
                rows.append((s, phase, passed[s], passed[s] + n - 1, base, shares[s], slots[s]))
            passed[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        base += end
        phase += 1
    return rows


#: Order of the documents of a source inside a bucket.
_ORDER = ["mix_hash", "mix_tie"]
_PLAN = "plan_source string, mix_phase int, first_block long, last_block long, first_slot long, share long, slots array<int>"


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Per row ``row`` (a struct of the columns of ``docs`` named by ``carry``, all without it) and its place in the mix.

    Columns besides ``row``: mix_source, mix_offset (characters of its source before it), mix_block, mix_phase,
    mix_release, mix_deadline, mix_slot. The order of the mix is mix_slot, then mix_offset, then
    the hash of the row. ``weights`` names the target weight of each source; without it sources
    weigh the same, and a source that it doesn't name weighs as the smallest named one. A null
    source is a source of its own. Null and empty texts count one character. Repeated rows and
    null ids are rows like others. Source names and block counts, one small row per source, go to
    the driver. No rows give no rows.
    """
    rows = _rows(docs, carry or docs.columns, id_col, text_col, source_col)
    return _place(rows, _totals(rows), weights, block_chars, period).select(
        "row", "mix_source", "mix_offset", "mix_block", "mix_phase", "mix_release", "mix_deadline", "mix_slot", "mix_hash", "mix_tie"
    )


def _rows(docs: DataFrame, carry: list[str], id_col: str, text_col: str, source_col: str) -> DataFrame:
    prepare(docs.sparkSession)
    size = F.greatest(F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0)), F.lit(1)).cast("long")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{source_col}`").cast("string").alias("mix_source"),
        F.xxhash64(F.col(f"`{id_col}`")).alias("mix_hash"), F.xxhash64(F.col(f"`{text_col}`")).alias("mix_tie"), size.alias("mix_size"),
    )


def _totals(rows: DataFrame) -> dict[str | None, int]:
    """Characters of each source."""
    return {r["mix_source"]: r["n"] for r in rows.groupBy("mix_source").agg(F.sum("mix_size").alias("n")).collect()}  # a row per source


def _place(rows: DataFrame, totals: dict[str | None, int], weights: dict[str, float] | None, block_chars: int, period: int) -> DataFrame:
    """``rows`` with their places; all columns of ``rows`` are shuffled for it."""
    blocks = {s: -(-n // block_chars) for s, n in totals.items()}
    default = min(weights.values()) if weights else 1.0
    each = {s: (weights or {}).get(s, default) for s in blocks}
    table = rows.sparkSession.createDataFrame(plan(blocks, each, max(period, 4 * len(blocks))), _PLAN)
    placed = ranked(rows, ["mix_source"], _ORDER, size=F.col("mix_size"), rows=BUCKET_CHARS)
    placed = placed.withColumnRenamed("_rank", "mix_offset").withColumn("mix_block", F.floor(F.col("mix_offset") / block_chars).cast("long"))
    on = F.col("mix_source").eqNullSafe(F.col("plan_source")) & F.col("mix_block").between(F.col("first_block"), F.col("last_block"))
    out = placed.join(F.broadcast(table), on)
    n, length = F.col("mix_block") - F.col("first_block"), F.lit(max(period, 4 * len(blocks))).cast("long")
    at = F.get("slots", F.pmod(n, F.col("share")).cast("int"))
    return out.withColumns({
        "mix_release": F.col("first_slot") + F.floor(n * length / F.col("share")),
        "mix_deadline": F.col("first_slot") + F.ceil((n + 1) * length / F.col("share")),
        "mix_slot": (F.col("first_slot") + F.floor(n / F.col("share")) * length + at).cast("long"),
    })


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns named by ``carry`` (all without it), rows in the order of the mix.

    ``docs`` is evaluated up to five times: pass a table that is cheap to read. Places are taken on
    rows of hashes and sizes, which are stored; the documents learn their slots from the first
    hashes of each slot (a small broadcast row per ``BUCKET_CHARS`` characters) and are shuffled once, by
    the final sort. Only copies of a row that lie on both sides of an end of a block are
    shuffled before, to be numbered.
    """
    spark = docs.sparkSession
    keys = stored(_rows(docs, [id_col], id_col, text_col, source_col).drop("row"), "mix-keys")
    totals = _totals(keys)
    sums = F.broadcast(spark.createDataFrame([*totals.items()], "sum_source string, mix_total long"))

    def dealt(rows: DataFrame) -> DataFrame:
        bucket = rank_bucket(_ORDER, F.col("mix_total"), BUCKET_CHARS).alias("mix_bucket")
        return rows.join(sums, F.col("mix_source").eqNullSafe(F.col("sum_source"))).select(*rows.columns, bucket)

    places = _place(dealt(keys), totals, weights, block_chars, period).groupBy("mix_source", "mix_bucket", *_ORDER, "mix_slot").agg(F.count(F.lit(1)).alias("copies"))
    places = stored(places, "mix-places")
    key = F.struct(*_ORDER)
    slots = places.groupBy("mix_source", "mix_bucket", "mix_slot").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    torn = F.col("first").eqNullSafe(F.lag("last").over(Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_slot")))
    slots = stored(slots.withColumn("torn", torn), "mix-slots")
    starts = slots.groupBy(F.col("mix_source").alias("start_source"), F.col("mix_bucket").alias("start_bucket")).agg(F.sort_array(F.collect_list(F.struct("first", "mix_slot", "torn"))).alias("starts"))
    here = F.col("mix_source").eqNullSafe(F.col("start_source")) & (F.col("mix_bucket") == F.col("start_bucket"))
    start = F.element_at(F.filter("starts", lambda s: s["first"] <= key), -1)
    rows = dealt(_rows(docs, carry or docs.columns, id_col, text_col, source_col)).join(F.broadcast(starts), here).withColumn("start", start)
    between = F.col("start.torn") & (F.col("start.first") == key)
    out = rows.filter(~between).select("row", "mix_bucket", *_ORDER, "start.mix_slot")
    if not slots.filter("torn").isEmpty():
        out = out.union(_numbered(rows.filter(between), places))
    return out.orderBy("mix_slot", "mix_bucket", *_ORDER).select("row.*")


def _numbered(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Copies on both sides of an end of a block, as many of them in each slot as it has."""
    same = Window.partitionBy("mix_source", *_ORDER)
    upto = F.sum("copies").over(same.orderBy("mix_slot"))
    parts = places.withColumns({"parts": F.count(F.lit(1)).over(same), "upto": upto}).filter("parts > 1")
    parts = parts.select(F.col("mix_source").alias("part_source"), *[F.col(c).alias(f"part_{c}") for c in _ORDER], "mix_slot", "upto", "copies")
    nth = F.row_number().over(same.orderBy(*_ORDER))
    on = F.col("mix_source").eqNullSafe(F.col("part_source")) & (F.col("nth") > F.col("upto") - F.col("copies")) & (F.col("nth") <= F.col("upto"))
    for c in _ORDER:
        on = on & (F.col(c) == F.col(f"part_{c}"))
    return rows.withColumn("nth", nth).join(F.broadcast(parts), on).select("row", "mix_bucket", *_ORDER, "mix_slot")
