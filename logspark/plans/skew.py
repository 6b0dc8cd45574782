"""Join shapes that survive one key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS = 1_000_000
#: A key is hot from this share of all rows on, so there are at most 10,000 hot keys.
HOT_SHARE = 10_000


def splits_of(n: Column, hot_rows: int = HOT_ROWS) -> Column:
    """Slices for a key with ``n`` rows: one up to ``hot_rows``."""
    return F.greatest(F.ceil(n / hot_rows), F.lit(1)).cast("int")


def hot_keys(counts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of slices each is cut into.

    ``counts`` has the keys and ``n``. A hot key also holds more than one in ``HOT_SHARE`` of all
    rows, so there are fewer than ``HOT_SHARE`` of them and the result may be broadcast; what is
    lighter fits a task and stays in slice 0.
    """
    least = F.greatest(F.lit(hot_rows), counts.agg(F.sum("n") / HOT_SHARE).scalar())
    return counts.filter(F.col("n") > least).select(*keys, splits_of(F.col("n"), hot_rows).alias("_splits"))


def slice_rows(rows: DataFrame, hot: DataFrame, keys: list[str], slice_by: Column) -> DataFrame:
    """Adds ``_slice``: 0 for ordinary keys, a stable slice number for rows of hot keys.

    A row with a NULL in its key joins nothing, so such rows take any slice and spread out.
    """
    number = F.pmod(F.xxhash64(slice_by), F.col("_splits")).cast("int")
    no_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    anywhere = F.pmod(F.xxhash64(slice_by), F.lit(1 << 20)).cast("int")
    return (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_slice", F.when(no_key, anywhere).when(F.col("_splits").isNull(), F.lit(0)).otherwise(number))
        .drop("_splits")
    )


def copy_to_slices(rows: DataFrame, splits: Column) -> DataFrame:
    """One copy of every row for each of its ``splits`` slices; slice 0 always exists."""
    return rows.withColumn("_slice", F.explode(F.sequence(F.lit(0), splits - 1)))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    slice_by: Column,
    how: str = "inner",
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join where a hot key of ``big`` is cut into slices and ``small`` is copied per slice.

    ``slice_by`` must be a stable expression that differs between rows of one key (an event
    key), so a retried task gives every row the same slice. ``how`` is inner, left, left_semi
    or left_anti with ``big`` on the left. Without ``counts`` the rows of ``big`` are counted
    per key; a ``small`` table that already holds the count of its key in ``n`` saves that pass.
    """
    if "n" in small.columns and counts is None:
        hot = hot_keys(small.select(*keys, "n"), keys, hot_rows)
        right = copy_to_slices(small, splits_of(F.col("n"), hot_rows)).drop("n")
    else:
        if counts is None:
            counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        hot = hot_keys(counts, keys, hot_rows)
        marked = small.join(F.broadcast(hot), keys, "left")
        right = copy_to_slices(marked, F.coalesce("_splits", F.lit(1))).drop("_splits")
    left = slice_rows(big, hot, keys, slice_by)
    return left.join(right, [*keys, "_slice"], how).drop("_slice")
