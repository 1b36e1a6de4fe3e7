"""Ordered per-key computations that do not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sorts every row of a key in one task, which
fails when one key holds a large part of the table. These helpers cut each key
into blocks, work inside blocks, and carry only one row per block across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_max_before(
    df: DataFrame, keys: list[str], order: list[str], block: Column, value: str, out: str
) -> DataFrame:
    """Add ``out``: the greatest ``value`` of earlier rows of the same key.

    ``block`` must not decrease along ``order`` within a key.
    """
    df = df.withColumn("_block", block)
    per_block = df.groupBy(*keys, "_block").agg(F.max(value).alias("_top"))
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = per_block.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_block").alias("_b"),
        F.max("_top").over(across).alias("_carry"),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    here = df.withColumn("_inside", F.max(value).over(inside))
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        here.join(carried, same, "left")
        .withColumn(out, F.greatest("_inside", "_carry"))
        .drop("_block", "_b", "_inside", "_carry", *[f"_k_{k}" for k in keys])
    )


def first_ranks(
    df: DataFrame, keys: list[str], order: list[str], limit: str, out: str, salts: int = 64
) -> DataFrame:
    """Number the rows of each key and keep those up to the column ``limit``.

    Rows are first cut down inside hashed slices of the key, so the last step
    sees at most ``salts * limit`` rows of a key.
    """
    slice_ = F.pmod(F.xxhash64(*order), F.lit(salts))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    cut = (
        df.withColumn("_slice", slice_)
        .withColumn(out, F.row_number().over(inner))
        .filter(F.col(out) <= F.col(limit))
    )
    return (
        cut.withColumn(out, F.row_number().over(outer))
        .filter(F.col(out) <= F.col(limit))
        .drop("_slice")
    )


def grouped_median(
    df: DataFrame, key: str, value: str, out: str, shift: int = 20
) -> DataFrame:
    """Exact interpolated median of a non-negative integer per key."""
    rows = df.filter(F.col(value).isNotNull()).select(key, value, F.lit(1).cast("long").alias("_n"))
    return counted_median(rows, key, value, "_n", out, shift)


def counted_median(
    df: DataFrame, key: str, value: str, count: str, out: str, shift: int = 20
) -> DataFrame:
    """Exact interpolated median per key of values that stand for ``count`` rows each.

    Counts of one value add up and may be negative; values without rows left do not
    take part. Counts go by coarse value range first; only the one or two ranges around
    the middle are then counted by value. A window therefore covers the ranges of a
    key, or the values of one range (at most ``2**shift``), never its rows.
    """
    counts = (
        df.groupBy(key, value)
        .agg(F.sum(count).alias("_n"))
        .filter("_n > 0")
        .withColumn("_range", F.shiftright(value, shift))
    )
    ranges = counts.groupBy(key, "_range").agg(F.sum("_n").alias("_rn"))
    by_key = Window.partitionBy(key)
    upto = by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_rn").over(by_key)
    middle = (
        ranges.withColumn("_total", total)
        .withColumn("_before", F.sum("_rn").over(upto) - F.col("_rn"))
        .withColumn("_lo", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_hi", F.floor(F.col("_total") / 2) + 1)
        .filter(
            (F.col("_before") < F.col("_hi")) & (F.col("_lo") <= F.col("_before") + F.col("_rn"))
        )
        .select(key, "_range", "_before", "_lo", "_hi")
    )
    in_range = Window.partitionBy(key, "_range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = (
        counts.join(middle, [key, "_range"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(in_range))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
    )

    def at(rank: str) -> Column:
        hit = (F.col("_from") < F.col(rank)) & (F.col(rank) <= F.col("_upto"))
        return F.max(F.when(hit, F.col(value)))

    return placed.groupBy(key).agg(((at("_lo") + at("_hi")) / 2.0).alias(out))
