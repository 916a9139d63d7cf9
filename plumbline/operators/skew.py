"""Finding groups too large for one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sketch is taken apart for this many slices of the keys, so that merging is spread
# over as many tasks. Each slice tracks SLICE_TRACKED groups and reports SLICE_TOP.
SLICES = 16
SLICE_TRACKED = 4096
SLICE_TOP = 256


def group_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def hot_groups(df: DataFrame, keys: list[str], min_rows: int) -> list[int]:
    """Hashes of the groups with about ``min_rows`` rows or more.

    One scan of the key columns with a frequent-items sketch in every task; only the
    sketches are moved. At most SLICES * SLICE_TOP numbers reach the driver. A group with
    more than a fifty-thousandth of all rows is found for certain, smaller ones likely.
    The list is taken once, so every use of it (and every rerun of a lost task) treats the
    same groups as hot. A group it misses is handled like any other: results never depend
    on it.
    """
    hashed = df.select(group_hash(keys).alias("h"))
    tops = hashed.groupBy(F.pmod("h", F.lit(SLICES)).alias("slice")).agg(
        F.expr(f"approx_top_k(h, {SLICE_TOP}, {SLICE_TRACKED})").alias("top")
    )
    found = tops.select(F.explode("top").alias("g")).where(F.col("g.count") >= min_rows)
    return sorted(row["h"] for row in found.select(F.col("g.item").alias("h")).collect())


def is_hot(keys: list[str], hot: list[int]) -> Column:
    return group_hash(keys).isin(hot) if hot else F.lit(False)


def hot_pairs(left: DataFrame, right: DataFrame, keys: list[str], min_pairs: int) -> list[int]:
    """Hashes of the groups whose rows on the left times those on the right are ``min_pairs`` or more.

    One of the two sides has the square root of that number at least, so the groups to look at come from a sketch of
    each side; their rows are then counted exactly. Only bounded lists reach the driver.
    """
    least = max(1, math.isqrt(min_pairs))
    found = sorted({*hot_groups(left, keys, least), *hot_groups(right, keys, least)})
    if not found:
        return []

    def counted(df: DataFrame, rows: str) -> DataFrame:
        return df.select(group_hash(keys).alias("h")).where(F.col("h").isin(found)).groupBy("h").agg(F.count("*").alias(rows))

    both = counted(left, "l").join(counted(right, "r"), "h").where(F.col("l") * F.col("r") >= min_pairs)
    return sorted(row["h"] for row in both.select("h").collect())
