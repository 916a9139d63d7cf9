"""Ranks and running totals over ordered groups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_once(rows: DataFrame, order: list[Column | str], spread: list[str]) -> DataFrame:
    """Global sort of a small part of a large table.

    A global sort samples its input first, which would read the large table twice. A
    shuffle of the few rows in front is read twice instead. ``rebalance`` lets AQE merge
    its small partitions and split the large ones.
    """
    return rows.hint("rebalance", *spread).orderBy(*order)


def rank_dates(df: DataFrame, groups: list[str], day: str, distance: Column, name: str) -> DataFrame:
    """Dense rank of the dates in each group by ``distance``; equal dates share a rank.

    Only distinct dates are ranked. They are calendar days, a few for each group of month and side; whether they are
    small enough to be broadcast is left to Spark, as junk dates could be many.
    """
    window = Window.partitionBy(*groups).orderBy(distance)
    ranks = df.select(*groups, day).distinct().withColumn(name, F.dense_rank().over(window))
    return df.join(ranks, [*groups, day])


# Rows that are looked at for each cut, about.
SAMPLES = 20


def same_group(left: str, right: str, keys: list[str]) -> Column:
    """Equal keys of two aliased tables; null keys are a group, too."""
    return reduce(and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def group_cuts(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``keys`` and ``_cuts``: the order values at which groups are cut that hold more than about one part in ``parts``
    of all rows (the session's shuffle partitions, if not given). There are at most ``parts`` cuts in all.

    Part of the query that uses them, so no job runs beforehand. The rows with the smallest hashes of key and order
    values are a sample of fixed size, whatever the table's; every ``SAMPLES``-th of them within a group is a cut. The
    same rows always give the same cuts, as often as they are taken.
    """
    parts = parts or _parts(rows)
    mark = F.xxhash64(*keys, *order)
    sample = (
        rows.select(*keys, F.struct(*order).alias("_place"), mark.alias("_mark"))
        .orderBy("_mark", *keys, "_place")
        .limit(SAMPLES * parts)
    )
    listed = sample.groupBy(*keys).agg(F.array_sort(F.collect_list("_place")).alias("_all"))
    every = F.array_distinct(F.filter("_all", lambda x, i: i % SAMPLES == SAMPLES - 1))
    return listed.select(*keys, every.alias("_cuts")).where(F.size("_cuts") > 0)


def cut_groups(
    rows: DataFrame, cuts: DataFrame, keys: list[str], order: list[str], parts: int | None = None
) -> DataFrame:
    """Add ``_chunk``, the number of cuts at or before a row's place, and bring the rows of each chunk together; null in
    groups without cuts. Rows that are equal in all order columns stay together. ``parts`` as for ``group_cuts``.

    Rows are shuffled here, by keys and chunk, so that all uses of the result read one shuffle, if they take the same
    columns (``all_columns``).
    """
    # At most as many rows as there are cuts.
    joined = rows.alias("r").join(F.broadcast(cuts.alias("c")), same_group("r", "c", keys), "left")
    has_cuts = F.col("c._cuts").isNotNull()
    own = F.when(has_cuts, F.struct(*[F.col(f"r.{c}") for c in order]))
    found = joined.select("r.*", "c._cuts", own.alias("_own"), F.when(has_cuts, 0).alias("_chunk"))
    # Binary search in compiled code, a bit of the number at a time: a lambda over all cuts is interpreted, and takes time in
    # proportion to their number.
    at = F.col("_chunk")
    for bit in reversed(range((parts or _parts(rows)).bit_length())):
        passed = F.get("_cuts", at.bitwiseOR(2**bit - 1)) <= F.col("_own")
        found = found.withColumn("_chunk", at.bitwiseOR(F.when(passed, 2**bit).otherwise(0)))
    return found.drop("_cuts", "_own").repartition(*keys, "_chunk")


def all_columns(rows: DataFrame) -> DataFrame:
    """The same rows, made as one value, so that no column of theirs is dropped and no filter applied in front of it."""
    return rows.select(F.inline(F.array(F.struct("*"))))


def chunk_offsets(chunked: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """For each chunk of the groups with cuts and each sum by name: what the chunks before it hold (``_before_…``) and
    what the whole group holds (``_all_…``). There are at most twice as many chunks as cuts."""
    totals = all_columns(chunked).where(F.col("_chunk").isNotNull()).groupBy(*keys, "_chunk").agg(
        *(F.sum(amount).alias(name) for name, amount in sums.items())
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys,
        "_chunk",
        *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums),
        *(F.sum(n).over(group).alias(f"_all_{n}") for n in sums),
    )


def add_offsets(rows: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the columns of their chunk's offsets, null in groups without cuts."""
    added = [F.col(f"o.{c}") for c in offsets.columns if c not in (*keys, "_chunk")]
    joined = rows.alias("r").join(F.broadcast(offsets.alias("o")), same_group("r", "o", [*keys, "_chunk"]), "left")
    return joined.select("r.*", *added)


def running_total(
    df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str, parts: int | None = None
) -> DataFrame:
    """Running sum of ``amount`` within ``keys``, in ``order``.

    A group is one window partition, unless it holds more rows than a task should: then it is cut into ranges of its
    order values (``group_cuts``), each range is a window partition, and what the earlier ranges sum to is added. So a
    group's size bounds no task, and there is no search for large groups beforehand. Results are the same either way.
    """
    chunked = cut_groups(df, group_cuts(df, keys, order, parts), keys, order, parts)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = all_columns(chunked.withColumn("_running", F.sum(amount).over(inside)))
    kind = running.schema["_running"].dataType
    offsets = chunk_offsets(chunked, keys, sum=amount)
    total = F.col("_running") + F.coalesce(F.col("_before_sum"), F.lit(0)).cast(kind)
    return add_offsets(running, offsets, keys).select(*df.columns, total.cast(kind).alias(name))
