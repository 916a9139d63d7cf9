"""Joins: record match, interval join, one-sided keys."""

from __future__ import annotations

from datetime import date
from decimal import Decimal
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Numbers of pairs.
PAIRS = "decimal(38,0)"


def match_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner match of two tables on ``keys``, one row per pair.

    A plain equi-join: one shuffle per side directly below it, so AQE splits a frequent key on either side, and none
    for tables bucketed by the key. Keys whose pairs are too many to go through are counted by
    ``count_disagreeing_pairs`` instead.
    """
    return left.join(right, keys)


def count_disagreeing_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_value: str,
    right_value: str,
    tolerance: Decimal | None = None,
    left_null_counts: bool = False,
) -> DataFrame:
    """Number of row pairs of equal ``keys`` whose values disagree, as column ``row_count``.

    For keys with so many rows that their pairs cannot be gone through. All pairs of a key
    are a product of two counts; the pairs that agree are found by an equi-join on the
    value, or on a band of the width of ``tolerance``, where only few values meet. What is
    left disagrees. Nulls disagree with nothing, except a null on the left with
    ``left_null_counts``. The number is a decimal, as it may be beyond the range of bigint.
    """
    wide = "decimal(19,0)"

    def counted(df: DataFrame, value: str, rows: str) -> DataFrame:
        return df.groupBy(*keys, F.col(value).alias(f"_{rows}_value")).agg(F.count(F.lit(1)).cast(wide).alias(rows))

    lefts, rights = counted(left, left_value, "l"), counted(right, right_value, "r")
    lv, rv = F.col("_l_value"), F.col("_r_value")

    def sizes(df: DataFrame, rows: str) -> DataFrame:
        known = F.when(F.col(f"_{rows}_value").isNotNull(), F.col(rows)).otherwise(F.lit(0))
        return df.groupBy(*keys).agg(
            F.sum(known).cast(wide).alias(f"{rows}_known"), F.sum(rows).cast(wide).alias(f"{rows}_all")
        )

    compared = F.col("l_known") * F.col("r_known")
    if left_null_counts:
        compared = compared + (F.col("l_all") - F.col("l_known")) * F.col("r_all")
    every = sizes(lefts, "l").join(sizes(rights, "r"), keys).select(compared.alias("pairs"))

    if tolerance:
        # Values no further apart than the tolerance lie in the same or a neighbouring band;
        # two neighbours on each side leave room for a rounded quotient.
        width = F.lit(tolerance)
        lefts = lefts.withColumn("_band", F.floor(lv / width))
        rights = rights.withColumn("_band", F.explode(F.array(*[F.floor(rv / width) + i for i in range(-2, 3)])))
        met = lefts.join(rights, [*keys, "_band"]).where(F.abs(lv - rv) <= width)
    else:
        lefts, rights = (d.withColumn("_same", v) for d, v in ((lefts, lv), (rights, rv)))
        met = lefts.join(rights, [*keys, "_same"])
    agreeing = met.select((-F.col("l") * F.col("r")).alias("pairs"))

    off = F.coalesce(F.sum("pairs").cast(PAIRS), F.lit(0).cast(PAIRS))
    return every.unionByName(agreeing).agg(off.alias("row_count"))


def missing_from(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key has no row in ``right``; a null key is never found."""
    return left.join(right.select(*keys), keys, "left_anti")


# Days that a word of bits holds; the sign bit stays free.
_WORD = 62


def count_days_inside(
    ranges: DataFrame,
    days: DataFrame,
    on: list[str],
    day: str,
    low: str,
    high: str,
    span: tuple[Column, Column],
    name: str,
) -> DataFrame:
    """Add ``name``: how many different days of ``days`` lie in each closed range, within equal ``on`` keys.

    Two lookups by equal keys instead of a range join: a year of a key holds its days as bits and the number of days
    before it, so the days up to any date are one row away, and a range is the difference of its ends. Ranges are taken
    within ``span``, first and last day that count. A key without days, and a range that is empty or lacks an end, count 0.
    """
    first, last = span
    lowest, highest = F.greatest(F.col(low), first), F.least(F.col(high), last)
    one = F.lit(1).cast("bigint")
    place = F.dayofyear(day) - 1
    bit = F.call_function("shiftleft", one, place % _WORD)
    words = [f"_days{i}" for i in range(366 // _WORD + 1)]
    # Days outside of the span change nothing: those before it are in both numbers, those after it in neither.
    years = days.where(F.col(day).isNotNull()).groupBy(*on, F.year(day).alias("_year")).agg(
        *[F.bit_or(F.when(F.floor(place / _WORD) == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(w) for i, w in enumerate(words)]
    )
    of_year = reduce(add, [F.bit_count(w) for w in words])
    ordered = Window.partitionBy(*on).orderBy("_year")
    before = F.coalesce(F.sum(of_year).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    until = F.coalesce(F.lead("_year").over(ordered) - 1, F.year(last))
    own = F.col("_at") == F.col("_year")
    # Years without a day of their own are listed with what came before them.
    dense = (
        years.withColumns({"_before": before, "_until": until})
        .withColumn("_at", F.explode(F.sequence(F.col("_year"), F.greatest("_year", "_until"))))
        .select(
            *on,
            "_at",
            F.when(own, F.col("_before")).otherwise(F.col("_before") + of_year).alias("_before"),
            *[F.when(own, F.col(w)).otherwise(F.lit(0).cast("bigint")).alias(w) for w in words],
        )
    )

    def upto(rows: DataFrame, date: Column, bits: Column, found: str) -> DataFrame:
        """Days up to a date: those of earlier years, and the lowest ``bits`` of its own year."""
        year = dense.select(
            *(F.col(k).alias(f"_{k}") for k in on), "_at", F.struct("_before", *words).alias("_found")
        )
        same = [F.col(k) == F.col(f"_{k}") for k in on] + [F.year(date) == F.col("_at")]

        def lowest_bits(i: int) -> Column:
            number = F.least(F.greatest(bits - _WORD * i, F.lit(0)), F.lit(_WORD))
            return F.call_function("shiftleft", one, number) - 1

        inside = [F.bit_count(F.col(f"_found.{w}").bitwiseAND(lowest_bits(i))) for i, w in enumerate(words)]
        joined = rows.join(year, reduce(and_, same), "left")
        number = F.col("_found._before") + reduce(add, inside)
        return joined.withColumn(found, F.coalesce(number, F.lit(0))).select(*rows.columns, found)

    ends = upto(ranges, highest, F.dayofyear(highest), "_to")
    both = upto(ends, lowest, F.dayofyear(lowest) - 1, "_from")
    whole = F.col(low).isNotNull() & F.col(high).isNotNull()
    inside = F.when(whole & (lowest <= highest), F.col("_to") - F.col("_from")).otherwise(F.lit(0))
    return both.withColumn(name, inside.cast("bigint")).drop("_from", "_to")


# A Monday: weeks are numbered from it.
_FIRST_WEEK = date(1970, 1, 5)


def bucket_number(day: Column, bucket: str) -> Column:
    """Months, quarters, years or weeks numbered in a row: listing numbers costs far less than listing dates by interval."""
    year = F.year(day)
    return {
        "month": year * 12 + F.month(day),
        "quarter": year * 4 + F.quarter(day),
        "year": year,
        "week": F.floor(F.datediff(day, F.lit(_FIRST_WEEK)) / 7).cast("int"),
    }[bucket]


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: list[str],
    point: str,
    low: str,
    high: str,
    how: str = "inner",
    bucket: str | None = "month",
    span: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Join each point to the intervals ``[low, high]`` (closed) that hold it, within equal ``on`` keys.

    ``how`` is "inner" or "left" (all points are kept). ``on`` columns come out once.

    With a ``bucket`` ("month", "quarter", "year", "week") every interval is listed under
    the buckets it touches and the bucket joins the equi key: a key with long history is
    spread over many tasks, and each row meets the points of one bucket only. A point lies
    in one bucket, so no pair can occur twice. ``span`` limits the listing to the range
    that points can have; give it whenever intervals may be open-ended. The listing is
    never broadcast: Spark's size estimate doesn't know how many rows it makes of one.
    Points that have their ``bucket_number`` as ``_bucket`` already, and lie by the keys and
    it, aren't shuffled for the join.

    Without a bucket the range is tested within the equi key. That suits dimensions with
    few intervals per key.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', got {how!r}")
    keys = list(on)
    if bucket:
        first, last = F.col(low), F.col(high)
        if span:
            first, last = F.greatest(first, span[0]), F.least(last, span[1])
        starts = F.when(first <= last, F.sequence(bucket_number(first, bucket), bucket_number(last, bucket)))
        intervals = intervals.withColumn("_bucket", F.explode(starts))
        if "_bucket" not in points.columns:
            points = points.withColumn("_bucket", bucket_number(F.col(point), bucket))
        keys = keys + ["_bucket"]
        intervals = intervals.hint("merge")

    p, i = points.alias("p"), intervals.alias("i")
    equal = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in keys]
    inside = F.col(f"p.{point}").between(F.col(f"i.{low}"), F.col(f"i.{high}"))
    joined = p.join(i, reduce(and_, equal) & inside, how)
    kept = [F.col(f"p.{c}") for c in points.columns if c != "_bucket"]
    added = [F.col(f"i.{c}") for c in intervals.columns if c not in keys and c != "_bucket"]
    return joined.select(*kept, *added)
