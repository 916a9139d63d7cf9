"""Joins, ranks and running totals: against plain forms, on skewed keys, and by plan."""

import random
import re
from datetime import date, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators.joins import (
    count_days_inside,
    count_disagreeing_pairs,
    interval_join,
    match_rows,
    missing_from,
)
from plumbline.operators.ordered import cut_groups, group_cuts, running_total, sort_once
from plumbline.operators.skew import group_hash, hot_groups, hot_pairs

START = date(2024, 1, 1)
day = st.integers(0, 120).map(lambda n: START + timedelta(days=n))
key = st.sampled_from(["a", "b", None])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def shared_plan(df):
    """The plan, in which a shuffle that is used again stands as ``ReusedExchange``."""
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    points=st.lists(st.tuples(key, day), max_size=8),
    spans=st.lists(st.tuples(key, day, day), max_size=8),
    bucket=st.sampled_from(["week", "month", "quarter", "year"]),
    how=st.sampled_from(["inner", "left"]),
)
def test_interval_join_buckets_change_nothing(spark, points, spans, bucket, how):
    p = spark.createDataFrame(points, "k string, d date")
    i = spark.createDataFrame([(*s, n) for n, s in enumerate(spans)], "k string, lo date, hi date, n int")
    span = (F.lit(START), F.lit(START + timedelta(days=120)))
    args = dict(on=["k"], point="d", low="lo", high="hi", how=how)
    expected = rows_of(interval_join(p, i, bucket=None, **args))
    assert rows_of(interval_join(p, i, bucket=bucket, **args)) == expected
    assert rows_of(interval_join(p, i, bucket=bucket, span=span, **args)) == expected


def test_interval_join_rejects_other_kinds(spark):
    df = spark.createDataFrame([], "k string, d date")
    with pytest.raises(ValueError):
        interval_join(df, df, ["k"], "d", "d", "d", how="full")


@pytest.mark.parametrize("tolerance", [None, "0.01", "0.03"])
@pytest.mark.parametrize("left_null", [False, True])
def test_counting_pairs_without_making_them(spark, tolerance, left_null):
    rng = random.Random(3)

    def side(name):
        rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 900, 50)])) for _ in range(150)]
        df = spark.createDataFrame(rows, f"k string, {name} int")
        return df.withColumn(name, (F.col(name).cast("decimal(9,0)") * F.expr("0.0001BD")).cast("decimal(12,4)"))

    left, right = side("a"), side("b")
    width = Decimal(tolerance) if tolerance else None
    gap = F.abs(F.col("a") - F.col("b")) > F.lit(width) if width else F.col("a") != F.col("b")
    expected = left.join(right, "k").where(gap | (F.col("a").isNull() & F.lit(left_null))).count()
    got = count_disagreeing_pairs(left, right, ["k"], "a", "b", width, left_null).first()["row_count"]
    assert got == expected


def test_counting_pairs_of_nothing(spark):
    none = spark.createDataFrame([], "k string, a int, b int")
    assert count_disagreeing_pairs(none, none, ["k"], "a", "b").first()["row_count"] == 0


def test_counting_very_many_pairs(spark):
    """Ten thousand million pairs take no longer than their rows."""
    many = spark.range(100_000).select(F.lit("k").alias("k"), F.lit(1).alias("a"), F.lit(2).alias("b"))
    assert count_disagreeing_pairs(many, many, ["k"], "a", "b").first()["row_count"] == 10**10


def test_more_pairs_than_a_bigint_holds(spark):
    """Four thousand million copies on each side, as counts: the number of pairs is beyond 2**63 and stays exact."""
    from functools import reduce

    from pyspark.sql import DataFrame

    copies = reduce(lambda a, _: a.unionByName(a), range(3), spark.range(1_000_000).select(F.lit("k").alias("k"), F.lit(1).alias("a")))
    other = copies.withColumnRenamed("a", "b").withColumn("b", F.lit(2))
    one = count_disagreeing_pairs(copies, other, ["k"], "a", "b")
    assert one.schema["row_count"].dataType.simpleString() == "decimal(38,0)"
    many = reduce(DataFrame.unionByName, [one] * 4).agg((F.sum("row_count") * 10**6).cast("decimal(38,0)").alias("n"))
    assert many.first()["n"] == 4 * 64 * 10**12 * 10**6 > 2**63


def test_hot_pairs_go_by_the_product_of_both_sides(spark):
    def side(**rows):
        return spark.createDataFrame([(k,) for k, n in rows.items() for _ in range(n)], "k string")

    left, right = side(a=50, b=100, c=2), side(a=50, b=1, c=900)
    hashes = {r["k"]: r["h"] for r in side(a=1, b=1, c=1).select("k", group_hash(["k"]).alias("h")).collect()}
    assert hot_pairs(left, right, ["k"], 1000) == sorted([hashes["a"], hashes["c"]])
    assert hot_pairs(left, right, ["k"], 10_000) == []


def test_missing_keeps_null_keys(spark):
    left = spark.createDataFrame([("k",), ("l",), (None,)], "k string")
    right = spark.createDataFrame([("k",), (None,)], "k string")
    assert rows_of(missing_from(left, right, ["k"])) == [("l",), (None,)]


def test_hot_groups(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 600, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    expected = spark.createDataFrame([("hot",)], "k string").select(group_hash(["k"])).first()[0]
    assert hot_groups(df, ["k"], 100) == [expected]
    assert hot_groups(df, ["k"], 10_000) == []
    assert hot_groups(df.where("k = 'none'"), ["k"], 1) == []


@pytest.mark.parametrize("parts", [1, 3, 40, None])
def test_running_total_in_chunks(spark, parts):
    """A group that holds most rows, also one with a null key, gives the plain running sum, however it is cut."""
    rng = random.Random(7)
    rows = [
        (rng.choice(["hot"] * 6 + [None] * 3 + ["x", "y"]), START + timedelta(days=rng.randrange(4)), n, rng.randrange(-5, 9))
        for n in range(900)
    ]
    df = spark.createDataFrame(rows, "k string, d date, n int, v int").withColumn("v", F.col("v").cast("decimal(9,2)"))
    window = Window.partitionBy("k").orderBy("d", "n").rowsBetween(Window.unboundedPreceding, 0)
    expected = rows_of(df.withColumn("s", F.sum("v").over(window)))
    cuts = {r["k"]: len(r["_cuts"]) for r in group_cuts(df, ["k"], ["d", "n"], parts).collect()}
    assert sum(cuts.values()) <= (parts or 4)
    assert parts != 40 or cuts["hot"] > 10 and cuts[None] > 5
    assert rows_of(running_total(df, ["k"], ["d", "n"], F.col("v"), "s", parts)) == expected


@pytest.mark.parametrize("step", [1, 10**9, 0])
def test_number_of_cuts_follows_the_rows(spark, step):
    """Sparse numbers are cut as often as dense ones; equal ones stay together."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * step).alias("n"), F.lit(1).alias("v"))
    (row,) = group_cuts(df, ["k"], ["n"], 20).collect()
    assert len(row["_cuts"]) == (20 if step else 1)
    total = running_total(df, ["k"], ["n"], F.col("v"), "s", 20).agg(F.max("s"), F.sum("s")).first()
    assert tuple(total) == (20_000, 20_000 * 20_001 // 2)


@pytest.mark.parametrize("parts", [1, 2, 5, 7, 8, 33])
def test_chunk_is_the_number_of_cuts_passed(spark, parts):
    """Any number of cuts up to ``parts``, repeated and null places, places equal to a cut, groups without cuts."""
    rng = random.Random(parts)
    places = [None, *range(0, 60, 2)]
    listed = {k: sorted(rng.sample(places, min(n, len(places))), key=lambda n: -1 if n is None else n)
              for k, n in (("a", parts), ("b", parts - 1), (None, 1)) if n}
    cuts = spark.createDataFrame(
        [(k, [(n, 0) for n in own]) for k, own in listed.items()], "k string, _cuts array<struct<n:int,m:int>>"
    )
    rows = [(k, n, m) for k in ("a", "b", None, "c") for n in (None, *range(-1, 61)) for m in (None, 0, 1)]
    df = spark.createDataFrame(rows * 2, "k string, n int, m int")

    def place(n, m):
        return tuple(-9 if x is None else x for x in (n, m))

    expected = [
        (k, n, m, sum(place(c, 0) <= place(n, m) for c in listed[k]) if k in listed else None) for k, n, m in rows * 2
    ]
    got = rows_of(cut_groups(df, cuts, ["k"], ["n", "m"], parts).select("k", "n", "m", "_chunk"))
    assert got == sorted(expected, key=str)


def test_running_total_makes_its_rows_twice(spark):
    """Once for the sample and once for one shuffle that sums and totals share, whatever columns are kept of them; no cut is
    looked up by an interpreted function."""
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", F.lit(1).alias("v"), F.lit("x").alias("more"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = shared_plan(running_total(df, ["k"], ["id"], F.col("v"), "s", 30).select("k", "s"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Range (") == 2
    assert plan.count("REPARTITION_BY_COL") == plan.count("ReusedExchange") + 1 == 2
    assert "filter(_cuts" not in plan


def test_a_group_with_a_third_of_all_rows_is_spread_over_tasks(spark, eager_skew):
    """Rows that each task of the last shuffle gets, with every key in the same place of one order column."""
    n = 30_000
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
    df = spark.range(0, n, 1, 6).select(key.alias("k"), F.lit(START).alias("d"), "id", F.lit(1).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        total = running_total(df, ["k"], ["d", "id"], F.col("v"), "s")
        hot = total.where("k = -1").groupBy(F.spark_partition_id().alias("p"))
        tasks = hot.agg(F.count("s").alias("n"), F.max("s")).collect()
        assert total.agg(F.max("s")).first()[0] == n // 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) > 5 and max(r["n"] for r in tasks) < n // 3 / 3


@pytest.mark.parametrize("on", [["k"], []])
def test_days_inside_ranges_against_a_range_join(spark, on):
    rng = random.Random(11)
    day = lambda: START + timedelta(days=rng.randrange(200))
    days = [(rng.choice("abc"), day()) for _ in range(60)] + [("z", START), (None, START)]
    ranges = [(rng.choice(["a", "b", "c", "y", None]), day(), day(), i) for i in range(300)]
    ranges += [("a", date(1000, 1, 1), date(9999, 12, 31), 900), ("a", None, day(), 901)]
    points = spark.createDataFrame(days * 2, "k string, day date")
    spans = spark.createDataFrame(ranges, "k string, low date, high date, i int")
    first, last = START + timedelta(days=10), START + timedelta(days=150)
    got = count_days_inside(spans, points, on, "day", "low", "high", (F.lit(first), F.lit(last)), "n")
    expected = [
        (k, a, b, i, len({d for j, d in days if (j == k or not on) and a and max(a, first) <= d <= min(b, last)}))
        for k, a, b, i in ranges
    ]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def eager_skew(spark):
    """Lets AQE see skew in small data."""
    settings_ = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in settings_}
    for k, v in settings_.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def skewed(spark, name, n=6000):
    hot = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
    return spark.range(0, n, 1, 8).select(hot.alias("k"), (F.col("id") % 97).alias(name))


def test_hot_match_key_is_split(spark, eager_skew):
    matched = match_rows(skewed(spark, "a"), skewed(spark, "b"), ["k"])
    plan = final_plan(matched.select("k", F.concat("a", "b").alias("c")).where("c = '1'"))
    assert plan.count("Exchange hashpartitioning") == 2 * plan.count("Initial Plan") + 2
    assert "skew=true" in plan
    assert matched.count() == 2000 * 2000 + 4000


def test_hot_interval_key_is_split(spark, eager_skew):
    points = spark.range(0, 31).select(F.lit("f").alias("k"), F.date_add(F.lit(START), F.col("id").cast("int")).alias("d"))
    spans = spark.range(0, 30_000, 1, 8).select(
        F.lit("f").alias("k"),
        F.lit(START).alias("lo"),
        F.date_add(F.lit(START), (F.col("id") % 3).cast("int")).alias("hi"),
        F.concat(F.lit("account"), F.sha2(F.col("id").cast("string"), 256)).alias("n"),
    )
    joined = interval_join(points, spans, ["k"], "d", "lo", "hi")
    assert "skew=true" in final_plan(joined.select("n", "d"))
    assert joined.count() == 60_000


def test_sort_reads_a_shuffle_twice_and_not_the_table(spark):
    plan = sort_once(spark.range(10).where("id > 3"), ["id"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
    assert "rangepartitioning" in plan


def test_days_of_whole_years_are_counted(spark):
    """Ranges over year ends, leap days and years without a day, open-ended ones too."""
    priced = {"a": [date(2020, 1, 1), date(2020, 2, 29), date(2020, 3, 2), date(2020, 12, 31), date(2023, 1, 1)], "b": [date(2021, 6, 30)]}
    days = spark.createDataFrame([(k, d) for k, ds in priced.items() for d in ds] + [("a", date(2020, 2, 29)), ("a", None)], "k string, d date")
    edges = [date(1, 1, 1), date(2019, 12, 31), *priced["a"], date(2020, 3, 3), date(2021, 6, 30), date(2022, 7, 1), date(9999, 12, 31)]
    ranges = [(k, low, high) for k in ("a", "b", "c") for low in edges for high in edges]
    first, last = date(2020, 1, 1), date(2023, 1, 1)
    found = count_days_inside(
        spark.createDataFrame(ranges, "k string, low date, high date"), days, ["k"], "d", "low", "high",
        (F.lit(first), F.lit(last)), "n",
    ).collect()
    assert len(found) == len(ranges)
    for r in found:
        assert r["n"] == sum(r["low"] <= d <= r["high"] for d in priced.get(r["k"], [])), r


def test_days_are_listed_by_year(spark):
    """A key with two days seven years apart is looked up in eight rows, not in one for each month between them."""
    days = spark.createDataFrame([(1, date(2014, 1, 1)), (1, date(2021, 12, 31))], "k int, d date")
    ranges = spark.createDataFrame([(1, date(2014, 1, 1), date(2021, 12, 31))], "k int, low date, high date")
    span = (F.lit(date(2014, 1, 1)), F.lit(date(2021, 12, 31)))
    counted = count_days_inside(ranges, days, ["k"], "d", "low", "high", span, "n")
    assert counted.first()["n"] == 2
    assert "year(" in counted._jdf.queryExecution().optimizedPlan().toString()
    assert "trunc(" not in counted._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("bucket", ["week", "month", "quarter", "year"])
def test_buckets_are_numbered_in_a_row(spark, bucket):
    from plumbline.operators.joins import bucket_number

    days = spark.sql("SELECT explode(sequence(date'1968-12-20', date'1972-03-05', interval 1 day)) AS d")
    rows = days.select("d", F.trunc("d", bucket).alias("start"), bucket_number(F.col("d"), bucket).alias("n")).orderBy("d").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        assert b["n"] - a["n"] == (1 if b["start"] != a["start"] else 0), b
