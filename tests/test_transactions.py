"""Month-end window, ranks, signs, balances and transfer legs on hand-made rows."""

from datetime import date
from decimal import Decimal

import pytest
from conftest import DATA
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import group_cuts
from plumbline.plans import transactions as t
from plumbline.sources.star import star_tables

SCHEMA = (
    "investor_id int, account_id int, fund_code int, company string, trade_date date, order_id bigint, line_number int, leg int,"
    " unit_factor int, direction string, units decimal(18,4), price decimal(18,4), gross decimal(18,2), status_code int"
)


@pytest.fixture
def trx(spark):
    def make(*rows):
        base = dict(investor_id=1, account_id=1, fund_code=1, company="C", trade_date=date(2025, 1, 31), order_id=1, line_number=1,
                    leg=0, unit_factor=1, direction="IN", units=Decimal(1), price=Decimal(2), gross=Decimal(2),
                    status_code=1)
        names = [c.split()[0] for c in SCHEMA.replace("(18,4)", "").replace("(18,2)", "").split(",")]
        return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], SCHEMA)

    return make


def days(*ds):
    return [dict(trade_date=date.fromisoformat(d), order_id=i) for i, d in enumerate(ds)]


def test_window_sides(trx):
    rows = trx(*days("2025-01-20", "2025-01-21", "2025-01-31", "2025-02-01", "2025-02-10", "2025-02-11"))
    got = [(r["order_id"], str(r["month_end"]), r["window_side"]) for r in t.month_end_window(rows).collect()]
    assert sorted(got) == [
        (1, "2025-01-31", "PRE"), (2, "2025-01-31", "PRE"), (3, "2025-01-31", "POST"), (4, "2025-01-31", "POST"),
    ]


def test_wide_window_lists_a_row_for_each_month_end(trx):
    got = t.month_end_window(trx(*days("2025-02-14")), days=20).collect()
    assert sorted((str(r["month_end"]), r["window_side"]) for r in got) == [
        ("2025-01-31", "POST"), ("2025-02-28", "PRE"),
    ]


def test_rank_counts_dates_that_occur(trx):
    rows = trx(*days("2025-01-22", "2025-01-27", "2025-01-27", "2025-01-31", "2025-02-03", "2025-02-07"))
    got = {r["order_id"]: r["biz_day_rank"] for r in t.business_day_rank(t.month_end_window(rows)).collect()}
    assert got == {0: 3, 1: 2, 2: 2, 3: 1, 4: 1, 5: 2}


def test_signed_gross(trx):
    got = t.signed_gross(trx(dict(order_id=1), dict(order_id=2, direction="OUT"))).orderBy("order_id").collect()
    assert [r["signed_gross"] for r in got] == [2, -2]


def test_status_lookup_keeps_unknown_codes(spark, trx):
    statuses = spark.createDataFrame(
        [(9, "REDTR", "text", "N")],
        "status_code int, status_mnemonic string, status_description string, allows_order_entry string",
    )
    got = t.add_status(trx(dict(order_id=1, status_code=9), dict(order_id=2, status_code=7)), statuses).orderBy("order_id")
    assert [(r["status_mnemonic"], r["allows_order_entry"]) for r in got.collect()] == [("REDTR", "N"), (None, None)]


def test_balances_roll_forward(trx):
    rows = trx(dict(order_id=1, units=Decimal(5)), dict(order_id=2, units=Decimal(2), unit_factor=-1), dict(order_id=3))
    got = t.running_balance(rows).orderBy("order_id")
    assert [(r["open_balance"], r["close_balance"]) for r in got.collect()] == [(0, 5), (5, 3), (3, 4)]
    assert t.roll_forward_exceptions(got).count() == 0
    wrong = got.withColumn("close_balance", F.col("close_balance") + F.when(F.col("order_id") == 2, 1).otherwise(0))
    (row,) = t.roll_forward_exceptions(wrong).collect()
    assert (row["order_id"], row["gap"]) == (2, -1)


def hot_third(trx, **columns):
    third = F.col("order_id") % 3 == 0
    return trx.withColumns({c: F.when(third, F.lit(v)).otherwise(F.col(c)).cast(trx.schema[c].dataType) for c, v in columns.items()})


def test_hot_account_gives_the_same_balances(spark):
    """One account and fund with a third of all rows, cut into ranges of its order or not."""
    hot = hot_third(star_tables(spark, DATA)["trx"], account_id=7, fund_code=7)
    cuts = group_cuts(hot, t.BALANCE_KEYS, t.BALANCE_ORDER, 60).collect()
    assert [(r["account_id"], r["fund_code"]) for r in cuts] == [(7, 7)] and len(cuts[0]["_cuts"]) > 10
    window = Window.partitionBy(*t.BALANCE_KEYS).orderBy(*t.BALANCE_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    plain = hot.withColumn("close", F.sum(F.col("units") * F.col("unit_factor")).over(window))
    expected = sorted((r["order_id"], r["line_number"], r["leg"], r["close"]) for r in plain.collect())
    for parts in (1, 60):
        rows = t.running_balance(hot, parts).collect()
        assert sorted((r["order_id"], r["line_number"], r["leg"], r["close_balance"]) for r in rows) == expected


def test_hot_group_of_legs_gives_the_same_surplus(spark):
    """A third of all legs without an investor, at one amount on one day; and a mix of small groups."""
    trx = star_tables(spark, DATA)["trx"]
    hot = hot_third(trx, investor_id=None, gross=0, trade_date=date(2021, 1, 4))
    rows = [r.asDict() for r in hot.collect()]
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in t.TRANSFER_KEYS), {True: [], False: []})[r["unit_factor"] < 0].append(r)
    expected = []
    for sides in groups.values():
        for side in (True, False):
            own = sorted(sides[side], key=lambda r: tuple(r[c] for c in t.LEG_ORDER))
            expected += [(r["order_id"], r["line_number"], r["leg"]) for r in own[len(sides[not side]) :]]
    for parts in (1, 60):
        found = t.transfer_unmatched(hot, parts).collect()
        assert sorted((r["order_id"], r["line_number"], r["leg"]) for r in found) == sorted(expected)
    assert len(group_cuts(hot, t.TRANSFER_KEYS, t.LEG_ORDER, 60).first()["_cuts"]) > 10


def test_unmatched_legs_are_made_twice_and_sorted_once(spark, trx):
    """Once for the sample and once for one shuffle, which the counts of ranges read, too; one order gives all numbers."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = t.transfer_unmatched(trx(dict(order_id=1), dict(order_id=2, unit_factor=-1), dict(order_id=3)))
        plan = found.select("order_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r["order_id"] for r in found.collect()] == [3]
    assert plan.count("Scan ExistingRDD") == 2 and plan.count("ReusedExchange") == 1
    assert plan.count("Window [row_number()") == 1 and plan.count("Window [") == 3


def test_legs_without_a_factor_come_in(trx):
    """Each side in order, also with legs of no factor; a group cut into ranges or not."""
    factors = [-1, None, 1, -1, -1, None, -1, -1, 1, -1] * 30
    rows = trx(*(dict(order_id=n, unit_factor=f) for n, f in enumerate(factors)))
    out = [n for n, f in enumerate(factors) if f == -1]
    expected = out[len(factors) - len(out) :]
    for parts in (1, 7, 14):
        assert sorted(r["order_id"] for r in t.transfer_unmatched(rows, parts).collect()) == expected


def test_gross_exceptions(trx):
    rows = trx(dict(order_id=1), dict(order_id=2, gross=Decimal("2.02")), dict(order_id=3, gross=Decimal("2.01")))
    (row,) = t.gross_exceptions(rows).collect()
    assert (row["order_id"], row["variance"]) == (2, Decimal("0.02"))


def test_direction_exceptions(trx):
    rows = t.running_balance(
        trx(dict(order_id=1, direction="OUT"), dict(order_id=2), dict(order_id=3, direction="OUT", units=Decimal(0)))
    )
    (row,) = t.direction_exceptions(rows).collect()
    assert (row["order_id"], row["balance_direction"]) == (1, "IN")


def test_transfer_legs(trx):
    """Legs meet by investor, whatever their accounts; legs beyond the other side's number stay."""
    rows = trx(
        dict(order_id=1, unit_factor=-1),
        dict(order_id=2, account_id=11),
        dict(order_id=3, investor_id=2, account_id=2, unit_factor=-1),
        dict(order_id=4, investor_id=2, account_id=3, fund_code=9),
        dict(order_id=5, investor_id=3),
        dict(order_id=6, investor_id=4, unit_factor=-1),
        dict(order_id=7, investor_id=4, trade_date=date(2025, 2, 1)),
        dict(order_id=8, investor_id=5, unit_factor=-1),
        dict(order_id=9, investor_id=5, unit_factor=-1, account_id=6),
        dict(order_id=10, investor_id=5, account_id=7),
    )
    pairs = {r["investor_id"]: (r["matched_legs"], r["cross_fund"]) for r in t.transfer_pairs(rows).collect()}
    assert pairs == {1: (1, False), 2: (1, True), 5: (1, False)}
    assert sorted(r["order_id"] for r in t.transfer_unmatched(rows).collect()) == [5, 6, 7, 9]


def test_unknown_types_are_counted(spark, trx):
    types = spark.createDataFrame([("A",)], "trx_code string")
    rows = trx(dict(order_id=1), dict(order_id=2), dict(order_id=3)).withColumn(
        "trx_code", F.element_at(F.array(F.lit("A"), F.lit("X"), F.lit(None)), F.col("order_id").cast("int"))
    )
    assert sorted(map(tuple, t.untyped(rows, types).collect()), key=str) == [("X", 1), (None, 1)]


def test_report_order(spark, trx):
    """Month end, PRE before POST, then day, company, fund, account and order."""
    rows = trx(
        dict(order_id=1, trade_date=date(2025, 2, 3)), dict(order_id=2), dict(order_id=3, fund_code=0),
        dict(order_id=4, trade_date=date(2025, 1, 30)), dict(order_id=5, company="A"), dict(order_id=6, account_id=0),
    )
    statuses = spark.createDataFrame([(1, "A")], "status_code int, status_mnemonic string")
    assert [r["order_id"] for r in t.month_end_report(rows, statuses).collect()] == [4, 5, 3, 6, 2, 1]


def test_totals(trx):
    rows = trx(dict(order_id=1), dict(order_id=2, direction="OUT", gross=Decimal(5)))
    (row,) = t.month_end_totals(rows).collect()
    assert (row["trx_count"], row["signed_gross"], row["window_side"]) == (2, -3, "PRE")


def test_every_operator_takes_no_rows(spark, trx):
    empty = trx()
    tables = star_tables(spark, DATA)
    assert t.month_end_report(empty, tables["fund_status"]).count() == 0
    assert t.month_end_totals(empty).count() == 0
    assert t.running_balance(empty).count() == 0
    assert t.transfer_pairs(empty).count() == t.transfer_unmatched(empty).count() == 0
