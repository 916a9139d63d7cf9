"""The source rebuild on hand-made rows."""

from datetime import date, timedelta
from decimal import Decimal

import pytest

from plumbline.plans import rebuild
from plumbline.sources.tables import TableSet

D = date
PRICE = "fund_code string, management_company_code string, fund_price_date date, fund_price decimal(12,4), fund_price_currency string"
FX = "currency_exchange_date date, currency_exchange_rate decimal(8,4)"
MONTHLY = "account_id string, management_company_code string, fund_code string, file_date string, shares_owned_amount decimal(12,4)"
DAILY = "account_id string, management_company_code string, fund_code string, shares_owned_amount decimal(12,4), effective_date date, end_date date"
ACCOUNT = "account_id string, management_company_code string, dealer_code string, effective_date date, end_date date"


@pytest.fixture
def raw(spark):
    def make(price=(), fx=(), monthly=(), daily=(), account=()):
        return TableSet.from_frames(
            {
                "fund_price": spark.createDataFrame(list(price), PRICE),
                "usd_fx_rate": spark.createDataFrame(list(fx), FX),
                "fund_position_monthly": spark.createDataFrame(list(monthly), MONTHLY),
                "fund_position_daily": spark.createDataFrame(list(daily), DAILY),
                "fund_account": spark.createDataFrame(list(account), ACCOUNT),
            }
        )

    return make


TEN, TWO, RATE = Decimal(10), Decimal(2), Decimal("1.3")
SEP30 = D(2025, 9, 30)


def test_home_price(cfg, raw):
    tables = raw(
        price=[
            ("F1", "MAX", SEP30, TWO, "C"),
            ("F2", "MAX", SEP30, TWO, "U"),
            ("F3", "MAX", D(2025, 10, 1), TWO, "U"),
            ("F4", "MAX", SEP30, None, "C"),
            ("F5", "MAX", SEP30, TWO, None),
        ],
        fx=[(SEP30, RATE)],
    )
    prices = {r["fund_code"]: r["cad_price"] for r in rebuild.priced_funds(cfg, tables).collect()}
    assert prices == {"F1": 2, "F2": Decimal("2.6"), "F3": 0, "F4": 0, "F5": 2}


def test_monthly_path(cfg, raw):
    """Positions without a price and unreadable file dates drop out, and are listed apart."""
    tables = raw(
        price=[("F1", "XYZ", SEP30, TWO, "C")],
        monthly=[
            ("A1", "XYZ", "F1", "250930", TEN),
            ("A2", "XYZ", "F1", "250931", TEN),
            ("A3", "XYZ", "F9", "250930", TEN),
            ("A4", "XYZ", "F1", "250930", None),
        ],
    )
    rows = {r["account_id"]: r["source_market_value"] for r in rebuild.monthly_path(cfg, tables).collect()}
    assert rows == {"A1": 20, "A4": None}
    assert sorted(r["account_id"] for r in rebuild.unpriced_monthly(cfg, tables).collect()) == ["A2", "A3"]


def test_daily_path(cfg, raw):
    """One row per priced day of the interval, both ends included; other companies are not valued."""
    days = [D(2025, 8, 31), SEP30, D(2025, 10, 1), D(2025, 11, 30), D(2025, 12, 1)]
    tables = raw(
        price=[("F1", c, d, TWO, "C") for c in ("MAX", "XYZ") for d in days],
        daily=[
            ("A1", "MAX", "F1", TEN, SEP30, D(2025, 11, 30)),
            ("A2", "XYZ", "F1", TEN, SEP30, D(2025, 11, 30)),
            ("A3", "MAX", "F1", TEN, D(2025, 12, 1), D(9999, 12, 31)),
            ("A4", "MAX", "F1", TEN, D(2025, 10, 2), D(2025, 9, 1)),
        ],
    )
    rows = sorted((r["account_id"], r["extract_date"]) for r in rebuild.daily_path(cfg, tables).collect())
    assert rows == [("A1", SEP30), ("A1", D(2025, 10, 1)), ("A1", D(2025, 11, 30)), ("A3", D(2025, 12, 1))]
    window = cfg.with_(date_from=SEP30, date_to=D(2025, 10, 31))
    assert rebuild.daily_path(window, tables).count() == 2


def test_dealer_periods_that_share_a_day_both_match(cfg, raw):
    tables = raw(
        price=[("F1", "MAX", SEP30, TWO, "C")],
        monthly=[("A1", "MAX", "F1", "250930", TEN), ("A2", "MAX", "F1", "250930", TEN)],
        account=[
            ("A1", "MAX", "D1", D(2020, 1, 1), SEP30),
            ("A1", "MAX", "D2", SEP30, D(2099, 1, 1)),
            ("A2", "MAX", "D3", D(2026, 1, 1), D(2099, 1, 1)),
        ],
    )
    found = rebuild.with_dealer(cfg, tables, rebuild.source_positions(cfg, tables)).collect()
    assert sorted((r["account_id"], r["dealer_code"] or "") for r in found) == [("A1", "D1"), ("A1", "D2"), ("A2", "")]


def test_an_account_with_a_long_history(spark, cfg, raw):
    """One account with a period for each fortnight of thirty years, some of which overlap, and as many positions."""
    start = D(1996, 1, 1)
    periods = [("A1", "MAX", f"D{k}", start + timedelta(14 * k), start + timedelta(14 * k + 14 + k % 3)) for k in range(780)]
    days = [start + timedelta(11 * k) for k in range(990)]
    tables = raw(
        price=[("F1", "MAX", d, TWO, "C") for d in days],
        account=periods,
    )
    rows = spark.createDataFrame([("A1", "MAX", d) for d in days], "account_id string, management_company_code string, extract_date date")
    found = rebuild.with_dealer(cfg, tables, rows)
    got = sorted((r["extract_date"], r["dealer_code"]) for r in found.collect())
    expected = sorted((d, p[2]) for d in days for p in periods if p[3] <= d <= p[4])
    assert got == expected and len(got) > len(days)
    # A day meets the periods of its year, 26 or so, and not all 780.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan


def test_both_paths_stay_apart_rows(cfg, raw):
    tables = raw(
        price=[("F1", "MAX", SEP30, TWO, "C")],
        monthly=[("A1", "MAX", "F1", "250930", TEN)],
        daily=[("A1", "MAX", "F1", TEN, SEP30, SEP30)],
    )
    rows = rebuild.source_positions(cfg, tables).collect()
    assert sorted((r["source_path"], r["is_monthly"]) for r in rows) == [("DAILY", False), ("MONTHLY", True)]


def test_rates_of_the_sample_are_unique(spark):
    from conftest import DATA

    from plumbline.sources.star import star_tables

    rates = star_tables(spark, DATA)["usd_fx_rate"]
    assert rates.count() == rates.select("currency_exchange_date").distinct().count()


def test_five_reports_from_one_rebuild(spark, tmp_path):
    """The shared call gives what the five single reports give, and its reports don't read positions again."""
    from comparison import spark_bag
    from conftest import DATA

    from plumbline.plans.variance import source_variance, source_variances
    from plumbline.sources.star import star_config, star_tables

    cfg, tables = star_config(), star_tables(spark, DATA)
    shared = source_variances(cfg, tables, str(tmp_path / "sums"))
    assert list(shared) == ["B1", "B2", "B3", "B4", "B5"]
    for report_id, rows in shared.items():
        assert spark_bag(rows) == spark_bag(source_variance(cfg, tables, report_id)), report_id
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "shares_owned_amount" not in plan


def test_dealer_history_is_never_broadcast(cfg, raw):
    """Listed by year, a few small rows become many: their size as stored tells nothing."""
    history = [("A1", "XYZ", "D1", D(1990, 1, 1), D(2099, 12, 31)), ("A1", "XYZ", "D2", D(2025, 9, 30), D(2025, 9, 30))]
    tables = raw(price=[("F1", "XYZ", SEP30, TWO, "C")], monthly=[("A1", "XYZ", "F1", "250930", TEN)], account=history)
    rows = rebuild.with_dealer(cfg, tables, rebuild.monthly_path(cfg, tables))
    assert sorted(r["dealer_code"] for r in rows.collect()) == ["D1", "D2"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "strategy=merge" in top
