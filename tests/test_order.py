"""Layouts that sort: the rows come in the order that the layout states."""

import pytest
from conftest import DATA

import __spark_entry__ as entry

KEYS = ("policy_number", "manufacturing_company_code")


def down(value):
    """For numbers and dates; nulls come last, as they do in a descending order."""
    return (value is None, None if value is None else -(value.toordinal() if hasattr(value, "toordinal") else value))


def up(value):
    return (value is not None, value)


def names(*columns):
    return lambda r: tuple(up(r[c]) for c in columns)


ORDERS = {
    "mv03": lambda r: (down(r["pct_diff"]), r["extract_date"]),
    "mv04": lambda r: (down(r["variance"]), r["contract_policy_number"], r["fund_code"]),
    "mv05": lambda r: (down(r["variance"]), *(r[k] for k in KEYS), r["extract_date"]),
    "mv08": lambda r: (down(r["pct_variance"]), r["extract_date"]),
    "mv09": lambda r: (down(r["pct_variance"]), r["extract_date"], r["manufacturing_company_code"]),
    "mv10": lambda r: (down(r["pct_variance"]), r["extract_date"], r["dealer_code"]),
    "mv11": lambda r: (down(r["extract_date"]), *(r[k] for k in KEYS)),
    "mv16": lambda r: (down(r["extract_date"]), *(r[k] for k in KEYS)),
    "mv17": lambda r: (down(r["extract_date"]), *(r[k] for k in KEYS)),
    "mv18": lambda r: (r["market_value"], *(r[k] for k in KEYS), r["extract_date"]),
    "mv20": lambda r: (down(r["expected_mv"]), r["contract_policy_number"], r["fund_management_company_code"]),
    "a1": names("report_month"),
    "a2": names("report_month", "management_company"),
    "a3": lambda r: (up(r["report_month"]), down(r["source_mv"])),
    "a4": lambda r: (up(r["report_month"]), down(None if r["variance_amt"] is None else abs(r["variance_amt"]))),
    "a5": names("report_month", "extract_type"),
    "b1": names("report_month"),
    "b3": lambda r: (up(r["report_month"]), down(None if r["mv_variance_amt"] is None else abs(r["mv_variance_amt"]))),
    "b4": lambda r: (up(r["report_month"]), down(r["source_mv"])),
    "b5": lambda r: (up(r["report_month"]), down({"M": 1, "D": 0}[r["source_path"][0]])),
    "month_end_report": lambda r: (
        r["window_side"] != "PRE" and r["trade_date"], r["trade_date"], r["company"], r["fund_code"], r["account_id"]
    ),
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_order(name, spark):
    rows = entry.queries()[name](spark, DATA).collect()
    keys = [ORDERS[name](r) for r in rows]
    if name == "month_end_report":
        keys = [(r["month_end"], r["window_side"] != "PRE", *k[1:]) for r, k in zip(rows, keys, strict=True)]
    assert rows and keys == sorted(keys)
