"""The checks on hand-made rows: one violation each, and the cases that decide results."""

from datetime import date
from decimal import Decimal

import pytest
from conftest import dec, reference_row, target_row

from plumbline.config import GUARANTEE_FLAGS
from plumbline.plans.checks import (
    CHECKS,
    CHECKS_BY_ID,
    null_plan_totals,
    record_violations,
    reference_only_keys,
    target_only_keys,
    total_violations,
)

DAY = date(2025, 9, 30)
LATER = date(2025, 10, 31)


def hits(check_id, cfg, tables):
    return CHECKS_BY_ID[check_id].build(cfg, tables).collect()


def test_clean_target_passes_everything(cfg, tables):
    both = tables(
        [target_row(), target_row("P2", LATER)], [reference_row(), reference_row("P2", LATER)]
    )
    for spec in CHECKS:
        expected = 1 if spec.pass_when == "has_rows" else 0
        assert spec.build(cfg, both).count() == expected, spec.test_id


def test_empty_inputs(cfg, tables):
    for spec in CHECKS:
        assert spec.build(cfg, tables([], [])).count() == 0, spec.test_id


ONE_FAULT = {
    "MV-05": dict(value="20.02"),
    "MV-06": dict(price="2.02"),
    "MV-07": dict(units="10.02"),
    "MV-11": dict(plan_identifier_sk=None),
    "MV-12": dict(monthly_extract_indicator=False),
    "MV-13": dict(weekly_extract_indicator=True),
    "MV-15": dict(plan_identifier_sk=7),
    "MV-16": dict(fund_sk=0),
    "MV-17": dict(extract_date_sk=None),
    "MV-18": dict(value=-20),
    "MV-19": dict(units=0),
}


@pytest.mark.parametrize("check_id", sorted(ONE_FAULT))
def test_one_fault(check_id, cfg, tables):
    both = tables(
        [target_row(**ONE_FAULT[check_id]), target_row("P2")], [reference_row(), reference_row("P2")]
    )
    (row,) = hits(check_id, cfg, both)
    assert row["policy_number"] == "P1"


@pytest.mark.parametrize("flag", GUARANTEE_FLAGS)
def test_each_guarantee_flag(flag, cfg, tables):
    assert len(hits("MV-14", cfg, tables([target_row(**{flag: True})], []))) == 1


def test_null_guarantee_flag_is_no_violation(cfg, tables):
    assert not hits("MV-14", cfg, tables([target_row(**{GUARANTEE_FLAGS[0]: None})], []))


def test_tolerance_is_strict(cfg, tables):
    assert not hits("MV-05", cfg, tables([target_row(value="20.01")], [reference_row()]))


def test_product_is_rounded_in_record_check_only(cfg, tables):
    both = tables([target_row(value="0.03")], [reference_row(units="0.1250", price="0.2010", value="0.03")])
    assert not hits("MV-05", cfg, both)
    low = cfg.with_(value_tolerance=Decimal("0.004"))
    assert len(hits("MV-04", low, both)) == 1


def test_other_source_system_is_ignored(cfg, tables):
    both = tables([target_row(), target_row(value=-1, source_system="other")], [reference_row()])
    assert not hits("MV-18", cfg, both)
    assert not hits("MV-05", cfg, both)


def test_window_is_closed(cfg, tables):
    both = tables([target_row(value=-1), target_row("P2", LATER, value=-1)], [])
    assert len(hits("MV-18", cfg.with_(date_from=DAY, date_to=LATER), both)) == 2
    assert len(hits("MV-18", cfg.with_(date_from=DAY, date_to=DAY), both)) == 1
    with pytest.raises(ValueError):
        cfg.with_(date_from=DAY)


def test_two_funds_of_one_account_cross_match(cfg, tables):
    """On the policy grain two correct funds give two false rows; on the fund grain none."""
    both = tables(
        [target_row(), target_row(fund="F2", price=3, value=30)],
        [reference_row(), reference_row(fund="F2", price=3, value=30)],
    )
    assert len(hits("MV-05", cfg, both)) == 2
    assert not hits("MV-05", cfg.with_(grain="fund"), both)


def test_copies_come_back_as_pairs(cfg, tables):
    both = tables([target_row(value=99)] * 3, [reference_row()] * 2)
    rows = hits("MV-05", cfg, both)
    assert len(rows) == 6
    assert {r["variance"] for r in rows} == {Decimal("79.00")}


def test_null_flags(cfg, tables):
    """A null flag is no difference, except in the null-safe form."""
    both = tables(
        [target_row(monthly_extract_indicator=None), target_row("P2")],
        [reference_row(), reference_row("P2", monthly_extract_indicator=None)],
    )
    assert not hits("MV-12", cfg, both)
    assert record_violations(cfg, both, "MV-12-null-safe").count() == 2


def test_null_plan_on_either_side(cfg, tables):
    both = tables(
        [target_row(plan_identifier_sk=None), target_row("P2")],
        [reference_row(), reference_row("P2", plan_identifier_sk=None)],
    )
    (row,) = hits("MV-15", cfg, both)
    assert row["policy_number"] == "P1"


def test_days_on_one_side_only_pass_unseen(cfg, tables):
    both = tables([target_row(), target_row(day=LATER)], [reference_row(), reference_row(day=date(2025, 11, 28))])
    for check_id in ("MV-03", "MV-08", "MV-09", "MV-10"):
        assert not hits(check_id, cfg, both)
    assert [r["extract_date"] for r in target_only_keys(cfg, both).collect()] == [LATER]
    assert [r["extract_date"] for r in reference_only_keys(cfg, both).collect()] == [date(2025, 11, 28)]


def test_row_count_gap(cfg, tables):
    (row,) = hits("MV-03", cfg, tables([target_row()], [reference_row(), reference_row("P2")]))
    assert (row["tgt_rows"], row["ref_rows"], row["row_diff"], row["pct_diff"]) == (1, 2, 1, 50.0)


def test_negative_reference_total(cfg, tables):
    """The ratio of the plain form is negative then; the safe form sees the gap."""
    both = tables([target_row(value=-10)], [reference_row(units=-10)])
    assert not hits("MV-08", cfg, both)
    (row,) = total_violations(cfg, both, "MV-08", safe=True).collect()
    assert row["pct_variance"] == 50.0


def test_zero_reference_total_is_not_flagged(cfg, tables):
    assert not hits("MV-08", cfg, tables([target_row()], [reference_row(units=0)]))


def test_null_dealer_matches_nothing(cfg, tables):
    both = tables([target_row(dealer_code=None, value=99)], [reference_row(dealer_code=None)])
    assert not hits("MV-10", cfg, both)
    assert len(hits("MV-08", cfg, both)) == 1


def test_high_value_row_is_missed(cfg, tables):
    big = cfg.with_(high_value=Decimal(19))
    both = tables(
        [target_row("P2"), target_row(source_system="other")],
        [reference_row(), reference_row("P2"), reference_row("P3", units=1)],
    )
    (row,) = hits("MV-20", big, both)
    assert row["contract_policy_number"] == "P1"


def test_largest_stored_value_gaps(cfg, tables):
    rows = [reference_row(f"P{i}", value=20 + i) for i in range(1, 31)]
    spec = CHECKS_BY_ID["MV-04"]
    assert spec.build(cfg, tables([], rows)).count() == 30
    top = spec.sample(cfg, tables([], rows)).collect()
    assert len(top) == 25
    assert top[0]["variance"] == 30


def test_null_plan_totals(cfg, tables):
    both = tables([target_row(plan_identifier_sk=None), target_row("P2", plan_identifier_sk=None, price=4)], [])
    (row,) = null_plan_totals(cfg, both).collect()
    assert (row["record_count"], row["total_mv"], row["total_units"], row["avg_unit_price"]) == (
        2, dec(40), dec(20), 3.0,
    )
