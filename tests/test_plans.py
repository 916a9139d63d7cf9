"""What the planner makes of the jobs on stored tables."""

import re
from datetime import date

import pytest
from conftest import DATA, REFERENCE_SCHEMA, TARGET_SCHEMA, frame, reference_row, target_row

from plumbline.plans.checks import CHECKS_BY_ID, RECORD_RULES, matched_records
from plumbline.plans.suite import count_totals, suite_results
from plumbline.plans.transactions import running_balance
from plumbline.plans.variance import reference_variance, source_variance
from plumbline.sources.star import star_config, star_tables
from plumbline.sources.tables import TableSet

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Target and reference as Parquet files."""
    root = str(tmp_path_factory.mktemp("stored"))
    frame(spark, [target_row()], TARGET_SCHEMA).write.parquet(f"{root}/wealth_assets.parquet")
    frame(spark, [reference_row()], REFERENCE_SCHEMA).write.parquet(f"{root}/asset_reference.parquet")
    return TableSet.from_parquet(spark, root)


def test_missing_keys_are_an_anti_join(cfg, stored):
    assert "LeftAnti" in plan_of(CHECKS_BY_ID["MV-20"].build(cfg, stored))


def test_scan_is_pruned_and_filtered(cfg, spark, stored):
    windowed = cfg.with_(date_from=date(2025, 9, 1), date_to=date(2026, 3, 31))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = plan_of(CHECKS_BY_ID["MV-18"].build(windowed, stored))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "death_guarantee" not in scan
    assert "EqualTo(source_system,S)" in scan
    assert "GreaterThanOrEqual(extract_date" in scan


def test_record_match_takes_one_shuffle_per_side(cfg, spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(matched_records(cfg, stored, list(RECORD_RULES)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "Aggregate" not in plan


def test_report_aligns_both_sides_with_one_shuffle_each(cfg, spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(reference_variance(cfg, stored, "A1", ordered=False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One for each side, one for accounts, one for the result; no Expand for distinct counts.
    assert plan.count("Exchange hashpartitioning") == 4
    assert "Expand" not in plan


@pytest.mark.parametrize("report_id, shuffles", [("A3", 4), ("A4", 3), ("A5", 4)])
def test_sums_finer_than_the_match_are_shuffled_once(cfg, spark, stored, report_id, shuffles):
    """One shuffle for each side, one by fund, or one each for the account level and the result."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(reference_variance(cfg, stored, report_id, ordered=False))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(") == shuffles


def test_bucketed_tables_match_without_a_shuffle(cfg, spark, tmp_path):
    keys = {
        "wealth_assets": ["policy_number", "manufacturing_company_code", "extract_date"],
        "asset_reference": ["contract_policy_number", "fund_management_company_code", "extract_date"],
    }
    rows = {
        "wealth_assets": frame(spark, [target_row()], TARGET_SCHEMA),
        "asset_reference": frame(spark, [reference_row()], REFERENCE_SCHEMA),
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in rows.items():
            df.write.bucketBy(4, *keys[name]).sortBy(*keys[name]).option("path", str(tmp_path / name)).saveAsTable(name)
        tables = TableSet.from_catalog(spark)
        matched = matched_records(cfg, tables, list(RECORD_RULES))
        assert "Exchange" not in plan_of(matched)
        assert matched.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in rows:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_totals_of_all_grains_take_one_shuffle_a_side(cfg, stored):
    assert plan_of(count_totals(cfg, stored)).count("Exchange hashpartitioning(") == 2


@pytest.fixture(scope="module")
def star_root(spark, tmp_path_factory):
    """A star schema of two line items."""
    root = str(tmp_path_factory.mktemp("star"))
    day = date(1996, 3, 5)
    made = {
        "lineitem": (
            [(n, 1, 1, 1, 5.0, 10.0, "R", "O", day) for n in (1, 2)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
            " l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate date",
        ),
        "orders": ([(1, 1, day), (2, 1, day)], "o_orderkey long, o_custkey long, o_orderdate date"),
        "part": ([(1, 2.0)], "p_partkey long, p_retailprice double"),
        "customer": ([(1, 1)], "c_custkey long, c_nationkey int"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return root


# The suite has passes that drop rows without a date, and passes that don't.
@pytest.mark.parametrize("job, shuffles", [("suite", 2), ("record", 1), ("balance", 1)])
def test_tables_share_the_shuffles_of_line_items(spark, star_root, job, shuffles):
    """Tables of the same line items in one query share the shuffles below them, whatever columns and rows they take."""
    jobs = {
        "suite": suite_results,
        "record": CHECKS_BY_ID["MV-05"].build,
        "balance": lambda cfg, tables: running_balance(tables["trx"]),
    }
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        plan = plan_of(jobs[job](star_config(), star_tables(spark, star_root)))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(re.findall(r"(?m)^[^A-Za-z]*Exchange hashpartitioning\(l_orderkey", plan)) == shuffles


def test_windows_reach_the_files_of_line_items(spark, star_root):
    """The date window is applied to the ship date before the line items meet their orders."""
    cfg = star_config(date_from=date(2020, 9, 1), date_to=date(2021, 3, 31))
    lines = plan_of(reference_variance(cfg, star_tables(spark, star_root), "A1"))
    filters = [line for line in lines.splitlines() if "Filter" in line and "isnotnull(l_orderkey" in line]
    assert filters and all("add_months" in line for line in filters)


@pytest.mark.parametrize("report_id, grain", [("B1", "policy"), ("B1", "fund"), ("B2", "policy"), ("B5", "policy")])
def test_source_reports_make_prices_once_and_shuffle_both_sides_once(spark, star_root, report_id, grain):
    """Both paths meet the prices in one join, and account and month serve sums, match and account level."""
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        plan = plan_of(source_variance(star_config(grain=grain), star_tables(spark, star_root), report_id, ordered=False))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    exchanges = re.findall(r"(?m)^[^A-Za-z]*Exchange hashpartitioning\((\w+)#\d+L?, (\w+)", plan)
    assert exchanges.count(("account", "report_month")) == 1
    assert not [e for e in exchanges if e[0] in ("account", "policy_number") and e[1] != "report_month"]
    # Once for the interval join, and once for the distinct rows behind it and behind the span of days.
    assert len([e for e in exchanges if e[0] == "fund_code"]) == 2
    assert exchanges.count(("l_partkey", "l_linestatus")) == 1
