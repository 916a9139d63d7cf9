"""The runner: pass rules, isolation, fused passes, result frames."""

import random
import time

import pytest
from conftest import DATA, REFERENCE_SCHEMA, TARGET_SCHEMA, dec, reference_row, target_row
from pyspark.sql import functions as F

from plumbline.plans.checks import CHECKS, CHECKS_BY_ID, RECORD_RULES, CheckSpec
from plumbline.plans.suite import (
    grid,
    problems,
    record_samples,
    results_frame,
    run_check,
    run_suite,
    samples_frame,
    count_records,
    hot_match_keys,
    suite_counts,
    suite_results,
    suite_samples,
    summary,
)
from plumbline.sources.star import star_config, star_tables
from plumbline.sources.tables import TableSet, sql_source


DECIMALS = ("number_of_units", "unit_value", "market_value", "canadian_unit_price")


def sql_check(text, pass_when="zero_rows", threshold=0.0, test_id="X"):
    return CheckSpec(test_id, "n", "c", "d", "v", pass_when=pass_when, threshold=threshold, sql=text)


@pytest.mark.parametrize(
    ("text", "rule", "threshold", "status"),
    [
        ("SELECT 1 WHERE false", "zero_rows", 0, "PASS"),
        ("SELECT 1", "zero_rows", 0, "FAIL"),
        ("SELECT 1", "has_rows", 0, "PASS"),
        ("SELECT 1 WHERE false", "has_rows", 0, "FAIL"),
        ("SELECT 0.5", "within_pct", 0.5, "PASS"),
        ("SELECT 0.6", "within_pct", 0.5, "FAIL"),
        ("SELECT CAST(NULL AS DOUBLE)", "within_pct", 0.5, "FAIL"),
        ("SELECT 0.5 WHERE false", "within_pct", 0.5, "ERROR"),
        ("SELECT nothing FROM nowhere", "zero_rows", 0, "ERROR"),
        ("SELECT 1", "unheard_of", 0, "ERROR"),
        ("SELECT a, count(*) FROM VALUES (1) t(a)", "zero_rows", 0, "ERROR"),
    ],
)
def test_pass_rules(spark, cfg, text, rule, threshold, status):
    result = run_check(spark, sql_check(text, rule, threshold), cfg, TableSet.from_frames({}))
    assert result.status == status
    assert result.sql_query == text
    assert (result.error is not None) == (result.error_traceback is not None) == (status == "ERROR")
    assert (result.sample is not None) == (rule == "zero_rows" and status == "FAIL")
    assert result.elapsed_ms >= 0


def test_bound_values_are_not_pasted(spark):
    assert sql_source(spark, "SELECT :a AS a", a="x' OR 1=1").first()["a"] == "x' OR 1=1"


def test_fused_equals_one_by_one(spark):
    cfg, tables = star_config(), star_tables(spark, DATA)
    fused = {r.test_id: (r.status, r.row_count) for r in run_suite(spark, cfg, tables)}
    alone = {r.test_id: (r.status, r.row_count) for r in run_suite(spark, cfg, tables, fused=False)}
    lazy = {r["test_id"]: (r["status"], r["row_count"]) for r in suite_results(cfg, tables).collect()}
    assert fused == alone == lazy
    assert list(fused) == [s.test_id for s in CHECKS]


def test_fused_counts_on_the_fund_grain(spark):
    cfg, tables = star_config(grain="fund"), star_tables(spark, DATA)
    counts = {r["test_id"]: r["row_count"] for r in suite_counts(cfg, tables).collect()}
    for check_id in ("MV-05", "MV-12", "MV-20"):
        assert counts[check_id] == CHECKS_BY_ID[check_id].build(cfg, tables).count()


def test_row_counts_are_whole(spark, cfg):
    """Rules that need one row or value only still report how many rows there are."""
    many = "SELECT id / 10000 AS v FROM range(1000)"
    for rule, threshold in (("has_rows", 0), ("within_pct", 1.0), ("zero_rows", 0)):
        result = run_check(spark, sql_check(many, rule, threshold), cfg, TableSet.from_frames({}))
        assert result.row_count == 1000


def test_query_text_can_be_run_again(spark, cfg, tables):
    from decimal import Decimal  # noqa: F401

    from plumbline.config import SuiteConfig  # noqa: F401

    both = tables([target_row(value=-1)], [reference_row()])
    by_id = {r.test_id: r for r in run_suite(spark, cfg, both)}
    text = by_id["MV-18"].sql_query
    assert "market_value" in text.partition("# where")[2]
    rows = eval(text, {"CHECKS_BY_ID": CHECKS_BY_ID, "SuiteConfig": SuiteConfig, "Decimal": Decimal, "tables": both})
    assert rows.count() == 1


def test_samples_are_bounded_and_the_first(spark, cfg, tables):
    rows = [target_row(f"P{i:02d}", value=-1, fund_sk=0) for i in range(30)]
    both = tables(rows, [reference_row(f"P{i:02d}") for i in range(30)])
    got = suite_samples(cfg.with_(sample_rows=4), both).collect()
    assert sorted({r["test_id"] for r in got}) == ["MV-03", "MV-05", "MV-08", "MV-09", "MV-10", "MV-16", "MV-18"][1:]
    for check_id in ("MV-05", "MV-16", "MV-18"):
        own = sorted(r["sample"] for r in got if r["test_id"] == check_id)
        assert [f"P{i:02d}" in s for i, s in enumerate(own)] == [True] * 4
    plan = suite_samples(cfg, both)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def plain_samples(cfg, tables, check_id):
    """All pairs of a record check as text, the first ones of them."""
    rows = CHECKS_BY_ID[check_id].build(cfg, tables)
    text = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("s"))
    return sorted(r["s"] for r in text.collect())[: cfg.sample_rows]


@pytest.mark.parametrize(("seed", "grain"), [(1, "policy"), (2, "fund")])
def test_samples_of_record_checks_are_the_first_pairs(cfg, tables, seed, grain):
    rng = random.Random(seed)
    values = [None, 0, 1, "1.005", "1.01", "1.011", 2, 10, -3]

    def row(make, **names):
        own = {name: rng.choice(options) for name, options in names.items()}
        own |= {k: None if v is None else dec(v) for k, v in own.items() if k in DECIMALS}
        return make(rng.choice(["P1", "P2", "P3", "P10", "Q", None]), fund=rng.choice(["F1", "F2"]), **own)

    flags = dict(monthly_extract_indicator=[True, False, None], weekly_extract_indicator=[True, False])
    keys = dict(plan_identifier_sk=[1, 2, 10, None], number_of_units=values)
    target = [row(target_row, unit_value=values, market_value=values, **keys, **flags) for _ in range(rng.randrange(5, 60))]
    reference = [row(reference_row, canadian_unit_price=values, **keys, **flags) for _ in range(rng.randrange(5, 60))]
    both = tables(target, reference)
    for n in (4, 500):
        few = cfg.with_(sample_rows=n, grain=grain)
        got = {}
        for r in record_samples(few, both).collect():
            got.setdefault(r["test_id"], []).append(r["sample"])
        for check_id in RECORD_RULES:
            assert sorted(got.get(check_id, [])) == plain_samples(few, both, check_id), check_id


def test_samples_of_a_key_with_very_many_pairs(spark, cfg):
    """One key with 100,000 different rows on both sides: ten thousand million pairs, of which four are made."""
    n = 100_000
    price = (F.col("id") % 1000).cast("decimal(12,4)")
    target = spark.createDataFrame([tuple(target_row().values())], TARGET_SCHEMA)
    names = {"unit_value": price, "number_of_units": F.col("id").cast("decimal(12,4)"), "market_value": F.col("id").cast("decimal(18,2)")}
    target = target.crossJoin(spark.range(0, n, 1, 4)).withColumns(names).drop("id")
    reference = spark.createDataFrame([tuple(reference_row().values())], REFERENCE_SCHEMA)
    names = {"canadian_unit_price": price, "number_of_units": F.col("id").cast("decimal(12,4)")}
    reference = reference.crossJoin(spark.range(0, n, 1, 4)).withColumns(names).drop("id")
    both = TableSet.from_frames({"wealth_assets": target, "asset_reference": reference})
    start = time.monotonic()
    got = record_samples(cfg.with_(sample_rows=4), both).collect()
    assert time.monotonic() - start < 120
    found = sorted(r["sample"].partition('"tgt_units":')[2] for r in got if r["test_id"] == "MV-07")
    assert found == [f'0.0000,"ref_units":{k}.0000,"diff":{k}.0000}}' for k in (1, 10, 100, 1000)]
    assert {r["test_id"] for r in got} == {"MV-05", "MV-06", "MV-07"}


def test_hot_counts_keep_their_size(cfg, tables):
    both = tables([target_row(value=21)] * 3, [reference_row()] * 5)
    hot = hot_match_keys(cfg.with_(hot_match_pairs=15), both)
    assert len(hot) == 1 and hot_match_keys(cfg.with_(hot_match_pairs=16), both) == []
    counts = {r["test_id"]: r["row_count"] for r in count_records(cfg, both, hot).collect()}
    assert counts["MV-05"] == 15


@pytest.mark.parametrize("hot_pairs", [1, 20])
def test_hot_keys_are_counted_alike(spark, cfg, tables, hot_pairs):
    """A key with a third of all rows, in copies and with distinct values on both sides."""
    target = [target_row(value=20 + i % 3, plan_identifier_sk=i % 2 or None) for i in range(8)]
    target += [target_row("P2", price="2.5"), target_row("P3", monthly_extract_indicator=None)] * 2
    reference = [reference_row(units=10 + i % 2, weekly_extract_indicator=i % 2 == 0) for i in range(6)]
    reference += [reference_row("P2"), reference_row("P3"), reference_row(None)]
    both = tables(target, reference)
    plain = {r["test_id"]: r["row_count"] for r in suite_counts(cfg, both).collect()}
    hot = hot_match_keys(cfg.with_(hot_match_pairs=hot_pairs), both)
    assert hot
    split = {r["test_id"]: r["row_count"] for r in suite_counts(cfg, both, hot).collect()}
    assert split == plain
    for check_id in ("MV-05", "MV-06", "MV-07", "MV-12", "MV-13", "MV-15"):
        assert plain[check_id] == CHECKS_BY_ID[check_id].build(cfg, both).count(), check_id


def test_a_broken_table_spoils_only_its_checks(spark, cfg, tables):
    """Without one target column the checks on it end as ERROR, and the others still run."""
    both = tables([target_row(value=-1)], [reference_row()])
    broken = TableSet.from_frames(
        {"wealth_assets": both["wealth_assets"].drop("fund_sk"), "asset_reference": both["asset_reference"]}
    )
    by_id = {r.test_id: r for r in run_suite(spark, cfg, broken)}
    assert [i for i, r in by_id.items() if r.status == "ERROR"] == ["MV-16"]
    assert by_id["MV-18"].status == "FAIL"
    assert "fund_sk" in by_id["MV-16"].error
    assert "fund_sk" in by_id["MV-18"].note and by_id["MV-02"].note is None


def test_missing_table(spark, cfg, tables):
    only = TableSet.from_frames({"wealth_assets": tables([target_row()], [])["wealth_assets"]})
    status = {r.test_id: r.status for r in run_suite(spark, cfg, only)}
    assert status["MV-01"] == status["MV-18"] == "PASS"
    assert status["MV-02"] == status["MV-05"] == "ERROR"


def test_result_frames(spark, cfg, tables):
    rows = [target_row(f"P{i}", value=-1) for i in range(30)]
    results = run_suite(spark, cfg, tables(rows, [reference_row(f"P{i}") for i in range(30)]),
                        [CHECKS_BY_ID["MV-01"], CHECKS_BY_ID["MV-18"], sql_check("SELECT x FROM y")])
    frame = results_frame(spark, results)
    samples = samples_frame(spark, results)
    assert samples.count() == cfg.sample_rows
    assert samples.select("test_id").distinct().first()[0] == "MV-18"
    row = summary(frame, 1.26).first()
    assert (row["total"], row["passed"], row["failed"], row["errored"]) == (3, 1, 1, 1)
    assert (row["pass_rate"], row["elapsed_seconds"]) == (33.3, 1.3)
    assert row["verdict"] == "1 TEST(S) FAILED, 1 TEST(S) ERRORED"
    assert [r["rows_or_value"] for r in grid(frame).collect()] == ["1", "30", "0"]
    assert problems(frame, samples).count() == cfg.sample_rows + 1


def test_results_can_be_stored(spark, cfg, tables, tmp_path):
    results = run_suite(spark, cfg, tables([target_row()], [reference_row()]))
    results_frame(spark, results).write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    assert summary(stored).first()["verdict"] == "ALL TESTS PASSED"
    assert summary(stored.limit(0)).first()["pass_rate"] == 0.0
    assert samples_frame(spark, results).count() == 0
