"""Queries of the reconciliation jobs over the star-schema tables, and their expected results in SQL."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import date
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from oracle.queries import ORACLE_SQL  # noqa: E402
from plumbline.plans import checks, history, rebuild, suite, transactions, verdict  # noqa: E402
from plumbline.plans.variance import reference_variance, source_variance  # noqa: E402
from plumbline.sources import delimited  # noqa: E402
from plumbline.sources.star import star_config, star_tables  # noqa: E402

try:  # these go together: without them all else works as before
    import corpus_pipeline  # noqa: E402
    from plumbline.llm import queries as llm_queries  # noqa: E402
except ImportError:
    corpus_pipeline = llm_queries = None

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"
WINDOW = dict(date_from=date(2020, 9, 1), date_to=date(2021, 3, 31))
FUND_GRAIN = dict(grain="fund")

TRX_ID = ["account_id", "fund_code", "company", "trade_date", "order_id", "line_number", "leg"]
# What balances and unmatched legs shuffle; the other columns of a transaction are neither used nor returned.
BALANCE_COLUMNS = [*TRX_ID, "gross", "units", "unit_factor"]
LEG_COLUMNS = [*TRX_ID, "investor_id", "gross", "units", "price", "unit_factor"]


def _job(build, **changes) -> Query:
    """A query from a function of (config, tables)."""
    return lambda spark, root: build(star_config(**changes), star_tables(spark, root))


def _check(check_id: str, **changes) -> Query:
    spec = checks.CHECKS_BY_ID[check_id]
    return _job(spec.sample or spec.build, **changes)


def _a(report_id: str, fan_out: bool = True, **changes) -> Query:
    return _job(lambda cfg, tables: reference_variance(cfg, tables, report_id, fan_out), **changes)


def _b(report_id: str, **changes) -> Query:
    return _job(lambda cfg, tables: source_variance(cfg, tables, report_id), **changes)


def _source(build) -> Query:
    def run(cfg, tables):
        rows = build(cfg, tables)
        return rows.withColumns(
            {
                "cad_price": F.col("cad_price").cast("decimal(21,8)"),
                "source_market_value": F.col("source_market_value").cast("decimal(34,12)"),
            }
        ).drop("is_monthly")

    return _job(run)


def _trx(build, *columns: str) -> Query:
    return _job(lambda cfg, tables: build(cfg, tables).select(*TRX_ID, *columns))


def _balances(cfg, tables, *more: str) -> DataFrame:
    return transactions.running_balance(tables["trx"].select(*BALANCE_COLUMNS, *more))


def _booked(cfg, tables) -> DataFrame:
    """Balances with a booking error of one cent on every 500th number."""
    wrong = (F.col("order_id") + F.col("line_number")) % 500 == 3
    close = F.col("close_balance") + F.when(wrong, F.lit(Decimal("0.01"))).otherwise(F.lit(Decimal("0.00")))
    return _balances(cfg, tables).withColumn("close_balance", close.cast("decimal(28,4)"))


def _total_safe(check_id: str) -> Query:
    return _job(lambda cfg, tables: checks.total_violations(cfg, tables, check_id, safe=True))


def _null_safe(check_id: str) -> Query:
    return _job(lambda cfg, tables: checks.record_violations(cfg, tables, f"{check_id}-null-safe"))


def _runner_results(spark: SparkSession, root: str) -> DataFrame:
    """The runner on checks of the caller's own, in SQL and as a DataFrame: every rule, passing, failing and broken."""
    cfg, tables = star_config(), star_tables(spark, root)
    lines = spark.read.parquet(f"{root}/lineitem.parquet")
    lines.createOrReplaceTempView("runner_lineitem")

    def spec(test_id, rule, sql=None, threshold=0.0, build=None):
        return checks.CheckSpec(
            test_id, f"name {test_id}", "Own", f"about {test_id}", "runner", build, rule, threshold, sql
        )

    specs = [
        spec("X-01", "has_rows", "SELECT l_orderkey FROM runner_lineitem WHERE l_quantity > 30"),
        spec("X-02", "has_rows", "SELECT l_orderkey FROM runner_lineitem WHERE l_quantity < 0"),
        spec("X-03", "zero_rows", "SELECT l_orderkey FROM runner_lineitem WHERE l_discount > 1"),
        spec("X-04", "zero_rows", "SELECT l_orderkey FROM runner_lineitem WHERE l_quantity = 7"),
        spec("X-05", "within_pct", "SELECT max(l_discount) AS d FROM runner_lineitem GROUP BY l_linestatus ORDER BY d", 0.5),
        spec("X-06", "within_pct", "SELECT max(l_quantity) AS q FROM runner_lineitem GROUP BY l_returnflag ORDER BY q", 0.5),
        spec("X-07", "zero_rows", "SELECT nothing FROM runner_lineitem"),
        spec("X-08", "zero_rows", build=lambda cfg, tables: tables["wealth_assets"].where("market_value < 0")),
    ]
    results = suite.results_frame(spark, suite.run_suite(spark, cfg, tables, specs))
    return results.select(
        "test_id", "test_name", "category", "description", "validates", "pass_when", "status",
        F.col("row_count").cast("bigint").alias("row_count"), "metric_value",
        F.col("error").isNotNull().alias("has_error"), F.col("error_traceback").isNotNull().alias("has_traceback"),
        F.when(F.col("test_id") != "X-08", F.col("sql_query")).alias("sql_query"),
    )


def _omnibus(trx: DataFrame) -> DataFrame:
    """A third of all transactions booked for nobody, at amount 0 on one day: one group of transfer legs."""
    third = F.col("order_id") % 3 == 0
    return trx.withColumns(
        {
            "investor_id": F.when(~third, F.col("investor_id")),
            "gross": F.when(third, F.lit(Decimal("0.00"))).otherwise(F.col("gross")).cast("decimal(18,2)"),
            "trade_date": F.when(third, F.lit(date(2021, 1, 4))).otherwise(F.col("trade_date")),
        }
    )


def _busy_account(trx: DataFrame) -> DataFrame:
    """A third of all transactions on one account and fund."""
    third = F.col("order_id") % 3 == 0
    return trx.withColumns({c: F.when(third, F.lit(7)).otherwise(F.col(c)).cast("int") for c in ("account_id", "fund_code")})


def _runner_problems(spark: SparkSession, root: str) -> DataFrame:
    """The failure report: a failed check with its samples, a limit on no row at all, and one on a null."""
    cfg, tables = star_config(sample_rows=5), star_tables(spark, root)
    spark.read.parquet(f"{root}/lineitem.parquet").createOrReplaceTempView("runner_lineitem")

    def spec(test_id, rule, sql, threshold=0.0):
        return checks.CheckSpec(test_id, f"name {test_id}", "Own", f"about {test_id}", "runner", None, rule, threshold, sql)

    specs = [
        spec("Y-01", "zero_rows", "SELECT l_linenumber FROM runner_lineitem WHERE l_linenumber = 1"),
        spec("Y-02", "within_pct", "SELECT l_discount FROM runner_lineitem WHERE l_quantity < 0", 0.5),
        spec("Y-03", "within_pct", "SELECT max(l_discount) AS d FROM runner_lineitem WHERE l_quantity < 0", 0.5),
        spec("Y-04", "zero_rows", "SELECT l_linenumber FROM runner_lineitem WHERE l_linenumber < 0"),
        spec("Y-05", "zero_rows", "SELECT l_linenumber FROM runner_lineitem WHERE l_linenumber = 2"),
    ]
    results = suite.run_suite(spark, cfg, tables, specs)
    report = suite.problems(suite.results_frame(spark, results), suite.samples_frame(spark, results))
    return report.select(
        "test_id", "test_name", "status", F.col("row_count").cast("bigint").alias("row_count"),
        F.col("error").isNotNull().alias("has_error"), "sql_query", "sample",
    )


EXTRACT_COLUMNS = {
    1: ("account_id", "int"), 2: ("trade_date", "date"), 3: ("units", "decimal(18,4)"), 4: ("trx_code", "string"),
}


def _extract(trx: DataFrame) -> DataFrame:
    """Transactions as lines of a tab-separated extract; some have a bad date or amount, a missing or an extra cell."""
    kind = F.col("order_id") % 40
    cells = [
        F.col("account_id").cast("string"),
        F.when(kind == 1, "2020-13-01").otherwise(F.col("trade_date").cast("string")),
        F.when(kind == 2, "NULL").when(kind == 3, "n/a").otherwise(F.col("units").cast("string")),
        F.when(kind == 4, F.concat("trx_code", F.lit("\tx"))).when(kind != 5, F.col("trx_code")),
    ]
    return trx.select(F.concat_ws("\t", *cells).alias("value"))


def _checked(tables) -> DataFrame:
    return delimited.check_lines(_extract(tables["trx"]), EXTRACT_COLUMNS, 4)


def _run_changes(cfg, tables) -> DataFrame:
    """Two runs: in the second one a check is gone, one passes and one has another count."""
    first = suite.suite_results(cfg, tables).withColumn("run_id", F.lit("1"))
    fixed, moved = F.col("test_id") == "MV-05", F.col("test_id") == "MV-06"
    second = first.where("test_id <> 'MV-20'").withColumns(
        {
            "run_id": F.lit("2"),
            "status": F.when(fixed, "PASS").otherwise(F.col("status")),
            "row_count": F.when(fixed, 0).when(moved, F.col("row_count") + 1).otherwise(F.col("row_count")).cast("decimal(38,0)"),
        }
    )
    return history.run_changes(first.unionByName(second), "2")


def _samples(cfg, tables) -> DataFrame:
    return suite.suite_samples(cfg, tables)


def _grid(cfg, tables) -> DataFrame:
    return suite.grid(suite.suite_results(cfg, tables).withColumn("metric_value", F.lit(None).cast("double")))


def _month_end(cfg, tables) -> DataFrame:
    return transactions.month_end_window(tables["trx"])


def entry(spark: SparkSession) -> DataFrame:
    """Monthly variance of the rebuilt source against the target."""
    return queries()["b1"](spark, SMOKE_DIR)


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {f"mv{i:02d}": _check(f"MV-{i:02d}") for i in range(1, 21)}
    named |= {
        "mv11_grouped": _job(checks.null_plan_totals),
        "mv05_fund_grain": _check("MV-05", **FUND_GRAIN),
        "mv05_window": _check("MV-05", **WINDOW),
        "mv08_safe": _job(lambda cfg, tables: checks.total_violations(cfg, tables, "MV-08", safe=True)),
        "mv12_null_safe": _job(lambda cfg, tables: checks.record_violations(cfg, tables, "MV-12-null-safe")),
        "mv04_top5": _check("MV-04", top_rows=5),
        "mv09_safe": _total_safe("MV-09"),
        "mv10_safe": _total_safe("MV-10"),
        "mv13_null_safe": _null_safe("MV-13"),
        "mv15_null_safe": _null_safe("MV-15"),
        "mv20_window": _check("MV-20", **WINDOW),
        "target_only_keys": _job(checks.target_only_keys),
        "reference_only_keys": _job(checks.reference_only_keys),
    }
    named |= {f"a{i}": _a(f"A{i}") for i in range(1, 6)}
    named |= {
        "a3_ratio": _a("A3R"),
        "a4_ratio": _a("A4R"),
        "a1_fund_grain": _a("A1", **FUND_GRAIN),
        "a1_key_grain": _a("A1", fan_out=False),
        "a1_window": _a("A1", **WINDOW),
    }
    named |= {f"b{i}": _b(f"B{i}") for i in range(1, 6)}
    named |= {
        "b1_fund_grain": _b("B1", **FUND_GRAIN),
        "b1_window": _b("B1", **WINDOW),
        "source_monthly": _source(rebuild.monthly_path),
        "source_daily": _source(rebuild.daily_path),
        "source_priced_fx": _job(
            lambda cfg, tables: rebuild.priced_funds(cfg, tables).withColumn(
                "cad_price", F.col("cad_price").cast("decimal(21,8)")
            )
        ),
        "source_with_dealer": _source(
            lambda cfg, tables: rebuild.with_dealer(cfg, tables, rebuild.source_positions(cfg, tables))
        ),
        "suite_results": _job(suite.suite_results),
        "suite_summary": _job(lambda cfg, tables: suite.summary(suite.suite_results(cfg, tables))),
        "suite_samples": _job(_samples, sample_rows=3),
        "suite_grid": _job(_grid),
        "runner_results": _runner_results,
        "runner_problems": _runner_problems,
        "run_changes": _job(_run_changes),
        "extract_accepted": _job(lambda cfg, tables: delimited.accepted(_checked(tables))),
        "extract_rejected": _job(
            lambda cfg, tables: delimited.rejected(_checked(tables)).withColumn("reasons", F.array_join("reasons", ","))
        ),
        "suite2_verdict": _job(verdict.report_verdict),
        "unpriced_positions": _job(rebuild.unpriced_positions),
        "unpriced_days": _job(rebuild.unpriced_days),
        "unpriced_days_window": _job(rebuild.unpriced_days, **WINDOW),
        "suite2_results": _job(verdict.report_results),
        "lost_days": _job(
            lambda cfg, tables: rebuild.lost_days(cfg, tables).select(
                "account_id", "management_company_code", "fund_code", "effective_date", "end_date", "lost_days"
            )
        ),
        "month_end_window": _trx(_month_end, "month_end", "window_side"),
        "biz_day_rank": _trx(
            lambda cfg, tables: transactions.business_day_rank(_month_end(cfg, tables)),
            "month_end", "window_side", "biz_day_rank",
        ),
        "signed_gross": _trx(
            lambda cfg, tables: transactions.signed_gross(tables["trx"]), "direction", "gross", "signed_gross"
        ),
        "fund_status": _trx(
            lambda cfg, tables: transactions.add_status(tables["trx"], tables["fund_status"]),
            "status_code", "status_mnemonic", "status_description", "allows_order_entry",
        ),
        "trx_typed": _trx(
            lambda cfg, tables: transactions.add_type(tables["trx"], tables["trx_type"]),
            "trx_code", "trx_description", "flow_code", "type_factor",
        ),
        "trx_untyped": _job(lambda cfg, tables: transactions.untyped(tables["trx"], tables["trx_type"])),
        "month_end_report": _trx(
            lambda cfg, tables: transactions.month_end_report(tables["trx"], tables["fund_status"]),
            "month_end", "window_side", "biz_day_rank", "status_code", "status_mnemonic", "status_description",
            "allows_order_entry", "trx_code", "direction", "gross", "signed_gross", "units", "price",
        ),
        "month_end_totals": _job(lambda cfg, tables: transactions.month_end_totals(tables["trx"])),
        "running_balance": _trx(_balances, "units", "unit_factor", "open_balance", "close_balance"),
        "balance_rollforward": _trx(
            lambda cfg, tables: transactions.roll_forward_exceptions(_booked(cfg, tables)),
            "units", "unit_factor", "open_balance", "close_balance", "gap",
        ),
        "direction_check": _trx(
            lambda cfg, tables: transactions.direction_exceptions(_balances(cfg, tables, "direction")),
            "direction", "open_balance", "close_balance", "balance_direction",
        ),
        "gross_check": _trx(
            lambda cfg, tables: transactions.gross_exceptions(tables["trx"]), "gross", "units", "price", "variance"
        ),
        "transfer_pairs": _job(lambda cfg, tables: transactions.transfer_pairs(tables["trx"])),
        "transfer_unmatched": _trx(
            lambda cfg, tables: transactions.transfer_unmatched(tables["trx"].select(*LEG_COLUMNS)), "gross", "unit_factor"
        ),
        "transfer_unmatched_hot": _trx(
            lambda cfg, tables: transactions.transfer_unmatched(_omnibus(tables["trx"].select(*LEG_COLUMNS))),
            "gross", "unit_factor",
        ),
        "running_balance_hot": _trx(
            lambda cfg, tables: transactions.running_balance(_busy_account(tables["trx"].select(*BALANCE_COLUMNS))),
            "open_balance", "close_balance",
        ),
    }
    if llm_queries:
        named |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return named


def oracle_sql() -> dict[str, str]:
    expected = dict(ORACLE_SQL)
    if llm_queries:
        expected |= llm_queries.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            expected["pipeline"] = corpus_pipeline.ORACLE_SQL
    return expected
