"""The twenty market-value checks. Each builds the DataFrame of its violations.

The predicates stand once, in the rule tables below; ``plans.suite`` counts with the
same predicates in shared passes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import GUARANTEE_FLAGS, SuiteConfig
from plumbline.functions.compare import (
    any_flag,
    beyond,
    differs,
    differs_null_safe,
    differs_or_left_null,
    gap_ratio,
    gap_ratio_safe,
    money,
    percent,
    unresolved_key,
)
from plumbline.operators.joins import match_rows, missing_from
from plumbline.operators.ordered import sort_once
from plumbline.plans.slices import (
    Tables,
    expected_value,
    keyed_reference,
    product,
    reference_slice,
    target_slice,
)

KEYS = ["policy_number", "manufacturing_company_code", "extract_date"]
REFERENCE_KEYS = ["contract_policy_number", "fund_management_company_code", "extract_date"]

Build = Callable[[SuiteConfig, Tables], DataFrame]


# --- checks on the target alone -------------------------------------------------------------


@dataclass(frozen=True)
class TargetRule:
    """A condition on target rows that marks a violation."""

    violates: Callable[[], Column]
    columns: tuple[str, ...]
    order: Callable[[], list[Column]] = lambda: []


def _newest_first() -> list[Column]:
    return [F.desc("extract_date"), F.col("policy_number"), F.col("manufacturing_company_code")]


TARGET_RULES = {
    "MV-11": TargetRule(
        lambda: F.col("plan_identifier_sk").isNull(), (*KEYS, "plan_identifier_sk"), _newest_first
    ),
    "MV-14": TargetRule(lambda: any_flag(GUARANTEE_FLAGS), (*KEYS, *GUARANTEE_FLAGS)),
    "MV-16": TargetRule(lambda: unresolved_key(F.col("fund_sk")), (*KEYS, "fund_sk"), _newest_first),
    "MV-17": TargetRule(
        lambda: unresolved_key(F.col("extract_date_sk")), (*KEYS, "extract_date_sk"), _newest_first
    ),
    "MV-18": TargetRule(
        lambda: F.col("market_value") < 0,
        (*KEYS, "number_of_units", "unit_value", "market_value"),
        lambda: [F.asc("market_value"), *[F.col(k) for k in KEYS]],
    ),
    "MV-19": TargetRule(
        lambda: (F.col("number_of_units") == 0) & (F.col("market_value") != 0),
        (*KEYS, "number_of_units", "unit_value", "market_value"),
    ),
}


def target_violations(cfg: SuiteConfig, tables: Tables, check_id: str) -> DataFrame:
    rule = TARGET_RULES[check_id]
    rows = target_slice(cfg, tables).where(rule.violates()).select(*rule.columns)
    return sort_once(rows, rule.order(), KEYS) if rule.order() else rows


def null_plan_totals(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Totals of the rows without a plan, per plan key and day."""
    return (
        target_slice(cfg, tables)
        .where(F.col("plan_identifier_sk").isNull())
        .groupBy("plan_identifier_sk", "extract_date")
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            money(F.sum("market_value")).alias("total_mv"),
            money(F.sum("number_of_units"), 4).alias("total_units"),
            (F.sum("unit_value").cast("double") / F.count("unit_value")).alias("avg_unit_price"),
        )
        .orderBy(F.desc("total_mv"), "extract_date")
    )


# --- checks on matched records --------------------------------------------------------------


@dataclass(frozen=True)
class RecordRule:
    """A comparison of a target value with a reference value of the same key.

    ``sides`` names the two compared columns; ``rule`` says when they disagree.
    """

    target: dict[str, Callable[[], Column]]
    reference: dict[str, Callable[[], Column]]
    sides: tuple[str, str]
    rule: str
    columns: tuple[str, ...]
    difference: str | None = None

    def shown(self) -> list[Column]:
        """The values that a violation is listed with."""
        left, right = (F.col(name) for name in self.sides)
        gap = [F.abs(left - right).alias(self.difference)] if self.difference else []
        return [*[F.col(c) for c in self.columns], *gap]

    def violates(self, cfg: SuiteConfig) -> Column:
        left, right = (F.col(name) for name in self.sides)
        if self.rule == "beyond":
            return beyond(left, right, cfg.value_tolerance)
        return COMPARISONS[self.rule](left, right)


COMPARISONS = {
    "differs": differs,
    "differs_or_left_null": differs_or_left_null,
    "differs_null_safe": differs_null_safe,
}


def _col(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _same_column(name: str, short: str, rule: str) -> RecordRule:
    t, r = f"tgt_{short}", f"ref_{short}"
    return RecordRule({t: _col(name)}, {r: _col(name)}, (t, r), rule, (t, r))


RECORD_RULES = {
    "MV-05": RecordRule(
        {"tgt_mv": _col("market_value")},
        {
            "ref_units": _col("number_of_units"),
            "ref_price": _col("canadian_unit_price"),
            "expected_mv": lambda: expected_value().cast("decimal(18,2)"),
        },
        ("tgt_mv", "expected_mv"),
        "beyond",
        ("ref_units", "ref_price", "expected_mv", "tgt_mv"),
        "variance",
    ),
    "MV-06": RecordRule(
        {"tgt_unit_value": _col("unit_value")},
        {"ref_price": _col("canadian_unit_price")},
        ("tgt_unit_value", "ref_price"),
        "beyond",
        ("tgt_unit_value", "ref_price"),
        "variance",
    ),
    "MV-07": replace(_same_column("number_of_units", "units", "beyond"), difference="diff"),
    "MV-12": _same_column("monthly_extract_indicator", "monthly", "differs"),
    "MV-13": _same_column("weekly_extract_indicator", "weekly", "differs"),
    "MV-15": _same_column("plan_identifier_sk", "plan_sk", "differs_or_left_null"),
}


# The comparisons of MV-12, MV-13 and MV-15 with null against a value as a difference.
RECORD_VARIANTS = {
    f"{i}-null-safe": replace(RECORD_RULES[i], rule="differs_null_safe") for i in ("MV-12", "MV-13", "MV-15")
}


def record_sides(cfg: SuiteConfig, tables: Tables, check_ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys and the values that the given checks look at, of target and reference."""
    target: dict[str, Column] = {}
    reference: dict[str, Column] = {}
    for check_id in check_ids:
        rule = RECORD_RULES.get(check_id) or RECORD_VARIANTS[check_id]
        target |= {name: make().alias(name) for name, make in rule.target.items()}
        reference |= {name: make().alias(name) for name, make in rule.reference.items()}
    return (
        target_slice(cfg, tables).select(*cfg.match_keys, *target.values()),
        keyed_reference(cfg, tables).select(*cfg.match_keys, *reference.values()),
    )


def matched_records(cfg: SuiteConfig, tables: Tables, check_ids: list[str]) -> DataFrame:
    """Target and reference values side by side for the given checks."""
    return match_rows(*record_sides(cfg, tables, check_ids), cfg.match_keys)


def record_violations(cfg: SuiteConfig, tables: Tables, check_id: str) -> DataFrame:
    """Violations of a record check; the ids of the variants below work as well."""
    rule = RECORD_RULES.get(check_id) or RECORD_VARIANTS[check_id]
    hits = matched_records(cfg, tables, [check_id]).where(rule.violates(cfg))
    rows = hits.select(*cfg.match_keys, *rule.shown())
    if rule.difference is None:
        return rows
    return rows.orderBy(F.desc(rule.difference), *cfg.match_keys)


# --- checks on totals -----------------------------------------------------------------------


def target_totals(
    cfg: SuiteConfig, tables: Tables, group: list[str], listed: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """Rows and value per group; ``listed`` may list the rows under groups first."""
    rows = listed(target_slice(cfg, tables))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("tgt_rows"), F.sum("market_value").alias("tgt_total"))


def reference_totals(
    cfg: SuiteConfig, tables: Tables, group: list[str], listed: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    rows = listed(keyed_reference(cfg, tables).withColumn("_expected", expected_value()))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("ref_rows"), F.sum("_expected").alias("ref_total"))


def row_gap() -> Column:
    return gap_ratio(F.col("tgt_rows"), F.col("ref_rows"))


def total_gap(safe: bool = False) -> Column:
    """Gap of the totals; the safe form also sees gaps to a negative reference total."""
    ratio = gap_ratio_safe if safe else gap_ratio
    return ratio(F.col("tgt_total"), F.col("ref_total"))


TOTAL_GROUPS = {
    "MV-03": ["extract_date"],
    "MV-08": ["extract_date"],
    "MV-09": ["extract_date", "manufacturing_company_code"],
    "MV-10": ["extract_date", "dealer_code"],
}


def row_count_violations(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    group = TOTAL_GROUPS["MV-03"]
    both = target_totals(cfg, tables, group).join(reference_totals(cfg, tables, group), group)
    return (
        both.where(row_gap() > cfg.row_count_tolerance)
        .select(
            *group,
            "tgt_rows",
            "ref_rows",
            F.abs(F.col("tgt_rows") - F.col("ref_rows")).alias("row_diff"),
            percent(row_gap(), 4).alias("pct_diff"),
        )
        .orderBy(F.desc("pct_diff"), *group)
    )


def total_violations(cfg: SuiteConfig, tables: Tables, check_id: str, safe: bool = False) -> DataFrame:
    group = TOTAL_GROUPS[check_id]
    both = target_totals(cfg, tables, group).join(reference_totals(cfg, tables, group), group)
    return (
        both.where(total_gap(safe) > cfg.total_tolerance)
        .select(
            *group,
            money(F.col("tgt_total")).alias("tgt_total"),
            money(F.col("ref_total")).alias("ref_total"),
            money(F.abs(F.col("tgt_total") - F.col("ref_total"))).alias("variance"),
            percent(total_gap(safe), 6).alias("pct_variance"),
        )
        .orderBy(F.desc("pct_variance"), *group)
    )


# --- presence, reference self-check, missing keys -------------------------------------------


def target_present(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    return target_slice(cfg, tables).select(F.lit(1).alias("present")).limit(1)


def reference_present(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    return reference_slice(cfg, tables).select(F.lit(1).alias("present")).limit(1)


def stored_value_off(cfg: SuiteConfig) -> Column:
    return beyond(F.col("market_value"), product(), cfg.value_tolerance)


def stored_value_violations(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """All reference rows whose stored value is not price times units."""
    return (
        reference_slice(cfg, tables)
        .where(stored_value_off(cfg))
        .select(
            "contract_policy_number",
            "fund_code",
            "fund_management_company_code",
            "extract_date",
            "number_of_units",
            "canadian_unit_price",
            F.col("market_value").alias("stored_mv"),
            expected_value().cast("decimal(18,2)").alias("calculated_mv"),
            F.abs(F.col("market_value") - product()).cast("decimal(28,8)").alias("variance"),
        )
    )


def stored_value_top(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """The largest of them, in a total order so that ties cannot change the result."""
    rows = stored_value_violations(cfg, tables)
    rest = [c for c in rows.columns if c != "variance"]
    return rows.orderBy(F.desc("variance"), *rest).limit(cfg.top_rows)


def high_value_missing(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """High-value reference rows without any target row of the key.

    The key holds the date, so cutting the target to the window as well changes nothing.
    """
    high = (
        keyed_reference(cfg, tables)
        .withColumn("expected_mv", expected_value().cast("decimal(18,2)"))
        .where(F.col("expected_mv") > F.lit(cfg.high_value))
    )
    lost = missing_from(high, target_slice(cfg, tables), cfg.match_keys)
    names = dict(zip(KEYS, REFERENCE_KEYS, strict=True))
    keys = [names.get(k, k) for k in cfg.match_keys]
    rows = lost.select(*[F.col(k).alias(n) for k, n in zip(cfg.match_keys, keys, strict=True)], "expected_mv")
    return sort_once(rows, [F.desc("expected_mv"), *keys], keys)


def target_only_keys(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Keys of the target that the reference does not hold; no check of the suite looks at these."""
    keys = cfg.match_keys
    lost = missing_from(target_slice(cfg, tables).select(*keys), keyed_reference(cfg, tables), keys)
    return lost.groupBy(*keys).agg(F.count(F.lit(1)).alias("target_rows"))


def reference_only_keys(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Keys of the reference that the target does not hold, whatever their value."""
    keys = cfg.match_keys
    lost = missing_from(keyed_reference(cfg, tables).select(*keys), target_slice(cfg, tables), keys)
    return lost.groupBy(*keys).agg(F.count(F.lit(1)).alias("reference_rows"))


def predicate(cfg: SuiteConfig, check_id: str) -> str | None:
    """The condition that marks a violation, as Spark reads it, for checks on single rows and matched records."""
    if check_id in TARGET_RULES:
        condition = TARGET_RULES[check_id].violates()
    elif check_id in RECORD_RULES:
        condition = RECORD_RULES[check_id].violates(cfg)
    elif check_id == "MV-04":
        condition = stored_value_off(cfg)
    else:
        return None
    return str(condition).removeprefix("Column<'").removesuffix("'>")


# --- catalogue ------------------------------------------------------------------------------


@dataclass(frozen=True)
class CheckSpec:
    """One check: what it asks, when it passes, how its result rows are built.

    ``build`` gives the rows; ``sql`` may stand in for it as a query text.
    """

    test_id: str
    test_name: str
    category: str
    description: str
    validates: str
    build: Build | None = None
    pass_when: str = "zero_rows"
    threshold: float = 0.0
    sql: str | None = None
    sample: Build | None = field(default=None, repr=False)


# The six categories.
COVERAGE = "Row Count & Coverage"
FORMULA = "Market Value Formula"
BREAKDOWN = "Dimensional Breakdown"
FLAGS = "Indicator Flags"
MATCHING = "Plan & Product Matching"
EDGES = "Edge Cases"


def _target(check_id: str) -> Build:
    return lambda cfg, tables: target_violations(cfg, tables, check_id)


def _record(check_id: str) -> Build:
    return lambda cfg, tables: record_violations(cfg, tables, check_id)


def _total(check_id: str) -> Build:
    return lambda cfg, tables: total_violations(cfg, tables, check_id)


CHECKS: tuple[CheckSpec, ...] = (
    CheckSpec(
        "MV-01", "Target holds rows", COVERAGE,
        "Without target rows for the source system nothing else can be judged.",
        "Target is loaded", target_present, "has_rows",
    ),
    CheckSpec(
        "MV-02", "Reference holds rows", COVERAGE,
        "Without reference rows nothing can be compared.",
        "Reference is loaded", reference_present, "has_rows",
    ),
    CheckSpec(
        "MV-03", "Row counts agree per day", COVERAGE,
        "Days on which target and reference counts are further apart than the limit.",
        "Completeness of the load per day", row_count_violations,
    ),
    CheckSpec(
        "MV-04", "Reference value is price times units", FORMULA,
        "Reference rows whose stored value is off; largest first.",
        "Reference is sound in itself", stored_value_violations, sample=stored_value_top,
    ),
    CheckSpec(
        "MV-05", "Target value is reference price times units", FORMULA,
        "Matched rows whose target value differs from the rounded product. The main check.",
        "Value of each record", _record("MV-05"),
    ),
    CheckSpec(
        "MV-06", "Target unit value is reference price", FORMULA,
        "Matched rows with different prices.",
        "Price and conversion", _record("MV-06"),
    ),
    CheckSpec(
        "MV-07", "Units agree", FORMULA,
        "Matched rows with different unit counts.",
        "Units", _record("MV-07"),
    ),
    CheckSpec(
        "MV-08", "Total value agrees per day", BREAKDOWN,
        "Days whose totals are further apart than the limit.",
        "Totals per day", _total("MV-08"),
    ),
    CheckSpec(
        "MV-09", "Total value agrees per day and company", BREAKDOWN,
        "Company days whose totals are further apart than the limit.",
        "Totals per company", _total("MV-09"),
    ),
    CheckSpec(
        "MV-10", "Total value agrees per day and dealer", BREAKDOWN,
        "Dealer days whose totals are further apart than the limit.",
        "Totals per dealer", _total("MV-10"),
    ),
    CheckSpec(
        "MV-11", "Every target row has a plan", BREAKDOWN,
        "Target rows without a plan key.",
        "Plan classification", _target("MV-11"),
    ),
    CheckSpec(
        "MV-12", "Monthly flag agrees", FLAGS,
        "Matched rows with different monthly flags.",
        "Monthly flag", _record("MV-12"),
    ),
    CheckSpec(
        "MV-13", "Weekly flag agrees", FLAGS,
        "Matched rows with different weekly flags.",
        "Weekly flag", _record("MV-13"),
    ),
    CheckSpec(
        "MV-14", "No guarantee flag is set", FLAGS,
        "Target rows with one of the fourteen guarantee flags set.",
        "Guarantee flags", _target("MV-14"),
    ),
    CheckSpec(
        "MV-15", "Plan key agrees", MATCHING,
        "Matched rows with different plan keys, or none in the target.",
        "Plan lookup", _record("MV-15"),
    ),
    CheckSpec(
        "MV-16", "Fund key is resolved", MATCHING,
        "Target rows whose fund key is 0 or missing.",
        "Fund lookup", _target("MV-16"),
    ),
    CheckSpec(
        "MV-17", "Date key is resolved", MATCHING,
        "Target rows whose date key is 0 or missing.",
        "Date lookup", _target("MV-17"),
    ),
    CheckSpec(
        "MV-18", "No negative value", EDGES,
        "Target rows with a value below zero.",
        "Sign of the value", _target("MV-18"),
    ),
    CheckSpec(
        "MV-19", "No units, no value", EDGES,
        "Target rows with a value but without units.",
        "Empty positions", _target("MV-19"),
    ),
    CheckSpec(
        "MV-20", "High-value rows reach the target", EDGES,
        "Reference rows above the high-value limit without a target row.",
        "Nothing large is lost", high_value_missing,
    ),
)

CHECKS_BY_ID = {spec.test_id: spec for spec in CHECKS}
