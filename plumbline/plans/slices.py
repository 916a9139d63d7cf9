"""The parts of target and reference that a run looks at, under common key names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import SuiteConfig

Tables = Mapping[str, DataFrame]


def month_column(day: str) -> str:
    """Name of the column that has the month of ``day`` in tables stored by month."""
    return f"{day}_month"


def in_window(df: DataFrame, cfg: SuiteConfig, day: str = "extract_date") -> DataFrame:
    """Closed date window; no window means all rows. Filters the stored column, so files can be skipped, and the month
    where the table is stored by month, so that other months aren't even listed."""
    if cfg.date_from is None:
        return df
    rows = df.where(F.col(day).between(F.lit(cfg.date_from), F.lit(cfg.date_to)))
    month = month_column(day)
    if month not in df.columns:
        return rows
    return rows.where(F.col(month).between(f"{cfg.date_from:%Y-%m}", f"{cfg.date_to:%Y-%m}")).drop(month)


def target_slice(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    rows = tables[cfg.target_table].where(F.col("source_system") == cfg.source_system)
    return in_window(rows, cfg)


def reference_slice(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    return in_window(tables[cfg.reference_table], cfg)


def keyed_reference(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """The reference slice with its keys named as in the target."""
    return reference_slice(cfg, tables).withColumnsRenamed(
        {
            "contract_policy_number": "policy_number",
            "fund_management_company_code": "manufacturing_company_code",
        }
    )


def product() -> Column:
    """Reference value, not rounded."""
    return F.col("canadian_unit_price") * F.col("number_of_units")


def expected_value() -> Column:
    """Reference value of one row, rounded to cents."""
    return F.round(product(), 2)
