"""Settings of a reconciliation run."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date
from decimal import Decimal

# The fourteen guarantee flags that must never be TRUE.
GUARANTEE_FLAGS = (
    "death_guarantee_reset_indicator",
    "econo_guarantee_indicator",
    "enhanced_guarantee_benefit_indicator",
    "extended_death_benefit_option_indicator",
    "flexible_income_option_indicator",
    "guarantee_indicator",
    "income_transition_period_option_indicator",
    "life_income_benefit_indicator",
    "life_income_benefit_joint_indicator",
    "life_income_benefit_single_indicator",
    "maturity_guarantee_reset_indicator",
    "nominee_account_indicator",
    "short_term_rate_protection_six_month_indicator",
    "short_term_rate_protection_twelve_month_indicator",
)

# Management companies whose daily positions are valued.
DAILY_COMPANIES = ("MAX", "CGF")

# Fixed value: price currency flag that asks for conversion.
FOREIGN_CURRENCY = "U"


@dataclass(frozen=True)
class SuiteConfig:
    """Table names, filters and limits; change environments by changing this object only.

    ``grain="policy"`` matches target and reference on (policy, company, date);
    ``grain="fund"`` adds the fund to the key.
    """

    source_system: str

    target_table: str = "wealth_assets"
    reference_table: str = "asset_reference"
    fund_dimension: str = "dim_fund"
    plan_dimension: str = "dim_plan"
    monthly_positions: str = "fund_position_monthly"
    daily_positions: str = "fund_position_daily"
    price_table: str = "fund_price"
    fx_table: str = "usd_fx_rate"
    account_table: str = "fund_account"

    date_from: date | None = None
    date_to: date | None = None

    value_tolerance: Decimal = Decimal("0.01")
    total_tolerance: float = 0.0001
    row_count_tolerance: float = 0.01
    high_value: Decimal = Decimal("1000000")
    match_limit: float = 0.0001
    investigate_limit: float = 0.001
    verdict_limit_pct: float = 0.01

    sample_rows: int = 25
    top_rows: int = 25
    grain: str = "policy"
    daily_companies: tuple[str, ...] = DAILY_COMPANIES
    foreign_currency: str = FOREIGN_CURRENCY

    # Pairs of one match key that may be compared one by one when counting.
    hot_match_pairs: int = 1_000_000_000

    def __post_init__(self) -> None:
        if self.grain not in ("policy", "fund"):
            raise ValueError(f"grain must be 'policy' or 'fund', got {self.grain!r}")
        if (self.date_from is None) != (self.date_to is None):
            raise ValueError("set both ends of the date window or none")

    def with_(self, **changes) -> SuiteConfig:
        return replace(self, **changes)

    @property
    def match_keys(self) -> list[str]:
        """Key of a record match, under the target's column names."""
        keys = ["policy_number", "manufacturing_company_code", "extract_date"]
        return keys + ["fund_code"] if self.grain == "fund" else keys
