import os
import sys
from datetime import date
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from plumbline.config import GUARANTEE_FLAGS, SuiteConfig  # noqa: E402
from plumbline.session import build_session  # noqa: E402
from plumbline.sources.tables import TableSet  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

TARGET_SCHEMA = (
    "source_system string, policy_number string, manufacturing_company_code string, extract_date date,"
    " fund_code string, number_of_units decimal(12,4), unit_value decimal(12,4), market_value decimal(18,2),"
    " dealer_code string, plan_identifier_sk bigint, fund_sk bigint, extract_date_sk bigint,"
    " monthly_extract_indicator boolean, weekly_extract_indicator boolean, "
    + ", ".join(f"{f} boolean" for f in GUARANTEE_FLAGS)
)
REFERENCE_SCHEMA = (
    "contract_policy_number string, fund_code string, fund_management_company_code string, extract_date date,"
    " number_of_units decimal(12,4), canadian_unit_price decimal(12,4), market_value decimal(18,8),"
    " dealer_code string, plan_identifier_sk bigint, monthly_extract_indicator boolean,"
    " weekly_extract_indicator boolean"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def cfg():
    return SuiteConfig(source_system="S")


def dec(value):
    return None if value is None else Decimal(str(value))


def target_row(policy="P1", day=date(2025, 9, 30), fund="F1", units=10, price=2, value=20, **changes):
    row = {
        "source_system": "S",
        "policy_number": policy,
        "manufacturing_company_code": "MAX",
        "extract_date": day,
        "fund_code": fund,
        "number_of_units": dec(units),
        "unit_value": dec(price),
        "market_value": dec(value),
        "dealer_code": "D1",
        "plan_identifier_sk": 1,
        "fund_sk": 1,
        "extract_date_sk": 1,
        "monthly_extract_indicator": True,
        "weekly_extract_indicator": False,
        **dict.fromkeys(GUARANTEE_FLAGS, False),
    }
    return row | changes


def reference_row(policy="P1", day=date(2025, 9, 30), fund="F1", units=10, price=2, value=20, **changes):
    row = {
        "contract_policy_number": policy,
        "fund_code": fund,
        "fund_management_company_code": "MAX",
        "extract_date": day,
        "number_of_units": dec(units),
        "canadian_unit_price": dec(price),
        "market_value": dec(value),
        "dealer_code": "D1",
        "plan_identifier_sk": 1,
        "monthly_extract_indicator": True,
        "weekly_extract_indicator": False,
    }
    return row | changes


def frame(spark, rows, schema):
    names = [part.split()[0] for part in schema.replace("decimal(12,4)", "d").replace("decimal(18,2)", "d")
             .replace("decimal(18,8)", "d").replace("decimal(8,4)", "d").replace("decimal(18,4)", "d").split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@pytest.fixture
def tables(spark):
    """TableSet from lists of target and reference rows."""

    def make(target, reference):
        return TableSet.from_frames(
            {
                "wealth_assets": frame(spark, target, TARGET_SCHEMA),
                "asset_reference": frame(spark, reference, REFERENCE_SCHEMA),
            }
        )

    return make
