"""The source side rebuilt from raw positions, prices, exchange rates and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import SuiteConfig
from plumbline.operators.joins import bucket_number, count_days_inside, interval_join, missing_from
from plumbline.plans.slices import Tables, in_window

MONTHLY = "MONTHLY"
DAILY = "DAILY"
DEALER_BUCKET = "year"

SOURCE_COLUMNS = [
    "account_id",
    "management_company_code",
    "fund_code",
    "extract_date",
    "shares",
    "raw_price",
    "fund_price_currency",
    "currency_exchange_rate",
    "cad_price",
    "source_market_value",
    "source_path",
    "is_monthly",
]


def home_price(cfg: SuiteConfig) -> Column:
    """Price in home currency; a missing price or a missing rate gives 0."""
    zero = F.lit(0).cast("decimal(1,0)")
    converted = F.coalesce(F.col("fund_price") * F.col("currency_exchange_rate"), zero)
    return F.when(F.col("fund_price_currency") == cfg.foreign_currency, converted).otherwise(
        F.coalesce(F.col("fund_price"), zero)
    )


def priced_funds(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Prices with their rate and home-currency price.

    The rate depends on the price row only, so it is looked up here, on the small side,
    and not again for every position. Rates are one row per day.
    """
    prices = in_window(tables[cfg.price_table], cfg, "fund_price_date")
    rates = in_window(tables[cfg.fx_table], cfg, "currency_exchange_date")
    joined = prices.join(rates, F.col("fund_price_date") == F.col("currency_exchange_date"), "left")
    return joined.select(
        "fund_code",
        "management_company_code",
        "fund_price_date",
        F.col("fund_price").alias("raw_price"),
        "fund_price_currency",
        "currency_exchange_rate",
        home_price(cfg).alias("cad_price"),
    )


def _valued(joined: DataFrame, day: str, path: Column, monthly: Column) -> DataFrame:
    return (
        joined.withColumn("extract_date", F.col(day))
        .withColumn("shares", F.col("shares_owned_amount"))
        .withColumn("source_market_value", F.col("shares") * F.col("cad_price"))
        .withColumn("source_path", path)
        .withColumn("is_monthly", monthly)
        .select(*SOURCE_COLUMNS)
    )


def dated_monthly_positions(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Monthly positions with the file date parsed; text that is no date gives null."""
    rows = tables[cfg.monthly_positions].withColumn("position_date", F.try_to_date("file_date", "yyMMdd"))
    return in_window(rows, cfg, "position_date")


def monthly_path(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Month-end positions at the price of their file date. Positions without a price drop out."""
    positions = dated_monthly_positions(cfg, tables)
    prices = priced_funds(cfg, tables).withColumnRenamed("fund_price_date", "position_date")
    joined = positions.join(prices, ["fund_code", "management_company_code", "position_date"])
    return _valued(joined, "position_date", F.lit(MONTHLY), F.lit(True))


def daily_positions(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    rows = tables[cfg.daily_positions].where(F.col("management_company_code").isin(*cfg.daily_companies))
    if cfg.date_from is None:
        return rows
    return rows.where(
        (F.col("effective_date") <= F.lit(cfg.date_to)) & (F.col("end_date") >= F.lit(cfg.date_from))
    )


def price_span(cfg: SuiteConfig, tables: Tables) -> tuple[Column, Column]:
    """First and last day that a price can have: the window, or else the range of the price table."""
    if cfg.date_from is not None:
        return F.lit(cfg.date_from), F.lit(cfg.date_to)
    days = tables[cfg.price_table].select("fund_price_date").where(F.col("fund_price_date").isNotNull())
    return (
        days.agg(F.min("fund_price_date")).scalar(),
        days.agg(F.max("fund_price_date")).scalar(),
    )


def joined_span(cfg: SuiteConfig, tables: Tables) -> tuple[Column, Column]:
    """First and last day that a priced position can have.

    Of the price table only rows that a join can find, chosen as the join does: the scan and shuffle that make the prices
    then serve this, too.
    """
    if cfg.date_from is not None:
        return price_span(cfg, tables)
    day = F.col("fund_price_date")
    found = F.col("fund_code").isNotNull() & F.col("management_company_code").isNotNull()
    listed = bucket_number(day, "month").isNotNull()
    days = tables[cfg.price_table].where(found & day.isNotNull() & listed)
    return days.agg(F.min(day)).scalar(), days.agg(F.max(day)).scalar()


def _at_prices_of_each_day(cfg: SuiteConfig, tables: Tables, positions: DataFrame) -> DataFrame:
    return interval_join(
        priced_funds(cfg, tables),
        positions,
        on=["fund_code", "management_company_code"],
        point="fund_price_date",
        low="effective_date",
        high="end_date",
        span=joined_span(cfg, tables),
    )


def daily_path(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Every day of a position's validity at that day's price."""
    joined = _at_prices_of_each_day(cfg, tables, daily_positions(cfg, tables))
    return _valued(joined, "fund_price_date", F.lit(DAILY), F.lit(False))


def source_positions(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Both paths. An account may be in both on a day; the paths are not reconciled here.

    A monthly position is valid on its file date only, so one join with the prices serves both paths and prices are made
    and shuffled once.
    """
    columns = ["account_id", "management_company_code", "fund_code", "shares_owned_amount"]
    monthly = dated_monthly_positions(cfg, tables).select(
        *columns,
        F.col("position_date").alias("effective_date"),
        F.col("position_date").alias("end_date"),
        F.lit(True).alias("is_monthly"),
    )
    daily = daily_positions(cfg, tables).select(*columns, "effective_date", "end_date", F.lit(False).alias("is_monthly"))
    joined = _at_prices_of_each_day(cfg, tables, monthly.unionByName(daily))
    path = F.when(F.col("is_monthly"), MONTHLY).otherwise(DAILY)
    return _valued(joined, "fund_price_date", path, F.col("is_monthly"))


def with_dealer(cfg: SuiteConfig, tables: Tables, rows: DataFrame) -> DataFrame:
    """Add the dealer that served the account on the extract date; null if there was none.

    Two periods that share a boundary day both match on it. Periods are listed under the years that they touch, within the
    days that prices can have, so a position of an account with a long history meets the few periods of its year only, and
    the account's positions are spread over years.
    """
    accounts = tables[cfg.account_table].select(
        "account_id", "management_company_code", "dealer_code", "effective_date", "end_date"
    )
    joined = interval_join(
        rows,
        accounts,
        on=["account_id", "management_company_code"],
        point="extract_date",
        low="effective_date",
        high="end_date",
        how="left",
        bucket=DEALER_BUCKET,
        span=joined_span(cfg, tables),
    )
    return joined.drop("effective_date", "end_date")


def unpriced_monthly(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Monthly positions that the price join loses: no price that day, or an unreadable file date."""
    rows = tables[cfg.monthly_positions].withColumn("position_date", F.try_to_date("file_date", "yyMMdd"))
    if cfg.date_from is not None:
        inside = F.col("position_date").between(F.lit(cfg.date_from), F.lit(cfg.date_to))
        rows = rows.where(inside | F.col("position_date").isNull())
    prices = tables[cfg.price_table].withColumnRenamed("fund_price_date", "position_date")
    return missing_from(rows, prices, ["fund_code", "management_company_code", "position_date"])


def unpriced_daily(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Daily positions that the price join loses: no price of fund and company on any day of their validity."""
    positions = daily_positions(cfg, tables)
    prices = in_window(tables[cfg.price_table], cfg, "fund_price_date").select(
        F.col("fund_code").alias("_fund"), F.col("management_company_code").alias("_company"), "fund_price_date"
    )
    same = (F.col("fund_code") == F.col("_fund")) & (F.col("management_company_code") == F.col("_company"))
    valid = F.col("fund_price_date").between(F.col("effective_date"), F.col("end_date"))
    return positions.join(prices, same & valid, "left_anti")


def unpriced_positions(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Positions that never reach a report, counted by path, company and reason."""
    unreadable = F.when(F.col("position_date").isNull(), "UNREADABLE DATE").otherwise("NO PRICE")
    monthly = unpriced_monthly(cfg, tables).select(
        F.lit(MONTHLY).alias("source_path"), "management_company_code", unreadable.alias("reason")
    )
    daily = unpriced_daily(cfg, tables).select(
        F.lit(DAILY).alias("source_path"), "management_company_code", F.lit("NO PRICE").alias("reason")
    )
    return (
        monthly.unionByName(daily)
        .groupBy("source_path", "management_company_code", "reason")
        .agg(F.count(F.lit(1)).alias("positions"))
    )


def lost_days(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Daily positions that lose days to the price join, with ``lost_days``: days of their validity on which some fund
    was priced, but theirs was not. Days without any price, such as weekends, are nobody's loss."""
    prices = in_window(tables[cfg.price_table], cfg, "fund_price_date")
    span = price_span(cfg, tables)
    validity = ("effective_date", "end_date", span)
    quoted = count_days_inside(
        daily_positions(cfg, tables), prices, [], "fund_price_date", *validity, "_quoted"
    )
    priced = count_days_inside(
        quoted, prices, ["fund_code", "management_company_code"], "fund_price_date", *validity, "_priced"
    )
    lost = F.col("_quoted") - F.col("_priced")
    return priced.withColumn("lost_days", lost).where("lost_days > 0").drop("_quoted", "_priced")


def unpriced_days(cfg: SuiteConfig, tables: Tables) -> DataFrame:
    """Position-days that never reach a report, by path, company and reason, and the positions that lose them.

    A monthly position is one position-day, also if its date cannot be read.
    """
    unreadable = F.when(F.col("position_date").isNull(), "UNREADABLE DATE").otherwise("NO PRICE")
    monthly = unpriced_monthly(cfg, tables).select(
        F.lit(MONTHLY).alias("source_path"),
        "management_company_code",
        unreadable.alias("reason"),
        F.lit(1).cast("bigint").alias("lost_days"),
    )
    daily = lost_days(cfg, tables).select(
        F.lit(DAILY).alias("source_path"), "management_company_code", F.lit("NO PRICE").alias("reason"), "lost_days"
    )
    return (
        monthly.unionByName(daily)
        .groupBy("source_path", "management_company_code", "reason")
        .agg(F.count(F.lit(1)).alias("positions"), F.sum("lost_days").alias("position_days"))
    )
