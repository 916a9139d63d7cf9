"""The logical tables, derived from a star schema of orders.

Each line item becomes one fund holding of one account on one day. Faults are planted
in the target by a rule on the order, line and part numbers, so every check has known
violations. Money is exact decimal throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import GUARANTEE_FLAGS, SuiteConfig
from plumbline.sources.tables import TableSet

SOURCE_SYSTEM = "SYS_A"
OTHER_SYSTEM = "SYS_B"
HIGH_VALUE = 30_000
FAULT_MONTHS = (3, 6, 9)
YEARS_AHEAD = 24


def star_config(**changes) -> SuiteConfig:
    """Settings for the star-schema tables: no row there reaches the default high-value limit."""
    from decimal import Decimal

    return SuiteConfig(source_system=SOURCE_SYSTEM, high_value=Decimal(HIGH_VALUE)).with_(**changes)


class StarFiles:
    """The files of one folder, each listed once; several logical tables come from the same files."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._frames[name]


def _dec(value, precision: int, scale: int) -> Column:
    col = value if isinstance(value, Column) else F.col(value)
    return col.cast(f"decimal({precision},{scale})")


def _shift(day: Column) -> Column:
    return F.add_months(day.cast("date"), 12 * YEARS_AHEAD)


def _ticks(value: Column, precision: int) -> Column:
    """Whole ten-thousandths -> decimal. Prices are computed in whole numbers, which is exact and fast."""
    return (value.cast("decimal(18,0)") * F.expr("0.0001BD")).cast(f"decimal({precision},4)")


def _rate_ticks(day: Column) -> Column:
    return F.day(day) * 10 + 12_500


def _rate(day: Column) -> Column:
    return _ticks(_rate_ticks(day), 8)


def _company() -> Column:
    """Two companies whose daily positions are valued, and a third one that only the monthly file counts."""
    return F.when(F.col("l_partkey") % 37 == 0, "OTH").when(F.col("l_linestatus") == "O", "MAX").otherwise("CGF")


def _february(day: Column, number: int) -> Column:
    return (F.month(day) == 2) & (F.day(day) == number)


def _units() -> Column:
    """Short positions on 29 February, none on the 28th: totals below zero and of zero."""
    day = F.col("l_shipdate")
    sign = F.when(_february(day, 29), -1).when(_february(day, 28), 0).otherwise(1)
    return F.col("l_quantity").cast("decimal(12,4)") * sign.cast("decimal(1,0)")


def _parts(files: StarFiles) -> DataFrame:
    """Part key and the part of its price that does not depend on the day, in ticks."""
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    return files.read("part").select(
        "p_partkey", (cents * 100 + F.col("p_partkey") % 97 * 13).alias("part_ticks")
    )


def _raw_ticks() -> Column:
    return F.col("part_ticks") + F.day("l_shipdate") * 100


def _foreign() -> Column:
    return F.col("l_partkey") % 5 == 0


def _ordered_lines(files: StarFiles, *columns: str) -> DataFrame:
    """Line items with the customer of their order, ``columns`` beside the ship date.

    The columns pass as one value, so whatever columns and rows a table then takes, the shuffles of this join are the same
    for the tables of a query, and Spark makes them once. The ship date stands beside it, as date windows are to be applied
    before the join; a table whose date is filtered has shuffles of its own.
    """
    lines = files.read("lineitem").select("l_orderkey", "l_shipdate", *columns)
    orders = files.read("orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_shipdate", F.inline(F.array(F.struct("o_custkey", "l_orderkey", *columns))))


def _priced_lines(files: StarFiles, dated: bool) -> DataFrame:
    """Line items with the customer of their order and the price of their part: those with a ship date, or those without.

    Orders and parts are joined before the columns pass as one value (see ``_ordered_lines``), so the tables of a query
    share both shuffles of the line items. A join on the date drops rows without one, which other tables keep: apart, these
    cost nothing where they are dropped, and the rows with a date are the same for both.
    """
    columns = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus"]
    lines = files.read("lineitem").select("l_orderkey", "l_shipdate", *columns)
    orders = files.read("orders").select("o_orderkey", "o_custkey")
    known = F.col("l_shipdate").isNotNull()
    joined = lines.where(known if dated else ~known).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(_parts(files), F.col("l_partkey") == F.col("p_partkey"))
    day = "l_shipdate" if dated else F.lit(None).cast(lines.schema["l_shipdate"].dataType).alias("l_shipdate")
    return joined.select(day, F.inline(F.array(F.struct("o_custkey", "l_orderkey", *columns, "part_ticks"))))


def holdings(files: StarFiles) -> DataFrame:
    """One row per line item: account, company, fund, day, units, price and the fault selector."""
    # Spark is told that a line with a ship date has these days, or it would filter them once more where they are joined.
    day = _shift(F.col("l_shipdate"))
    never = F.lit("1970-01-01").cast("date")
    dated = _priced_lines(files, dated=True).withColumns(
        {"extract_date": F.coalesce(day, never), "last_valid": F.coalesce(_last_valid(day), never)}
    )
    undated = _priced_lines(files, dated=False).withColumns({"extract_date": day, "last_valid": _last_valid(day)})
    return _holdings(dated).unionByName(_holdings(undated))


def _last_valid(day: Column) -> Column:
    """The last day that a daily position of a day is valid."""
    return F.when(F.month(day).isin(*FAULT_MONTHS), F.date_add(day, 30)).otherwise(day)


def _holdings(lines: DataFrame) -> DataFrame:
    day = F.col("extract_date")
    fault = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_partkey")) % 1000
    # Every input is named once, as filters on the price are evaluated in this form.
    factor = F.when(_foreign(), _rate_ticks(F.col("l_shipdate"))).otherwise(10_000)
    price = F.floor((_raw_ticks() * factor + 5_000) / 10_000)
    return lines.select(
        F.col("o_custkey").cast("string").alias("account"),
        _company().alias("company"),
        F.col("l_partkey").cast("string").alias("fund_code"),
        "l_partkey",
        day,
        "last_valid",
        F.col("l_suppkey").cast("string").alias("dealer_code"),
        _dec(_units(), 12, 4).alias("units"),
        _ticks(price, 12).alias("price"),
        (F.col("l_partkey") % 7 + 1).alias("plan_sk"),
        (F.col("l_partkey") + 1).alias("fund_sk"),
        (F.year("l_shipdate") * 1000 + F.month("l_shipdate")).cast("bigint").alias("date_sk"),
        (day == F.last_day(day)).alias("monthly"),
        (F.dayofweek(day) == 6).alias("weekly"),
        F.when(F.month("l_shipdate").isin(*FAULT_MONTHS), fault).otherwise(999).alias("h"),
    )


def _h(low: int, high: int | None = None) -> Column:
    return F.col("h").between(low, low if high is None else high)


def asset_reference(files: StarFiles) -> DataFrame:
    value = F.col("price") * F.col("units") + F.when(_h(997), F.lit(1)).otherwise(0).cast("decimal(1,0)")
    return holdings(files).select(
        F.col("account").alias("contract_policy_number"),
        "fund_code",
        F.col("company").alias("fund_management_company_code"),
        "extract_date",
        F.col("units").alias("number_of_units"),
        F.col("price").alias("canadian_unit_price"),
        value.cast("decimal(18,8)").alias("market_value"),
        "dealer_code",
        F.when(_h(996), None).otherwise(F.col("plan_sk")).alias("plan_identifier_sk"),
        F.when(_h(998), None).otherwise(F.col("monthly")).alias("monthly_extract_indicator"),
        F.when(_h(995), None).otherwise(F.col("weekly")).alias("weekly_extract_indicator"),
    )


def wealth_assets(files: StarFiles) -> DataFrame:
    """The reference rows with planted faults, and rows of a second source system."""
    bump = (
        F.when(_h(5, 14), F.expr("0.05BD"))
        .when((F.month("extract_date") == 12) | _february(F.col("extract_date"), 29), F.expr("0.5BD"))
        .otherwise(F.expr("0.00BD"))
    )
    no_units = _h(75, 79)
    rows = (
        holdings(files)
        .withColumn("t_price", _dec(F.col("price") + bump, 12, 4))
        .withColumn("t_units", _dec(F.col("units") + F.when(_h(15, 24), 1).otherwise(0), 12, 4))
    )
    # As one value, so prices are made once: a filter on the market value, as joins add for nulls, would make them all again
    # in front of the join with the parts, in a method too long to be compiled.
    value = _dec(F.round(F.col("t_price") * F.col("t_units"), 2), 18, 2).alias("t_value")
    rows = rows.select(*rows.drop("t_price", "t_units").columns, F.inline(F.array(F.struct("t_price", "t_units", value))))
    shared = [
        F.concat(F.col("account"), F.when(_h(80), "-X").otherwise("")).alias("policy_number"),
        F.col("company").alias("manufacturing_company_code"),
        "extract_date",
        "fund_code",
        F.when(no_units, F.lit(0).cast("decimal(12,4)")).otherwise(F.col("t_units")).alias("number_of_units"),
        F.col("t_price").alias("unit_value"),
    ]
    keys = [
        "dealer_code",
        F.when(_h(30, 34), None)
        .when(_h(70, 74), F.col("plan_sk") + 1)
        .otherwise(F.col("plan_sk"))
        .alias("plan_identifier_sk"),
        F.when(_h(35, 37), 0).when(_h(38, 39), None).otherwise(F.col("fund_sk")).alias("fund_sk"),
        F.when(_h(40, 42), 0).when(_h(43, 44), None).otherwise(F.col("date_sk")).alias("extract_date_sk"),
        (F.col("monthly") != _h(60, 64)).alias("monthly_extract_indicator"),
        (F.col("weekly") != _h(65, 69)).alias("weekly_extract_indicator"),
        *[F.when(~_h(81, 86), _h(45 + i)).alias(name) for i, name in enumerate(GUARANTEE_FLAGS)],
    ]
    sign = F.when(_h(25, 29), -1).otherwise(1).cast("decimal(1,0)")
    signed = _dec(F.col("t_value") * sign, 18, 2)
    ours = rows.where(F.col("h") >= 5).select(
        F.lit(SOURCE_SYSTEM).alias("source_system"), *shared, signed.alias("market_value"), *keys
    )
    other = rows.where(F.col("l_partkey") % 50 == 0).select(
        F.lit(OTHER_SYSTEM).alias("source_system"),
        *shared,
        F.lit(0).cast("decimal(18,2)").alias("market_value"),
        *keys,
    )
    return ours.unionByName(other)


def fund_price(files: StarFiles) -> DataFrame:
    """One price per fund, company and day; some days have none."""
    quoted = (
        files.read("lineitem").select("l_partkey", "l_linestatus", "l_shipdate").distinct()
    )
    quoted = quoted.where((F.col("l_partkey") + F.day("l_shipdate")) % 53 != 0)
    # As one value, so whatever columns and filters the uses of a query have, save those on the date, prices are made
    # distinct and meet the parts once.
    priced = quoted.join(_parts(files), F.col("l_partkey") == F.col("p_partkey"))
    priced = priced.select("l_shipdate", F.inline(F.array(F.struct("l_partkey", "l_linestatus", "part_ticks"))))
    return priced.select(
        F.col("l_partkey").cast("string").alias("fund_code"),
        _company().alias("management_company_code"),
        _shift(F.col("l_shipdate")).alias("fund_price_date"),
        _ticks(_raw_ticks(), 12).alias("fund_price"),
        F.when(_foreign(), "U").otherwise("C").alias("fund_price_currency"),
    )


def usd_fx_rate(files: StarFiles) -> DataFrame:
    days = files.read("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return days.select(
        _shift(F.col("d")).alias("currency_exchange_date"),
        _rate(F.col("d")).alias("currency_exchange_rate"),
    )


def fund_position_daily(files: StarFiles) -> DataFrame:
    day = F.col("extract_date")
    rows = holdings(files)
    # As one value, so only few rows fewer don't give the line items shuffles of their own.
    rows = rows.select(*rows.drop("monthly").columns, F.inline(F.array(F.struct("monthly"))))
    return rows.where(~F.col("monthly")).select(
        F.col("account").alias("account_id"),
        F.col("company").alias("management_company_code"),
        "fund_code",
        F.col("units").alias("shares_owned_amount"),
        day.alias("effective_date"),
        F.col("last_valid").alias("end_date"),
    )


def fund_position_monthly(files: StarFiles) -> DataFrame:
    return (
        holdings(files)
        .where(F.col("monthly"))
        .select(
            F.col("account").alias("account_id"),
            F.col("company").alias("management_company_code"),
            "fund_code",
            F.concat(
                F.when(F.col("l_partkey") % 29 == 0, "?").otherwise(""), F.date_format("extract_date", "yyMMdd")
            ).alias("file_date"),
            F.col("units").alias("shares_owned_amount"),
        )
    )


def fund_account(files: StarFiles) -> DataFrame:
    """Two dealer periods per account and company; both hold on the day they share."""

    def period(company: str, dealer: Column, start: str, end: str) -> Column:
        return F.struct(
            F.lit(company).alias("management_company_code"),
            dealer.cast("string").alias("dealer_code"),
            F.lit(start).cast("date").alias("effective_date"),
            F.lit(end).cast("date").alias("end_date"),
        )

    nation = F.col("c_nationkey")
    periods = [
        p
        for company in ("MAX", "CGF")
        for p in (
            period(company, nation, "2000-01-01", "2022-06-30"),
            period(company, nation + 1, "2022-06-30", "2099-12-31"),
        )
    ]
    return (
        files.read("customer")
        .where(F.col("c_custkey") % 20 != 0)
        .select(F.col("c_custkey").cast("string").alias("account_id"), F.explode(F.array(*periods)).alias("p"))
        .select("account_id", "p.*")
    )


def transactions(files: StarFiles) -> DataFrame:
    """Transactions of line items; every fortieth has a mirrored leg of opposite sign, some have two.

    An investor has three accounts, and a mirrored leg is booked on another one than its transaction.
    """
    lines = _ordered_lines(
        files, "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"
    )
    number = F.col("l_orderkey") + F.col("l_linenumber")
    mirrored = F.col("leg") > 0
    factor = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    cents = (_dec("l_extendedprice", 18, 2) * 100).cast("bigint")
    count = F.col("l_quantity").cast("bigint")
    # Whole-number arithmetic: price in ten-thousandths, rounded half-up; every 200th is off by one cent.
    ticks = F.floor((cents * 100 + F.floor(count / 2)) / count) + F.when(number % 200 == 7, 100).otherwise(0)
    price = (ticks.cast("decimal(14,0)") * F.expr("0.0001BD")).cast("decimal(18,4)")
    fund = F.when(mirrored & (number % 80 == 0), F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    return (
        lines.withColumn(
            "leg",
            F.explode(
                F.when(number % 120 == 0, F.array(F.lit(0), F.lit(1), F.lit(2)))
                .when(number % 40 == 0, F.array(F.lit(0), F.lit(1)))
                .otherwise(F.array(F.lit(0)))
            ),
        )
        .select(
            F.col("o_custkey").alias("investor_id"),
            (F.col("o_custkey") * 10 + (F.col("l_orderkey") + F.col("leg")) % 3).alias("account_id"),
            _company().alias("company"),
            fund.alias("fund_code"),
            _shift(F.col("l_shipdate")).alias("trade_date"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_number"),
            "leg",
            F.when(number % 97 == 5, "X").otherwise(F.col("l_returnflag")).alias("trx_code"),
            F.when(mirrored, -factor).otherwise(factor).alias("unit_factor"),
            F.when(F.col("l_returnflag") == "A", "IN").otherwise("OUT").alias("direction"),
            _dec("l_quantity", 18, 4).alias("units"),
            price.alias("price"),
            _dec("l_extendedprice", 18, 2).alias("gross"),
            element_of_status(F.col("l_partkey")).alias("status_code"),
        )
    )


def element_of_status(number: Column) -> Column:
    """Status of a fund: the number of a nation or, for some, a code that the dimension doesn't have."""
    return F.when(number % 101 == 0, -1).otherwise(number % 25).cast("int")


def fund_status(files: StarFiles) -> DataFrame:
    """The status dimension: one row for each nation."""
    name = F.col("n_name")
    return files.read("nation").select(
        F.col("n_nationkey").cast("int").alias("status_code"),
        F.substring(name, 1, 5).alias("status_mnemonic"),
        F.lower(name).alias("status_description"),
        F.when(F.col("n_regionkey") % 2 == 0, "Y").otherwise("N").alias("allows_order_entry"),
    )


def trx_type(files: StarFiles) -> DataFrame:
    """The transaction-type dimension, from the return flags that line items have."""
    code = F.col("l_returnflag")
    out = code == "R"
    return files.read("lineitem").select(code).distinct().select(
        code.alias("trx_code"),
        F.concat(F.lit("type "), F.lower(code)).alias("trx_description"),
        F.when(out, "O").otherwise("I").alias("flow_code"),
        F.when(out, -1).otherwise(1).alias("type_factor"),
    )


def star_tables(spark: SparkSession, root: str) -> TableSet:
    """All logical tables over the Parquet files in ``root``."""
    names = {
        "wealth_assets": wealth_assets,
        "asset_reference": asset_reference,
        "fund_price": fund_price,
        "usd_fx_rate": usd_fx_rate,
        "fund_position_daily": fund_position_daily,
        "fund_position_monthly": fund_position_monthly,
        "fund_account": fund_account,
        "trx": transactions,
        "fund_status": fund_status,
        "trx_type": trx_type,
    }
    files = StarFiles(spark, root)
    return TableSet.from_builders({name: (lambda make=make: make(files)) for name, make in names.items()})
