"""Transactions around month end: window, ranks, signs, balances, transfer legs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.compare import beyond
from plumbline.operators.ordered import add_offsets, all_columns, chunk_offsets, cut_groups, group_cuts, rank_dates, running_total

BALANCE_TOLERANCE = Decimal("0.0011")
BALANCE_KEYS = ["account_id", "fund_code"]
BALANCE_ORDER = ["trade_date", "order_id", "line_number", "leg", "gross", "units", "unit_factor"]


def month_end_window(trx: DataFrame, days: int = 10) -> DataFrame:
    """Transactions within ``days`` of a month end, with ``month_end`` and ``window_side``.

    PRE is up to and including the month end, POST is after it. Month ends are computed
    from the trade date, so nothing is joined or shuffled. With a wide window a
    transaction may belong to more than one month end and is then listed for each.
    """
    day = F.col("trade_date")
    months = F.sequence(
        F.trunc(F.date_sub(day, days), "month"), F.trunc(F.date_add(day, days), "month"), F.expr("interval 1 month")
    )
    offset = F.datediff(day, F.col("month_end"))
    return (
        trx.withColumn("month_end", F.explode(F.transform(months, F.last_day)))
        .where(F.abs(offset) <= days)
        .withColumn("window_side", F.when(offset <= 0, "PRE").otherwise("POST"))
    )


def business_day_rank(windowed: DataFrame) -> DataFrame:
    """Rank of the trade date by distance from the month end, over the dates on which trades occur."""
    distance = F.abs(F.datediff("trade_date", "month_end"))
    return rank_dates(windowed, ["month_end", "window_side"], "trade_date", distance, "biz_day_rank")


def signed_gross(trx: DataFrame) -> DataFrame:
    """Gross amount as seen from the account: positive for IN, negative for OUT."""
    signed = F.when(F.col("direction") == "IN", F.col("gross")).otherwise(-F.col("gross"))
    return trx.withColumn("signed_gross", signed.cast("decimal(18,2)"))


def add_status(trx: DataFrame, statuses: DataFrame) -> DataFrame:
    """Status code -> mnemonic, description, order-entry flag. Unknown codes stay, with nulls."""
    return trx.join(statuses, "status_code", "left")


def add_type(trx: DataFrame, types: DataFrame) -> DataFrame:
    """Transaction code -> description, flow and unit factor of its type. Unknown codes drop out: see ``untyped``."""
    return trx.join(types, "trx_code")


def untyped(trx: DataFrame, types: DataFrame) -> DataFrame:
    """Transactions that ``add_type`` loses, counted by their code: the dimension doesn't have it, or it is null."""
    return trx.join(types.select("trx_code"), "trx_code", "left_anti").groupBy("trx_code").agg(
        F.count(F.lit(1)).alias("trx_count")
    )


def month_end_report(trx: DataFrame, statuses: DataFrame, days: int = 10) -> DataFrame:
    """The month-end extract: window, rank, signed amount and status, PRE before POST."""
    rows = add_status(signed_gross(business_day_rank(month_end_window(trx, days))), statuses)
    pre_first = F.when(F.col("window_side") == "PRE", 0).otherwise(1)
    # Account and order close the sort key, so a busy fund and day is no single sort range.
    return rows.orderBy("month_end", pre_first, "trade_date", "company", "fund_code", "account_id", "order_id")


def month_end_totals(trx: DataFrame, days: int = 10) -> DataFrame:
    """Signed gross per month end, side and fund."""
    return (
        signed_gross(month_end_window(trx, days))
        .groupBy("month_end", "window_side", "fund_code")
        .agg(
            F.count(F.lit(1)).alias("trx_count"),
            F.sum("signed_gross").cast("decimal(28,2)").alias("signed_gross"),
        )
    )


def running_balance(trx: DataFrame, parts: int | None = None) -> DataFrame:
    """Open and close unit balance of every transaction, per account and fund from zero.

    The unit factor gives the sign, as the reported direction does not tell it. An account and fund with more than about
    one part in ``parts`` of all transactions is spread over several tasks.
    """
    moved = (F.col("units") * F.col("unit_factor")).cast("decimal(28,4)")
    closed = running_total(trx, BALANCE_KEYS, BALANCE_ORDER, moved, "close_balance", parts)
    kind = "decimal(28,4)"
    return closed.withColumns(
        {
            "open_balance": (F.col("close_balance") - moved).cast(kind),
            "close_balance": F.col("close_balance").cast(kind),
        }
    )


def roll_forward_gap() -> Column:
    return F.col("open_balance") + F.col("units") * F.col("unit_factor") - F.col("close_balance")


def roll_forward_exceptions(trx: DataFrame, tolerance: Decimal = BALANCE_TOLERANCE) -> DataFrame:
    """Rows whose close balance is not open balance plus signed units."""
    return trx.where(F.abs(roll_forward_gap()) > F.lit(tolerance)).withColumn(
        "gap", roll_forward_gap().cast("decimal(28,4)")
    )


def gross_exceptions(trx: DataFrame, tolerance: Decimal = Decimal("0.01")) -> DataFrame:
    """Rows whose gross amount is not price times units."""
    value = F.col("price") * F.col("units")
    return trx.where(beyond(F.col("gross"), value, tolerance)).withColumn(
        "variance", F.abs(F.col("gross") - value).cast("decimal(28,8)")
    )


def direction_exceptions(trx: DataFrame) -> DataFrame:
    """Rows whose reported direction disagrees with the movement of the balance; no movement is no hit."""
    moved = F.col("close_balance") - F.col("open_balance")
    by_balance = F.when(moved > 0, "IN").when(moved < 0, "OUT")
    return trx.withColumn("balance_direction", by_balance).where(F.col("direction") != F.col("balance_direction"))


# --- transfer legs --------------------------------------------------------------------------

TRANSFER_KEYS = ["investor_id", "gross", "trade_date"]
# Legs of one side of a group in order; a leg beyond the other side's number stays unmatched.
LEG_ORDER = ["order_id", "line_number", "leg", "account_id", "fund_code", "company", "units", "price"]


def _leaves() -> Column:
    return F.col("unit_factor") < 0


def _legs(trx: DataFrame, *more: Column) -> DataFrame:
    return trx.groupBy(*TRANSFER_KEYS).agg(
        F.count_if(_leaves()).alias("out_legs"), F.count_if(~_leaves()).alias("in_legs"), *more
    )


def transfer_pairs(trx: DataFrame) -> DataFrame:
    """Groups that hold both an outgoing and an incoming leg of the same investor, amount and day.

    An investor may hold several accounts, and the legs of a transfer lie in any of them. Legs are counted per group,
    never paired with each other, so the result has one row per group. ``cross_fund`` tells that the two sides name
    different funds.
    """

    def funds(side: Column, name: str) -> list[Column]:
        fund = F.when(side, F.col("fund_code"))
        return [F.min(fund).alias(f"{name}_first_fund"), F.max(fund).alias(f"{name}_last_fund")]

    groups = _legs(trx, *funds(_leaves(), "out"), *funds(~_leaves(), "in"))
    cross = (F.col("out_first_fund") != F.col("in_first_fund")) | (F.col("out_last_fund") != F.col("in_last_fund"))
    return groups.where((F.col("out_legs") > 0) & (F.col("in_legs") > 0)).select(
        *TRANSFER_KEYS,
        "out_legs",
        "in_legs",
        F.least("out_legs", "in_legs").alias("matched_legs"),
        cross.alias("cross_fund"),
    )


def transfer_unmatched(trx: DataFrame, parts: int | None = None) -> DataFrame:
    """Legs without a partner: of the legs of one side of a group, those beyond the number on the other side.

    Each side of a group is numbered in order. A group with more than about one part in ``parts`` of all legs, as that of
    an omnibus investor or of all legs without one, is numbered in ranges of its order, with what the earlier ranges hold
    added; its legs are counted by range, too. A leg without a unit factor counts as incoming.
    """
    cuts = group_cuts(trx, TRANSFER_KEYS, LEG_ORDER, parts)
    leaves = F.coalesce(_leaves(), F.lit(False))
    out, into = F.when(leaves, 1).otherwise(0), F.when(leaves, 0).otherwise(1)
    chunked = cut_groups(trx, cuts, TRANSFER_KEYS, LEG_ORDER, parts)
    offsets = chunk_offsets(chunked, TRANSFER_KEYS, out=out, into=into)
    # One order for all three, so a chunk is sorted once.
    side = Window.partitionBy(*TRANSFER_KEYS, "_chunk").orderBy("_out", *LEG_ORDER)
    whole = side.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = all_columns(
        chunked.withColumn("_out", leaves).withColumns(
            {"_row": F.row_number().over(side), "_outs": F.sum(out).over(whole), "_intos": F.sum(into).over(whole)}
        )
    ).withColumn("_place", F.col("_row") - F.when(F.col("_out"), F.col("_intos")).otherwise(0))
    placed = add_offsets(numbered, offsets, TRANSFER_KEYS)
    before = F.when(F.col("_out"), F.col("_before_out")).otherwise(F.col("_before_into"))
    other = F.when(F.col("_out"), F.coalesce("_all_into", "_intos")).otherwise(F.coalesce("_all_out", "_outs"))
    return placed.where(F.col("_place") + F.coalesce(before, F.lit(0)) > other).select(*trx.columns)
