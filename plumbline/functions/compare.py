"""Predicates that compare two sides of a reconciliation. All return Columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def beyond(left: Column, right: Column, tolerance) -> Column:
    """Absolute difference strictly above ``tolerance``; null on either side is no hit."""
    return F.abs(left - right) > F.lit(tolerance)


def _ratio(numerator: Column, divisor: Column) -> Column:
    # Totals are decimal(38, s): their quotient as a decimal keeps six digits only.
    return numerator.cast("double") / F.nullif(divisor.cast("double"), F.lit(0.0))


def gap_ratio(left: Column, right: Column) -> Column:
    """``|left - right| / right``: the sign of ``right`` stays, so a negative total never exceeds a limit."""
    return _ratio(F.abs(left - right), right)


def gap_ratio_safe(left: Column, right: Column) -> Column:
    """``|(left - right) / right|``: also right for negative totals."""
    return F.abs(_ratio(left - right, right))


def signed_ratio(left: Column, right: Column) -> Column:
    return _ratio(left - right, right)


def percent(ratio: Column, digits: int) -> Column:
    """Ratio as a rounded percentage, without negative zero."""
    return F.round(ratio * 100, digits) + F.lit(0.0)


def differs(left: Column, right: Column) -> Column:
    """Null on either side is no hit."""
    return left != right


def differs_or_left_null(left: Column, right: Column) -> Column:
    return (left != right) | left.isNull()


def differs_null_safe(left: Column, right: Column) -> Column:
    """Null against a value is a hit, null against null is not."""
    return ~left.eqNullSafe(right)


def unresolved_key(key: Column) -> Column:
    """Surrogate key that found no dimension row: 0 or null."""
    return (key == 0) | key.isNull()


def any_flag(names: Iterable[str]) -> Column:
    """TRUE if at least one flag is TRUE; a null flag counts as not set."""
    return reduce(or_, [F.coalesce(F.col(n), F.lit(False)) for n in names])


def status_ladder(gap: Column, match_limit: float, investigate_limit: float, last: str = "MISMATCH") -> Column:
    """MATCH / INVESTIGATE / ``last``; a null gap falls through to ``last``."""
    size = F.abs(gap)
    return (
        F.when(size <= match_limit, "MATCH").when(size <= investigate_limit, "INVESTIGATE").otherwise(last)
    )


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def money(value: Column, digits: int = 2) -> Column:
    """Rounded half-up and given a type that does not depend on the inputs."""
    return F.round(value, digits).cast(f"decimal(28,{digits})")
