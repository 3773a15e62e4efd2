"""Ratios and rounding that give the same digits on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
METRIC = "decimal(38,4)"
EXACT = "decimal(24,4)"


def round_half_away(value: Column, digits: int) -> Column:
    """Round half away from zero in double arithmetic, for values that have no exact decimal.

    A quotient of exact numbers belongs in ``round_ratio``: a decimal tie may lie below its
    binary image. Spark's ``round`` works on the decimal rendering of a double, other engines on
    the scaled binary value; spelling the steps out removes the difference. The
    final ``+ 0.0`` turns a negative zero into a plain zero.
    """
    scale = F.lit(float(10**digits))
    x = value.cast("double")
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / scale + F.lit(0.0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, NULL when the denominator is 0 or NULL."""
    den = denominator.cast("double")
    return numerator.cast("double") / F.nullif(den, F.lit(0.0))


def round_ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """``numerator / denominator`` rounded half away from zero, exactly.

    Both are numbers of at most four decimals. The quotient is rounded in whole numbers,
    ``(2 |n| 10^digits + |d|) div (2 |d|)``, and is a double only to be shown. NULL when the
    denominator is 0 or NULL.
    """
    n, d = numerator.try_cast(EXACT), F.nullif(denominator.try_cast(EXACT), F.lit(0).cast(EXACT))
    steps = F.call_function("div", F.abs(n) * F.lit(2 * 10**digits) + F.abs(d), F.abs(d) * F.lit(2))
    return F.signum(n) * F.signum(d) * steps.cast("double") / F.lit(float(10**digits)) + F.lit(0.0)


def pct_change(value: Column, base: Column, digits: int = 2) -> Column:
    """Percentage change of ``value`` against ``base``, exact for numbers of at most four
    decimals; NULL without a usable base."""
    return round_ratio((value.try_cast(EXACT) - base.try_cast(EXACT)) * F.lit(100), base, digits)
