"""Date arithmetic shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_month_start(day: Column) -> Column:
    """First day of the half-month ``day`` lies in: the 1st up to the 15th, else the 16th."""
    month = F.trunc(day, "month")
    return F.when(F.dayofmonth(day) <= 15, month).otherwise(F.date_add(month, 15))


def day_index(signup: Column, day: Column) -> Column:
    """Whole days from sign-up to ``day``; NULL when the sign-up day is unknown."""
    return F.datediff(day, signup)


def in_days(column: Column, first, last) -> Column:
    """Whole days ``first..last`` as a half-open range on a timestamp (or date) column.

    The column itself stays bare, so the bound reaches the parquet reader.
    """
    return (column >= F.lit(first)) & (column < F.date_add(F.lit(last), 1))
