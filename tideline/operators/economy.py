"""Virtual-currency economy: trailing ratios over trading days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numbers import ratio


def ratio_of_sums(
    daily: DataFrame, numerator: str, denominator: str, spans: Sequence[int],
    keys: Sequence[str] = (), name: str = "ratio_{}",
) -> DataFrame:
    """Ratio of two trailing sums over the last ``n`` rows, current one included.

    Rows, not days: a day without trade has no row and is skipped. ``daily`` is already
    one row per key and day, so the window sorts days, never raw facts; without keys a
    constant one stands in and the single partition holds one row per day.
    """
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("dt")
    return daily.withColumns(
        {
            name.format(n): ratio(
                F.sum(numerator).over(order.rowsBetween(1 - n, 0)),
                F.sum(denominator).over(order.rowsBetween(1 - n, 0)),
            )
            for n in spans
        }
    )


def sold_per_day(sales: DataFrame, products: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Daily money and currency sold, without the excluded product names.

    Sales of an unknown or unnamed product drop out as well: NULL is neither in nor
    outside a list. Sales fold to day and product before the join, so a product with a
    third of all rows is a handful of rows when it meets the product table.
    """
    per_product = sales.groupBy("dt", "productid").agg(
        F.sum("amountdollars").alias("dollars"), F.sum("amountbars").alias("bars")
    )
    named = products.where(~F.col("name").isin(*excluded)).select(F.col("id").alias("productid"))
    return (
        per_product.join(named, "productid")
        .groupBy("dt")
        .agg(F.sum("dollars").alias("dollars"), F.sum("bars").alias("bars"))
    )
