"""Dense daily axes and the joins that hang source aggregates on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def calendar(spark: SparkSession, first: date, last: date, name: str = "dt") -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(F.lit(first), F.lit(last))
    return spark.range(0, 1, 1, 1).select(F.explode(days).alias(name))


def dimension_spine(dims: DataFrame, first: date, last: date, name: str = "dt") -> DataFrame:
    """Every observed dimension tuple on every day. ``dims`` holds one row per tuple."""
    days = F.sequence(F.lit(first), F.lit(last))
    return dims.select(F.explode(days).alias(name), *dims.columns)


def on_spine(
    spine: DataFrame,
    daily: DataFrame,
    keys: Sequence[str] = ("dt",),
    fill: Mapping[str, object] | None = None,
    available: str | None = None,
) -> DataFrame:
    """Left join ``daily`` (unique on ``keys``) to the spine.

    ``fill`` names the columns whose gaps become a value; all others keep NULL, so later
    averages skip them. ``available`` adds a 1/0 column telling whether a row was there.
    Joined on days alone, ``daily`` has one row per day of the axis, a size bounded by
    the axis, and is broadcast. With more keys Spark picks the side by its real size.
    """
    if available:
        daily = daily.withColumn(available, F.lit(1))
    side = F.broadcast(daily) if list(keys) == ["dt"] else daily
    joined = spine.join(side, list(keys), "left")
    if available:
        joined = joined.withColumn(available, F.coalesce(available, F.lit(0)))
    if fill:
        types = {f.name: f.dataType for f in joined.schema.fields}
        joined = joined.withColumns(
            {c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in fill.items()}
        )
    return joined


def fill_gaps(
    daily: DataFrame, first: date, last: date, dims: Sequence[str], fill: Mapping[str, object],
    available: str | None = None, name: str = "dt",
) -> DataFrame:
    """Same rows as ``on_spine(dimension_spine(observed dims), daily)``, reading ``daily`` once.

    ``daily`` has one row per day and dims tuple. Each row stretches to the tuple's next
    one (the first also back to the start of the axis), holding its measures on its own
    day and ``fill`` on the others.
    """
    series = Window.partitionBy(*dims).orderBy(name)
    lo = F.when(F.lag(name).over(series).isNull(), F.lit(first)).otherwise(F.col(name))
    hi = F.coalesce(F.date_sub(F.lead(name).over(series), 1), F.lit(last))
    days = daily.withColumns({"_days": F.sequence(lo, hi), "_own": F.col(name)})
    spread = days.withColumn(name, F.explode("_days"))
    own = F.col(name) == F.col("_own")
    types = {f.name: f.dataType for f in daily.schema.fields}
    filled = {
        c: F.coalesce(F.when(own, F.col(c)), F.lit(v).cast(types[c])) for c, v in fill.items()
    }
    if available:
        filled[available] = F.when(own, 1).otherwise(0)
    return spread.withColumns(filled).select(
        name, *dims, *[c for c in daily.columns if c != name and c not in dims],
        *([available] if available else []),
    )


def available_only_if(*flags: str) -> Column:
    """1 when every flag is 1: a total is complete only if all its parts are."""
    return F.least(*[F.col(f) for f in flags]) if len(flags) > 1 else F.col(flags[0])


def shift_date(df: DataFrame, days: int, name: str = "dt") -> DataFrame:
    """Book a source's day ``days`` later."""
    return df.withColumn(name, F.date_add(F.col(name), days))


def calendar_of(df: DataFrame, day: str, name: str = "dt") -> DataFrame:
    """Dense calendar from the first to the last day found in ``df``."""
    bounds = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return bounds.select(F.explode(F.sequence("a", "b")).alias(name))
