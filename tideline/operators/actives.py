"""Rolling distinct users without counting anyone twice and without a range join."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.spine import calendar


def rolling_distinct(
    spark: SparkSession,
    active: DataFrame,
    first: date,
    last: date,
    dims: Sequence[str],
    user: str,
    windows: Sequence[int] = (1, 7, 30),
) -> DataFrame:
    """Distinct users active in the last ``w`` days, for each day, dims and window.

    Columns ``dt, *dims, active_<w>d``. A dims tuple shows up on a day only if it had a
    user within the longest window; a day without any user at all gives a single row
    with NULL dims and zero counts.

    An active day keeps its user "in the window" until the window runs out or the
    user's next active day takes over, whichever comes first. Those stretches never
    overlap, so a distinct count is just the number of stretches covering a day:
    +1 where one starts, -1 where it ends, and a running total. Two rows per user-day
    replace the ``w`` rows of a range join, and they fold to (day, dims) before the
    last shuffle.
    """
    dims = list(dims)
    longest = max(windows)
    history = active.where(
        F.col("dt").between(F.lit(first - timedelta(days=longest - 1)), F.lit(last))
        & F.col(user).isNotNull()
    )
    days = history.select(*dims, user, "dt").distinct()
    per_user = Window.partitionBy(*dims, user).orderBy("dt")
    days = days.withColumn("_next", F.lead("dt").over(per_user))

    def step(day, signs: dict[int, int]):
        return F.struct(day.alias("_day"), *[F.lit(signs.get(w, 0)).alias(f"_d{w}") for w in windows])

    starts = step(F.col("dt"), {w: 1 for w in windows})
    ends = [step(F.least(F.date_add("dt", w), F.col("_next")), {w: -1}) for w in windows]
    changes = (
        days.select(*dims, F.inline(F.array(starts, *ends)))
        .groupBy(*dims, "_day")
        .agg(*[F.sum(f"_d{w}").alias(f"_d{w}") for w in windows])
    )
    return _running_daily(spark, changes, first, last, dims, {f"_d{w}": f"active_{w}d" for w in windows},
                          present=f"active_{longest}d")


def _running_daily(spark, changes, first, last, dims, names, present):
    per_dim = Window.partitionBy(*dims).orderBy("_day")
    so_far = per_dim.rowsBetween(Window.unboundedPreceding, 0)
    levels = changes.select(
        *dims,
        "_day",
        F.coalesce(F.lead("_day").over(per_dim), F.lit(last + timedelta(days=1))).alias("_until"),
        *[F.sum(d).over(so_far).alias(n) for d, n in names.items()],
    )
    daily = on_days(levels, first, last).where(F.col(present) > 0)
    axis = calendar(spark, first, last)
    # One row per day and dims tuple: the left side is the axis, kept whole.
    joined = axis.join(daily, "dt", "left")
    return joined.select(
        "dt", *dims, *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names.values()]
    )


def on_days(steps: DataFrame, first: date, last: date) -> DataFrame:
    """Spell a step function out: one row per day of ``[_day, _until)`` within the axis."""
    lo = F.greatest(F.col("_day"), F.lit(first))
    hi = F.least(F.date_sub("_until", 1), F.lit(last))
    rest = [c for c in steps.columns if c not in ("_day", "_until")]
    return steps.where(lo <= hi).select(F.explode(F.sequence(lo, hi)).alias("dt"), *rest)


def spread_forward(
    df: DataFrame, first: date, last: date, reach: int, name: str = "axis_dt"
) -> DataFrame:
    """Each row once for every axis day in ``[dt, dt + reach]``: a calendar range join
    turned into a row-local expansion, with no join and no shuffle."""
    lo = F.greatest(F.col("dt"), F.lit(first))
    hi = F.least(F.date_add("dt", reach), F.lit(last))
    return df.where(lo <= hi).withColumn(name, F.explode(F.sequence(lo, hi)))


def trailing_sums(
    daily: DataFrame, first: date, last: date, keys: Sequence[str], measures: Sequence[str], days: int
) -> DataFrame:
    """Sum of each measure over the last ``days`` days for every axis day.

    Rows fold to one per day and key before they are spread over the axis.
    """
    folded = daily.groupBy("dt", *keys).agg(*[F.sum(m).alias(m) for m in measures])
    spread = spread_forward(folded, first, last, days - 1)
    return spread.groupBy(F.col("axis_dt").alias("dt"), *keys).agg(
        *[F.sum(m).alias(m) for m in measures]
    )
