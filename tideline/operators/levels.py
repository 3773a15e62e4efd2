"""Attributing user levels to days: latest within a look-back, and period-to-date best."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import half_month_start


def daily_level(log: DataFrame, user: str, ts: str, level: str) -> DataFrame:
    """Highest level per user and day."""
    return log.groupBy(F.to_date(ts).alias("dt"), user).agg(F.max(level).alias("level"))


def with_levels(days: DataFrame, user: str, lookback: int | None = None) -> DataFrame:
    """Add both level attributions to a merged user-day log.

    ``days`` holds one row per user-day, level days included, with a nullable ``level``:

    Levels are integers from 0 up, and rows with a level have a user (callers see to that, as
    a NULL user matches no other):

    * ``asof_level`` / ``asof_level_dt``: the latest level on or before the day, NULL when
      it is more than ``lookback`` days old;
    * ``period_level``: the best level from the start of the day's half-month up to the
      day.

    Both are running values of one window (same keys, same order), each row costing
    O(1): levels and activity meet in a sort of the user's own days instead of a range
    join. A user has one row per day, so no task sees more than the days of the range.
    """
    so_far = Window.partitionBy(user).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    level, day = F.col("level"), F.col("dt")
    has_level = level.isNotNull()
    period = half_month_start(day)
    # A later half-month outranks any level of an earlier one, so the maximum of the pair
    # is the best level of the newest half-month with one. Packed into one number: a
    # running maximum of plain numbers is far cheaper than one of structs.
    rank = F.shiftleft(F.unix_date(period).cast("bigint"), 32) + level
    seen = days.withColumns(
        {
            "_level": F.last(level, ignorenulls=True).over(so_far),
            "_level_dt": F.last(F.when(has_level, day), ignorenulls=True).over(so_far),
            "_best": F.max(rank).over(so_far),
        }
    )
    fresh = F.col("_level").isNotNull()
    if lookback is not None:
        fresh = fresh & (F.datediff(day, F.col("_level_dt")) <= lookback)
    best_now = F.col("_best") - F.shiftleft(F.unix_date(period).cast("bigint"), 32)
    return seen.withColumns(
        {
            "asof_level": F.when(fresh, F.col("_level")),
            "asof_level_dt": F.when(fresh, F.col("_level_dt")),
            "period_level": F.when(best_now >= 0, best_now.cast("int")),
        }
    ).drop("_level", "_level_dt", "_best")


def asof_level(activity: DataFrame, levels: DataFrame, user: str, lookback: int = 30) -> DataFrame:
    """Latest level of each active user-day within ``lookback`` days, else 0."""
    joined = _log(activity, levels, user)
    return (
        with_levels(joined, user, lookback)
        .where("_active")
        .select("dt", user, F.coalesce("asof_level", F.lit(0)).alias("level"))
    )


def period_to_date_level(activity: DataFrame, levels: DataFrame, user: str) -> DataFrame:
    """Best level of each active user-day in its half-month so far; NULL without one."""
    joined = _log(activity, levels, user)
    return with_levels(joined, user).where("_active").select("dt", user, F.col("period_level").alias("level"))


def _log(activity: DataFrame, levels: DataFrame, user: str) -> DataFrame:
    both = activity.select("dt", user, F.lit(True).alias("_active")).unionByName(
        levels.where(F.col(user).isNotNull()).select("dt", user, "level"), allowMissingColumns=True
    )
    return both.groupBy("dt", user).agg(
        F.coalesce(F.bool_or("_active"), F.lit(False)).alias("_active"), F.max("level").alias("level")
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The row with the highest ``order`` per key, as an aggregate that combines map-side
    (no sort of the group). Ties go to the greatest remaining columns."""
    best = F.max(F.struct(order, *columns)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, f"_best.{order}", *[f"_best.{c}" for c in columns])
