"""Stickiness: daily actives against rolling weekly and monthly actives, per region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.buckets import home_region
from tideline.functions.dates import in_days
from tideline.functions.numbers import round_ratio
from tideline.operators.actives import rolling_distinct
from tideline.operators.joins import attach_user_dim
from tideline.operators.series import baseline_pack, comparison_pack, to_long
from tideline.plans.kpi import Sources
from tideline.plans.runs import Runs


def stickiness_region(spark: SparkSession, src: Sources, runs: Runs) -> DataFrame:
    days = src["daily_user_activities"].where(in_days(F.col("dt"), runs.back(60), runs.last_report))
    active = days.select("dt", "user_id", home_region(F.col("country_code")).alias("region"))
    return _stickiness(spark, active, "user_id", runs)


def stickiness_locale(spark: SparkSession, src: Sources, runs: Runs) -> DataFrame:
    days = src["dailyactives"].where(in_days(F.col("day"), runs.back(60), runs.last_report))
    user_days = days.select(F.col("day").cast("date").alias("dt"), "userid").distinct()
    active = attach_user_dim(user_days, src["users_data"], "userid")
    return _stickiness(spark, active.select("dt", "userid", "region"), "userid", runs)


def _stickiness(spark, active: DataFrame, user: str, runs: Runs) -> DataFrame:
    first = runs.back(31)
    wide = rolling_distinct(spark, active, first, runs.last_report, ["region"], user)
    dau = F.col("active_1d")
    metrics = {
        "dau/rolling_wau": round_ratio(dau, F.col("active_7d"), 2),
        "dau/rolling_mau": round_ratio(dau, F.col("active_30d"), 2),
        "rolling_7d_wau": F.col("active_7d"),
        "rolling_30d_mau": F.col("active_30d"),
    }
    # A region may be absent for days, so frames must stop at each run's own axis.
    per_run = runs.per_run(wide, back=31)
    long = to_long(per_run, ["run_date", "dt", "region"], metrics)
    packed = baseline_pack(long, ["run_date", "region"], scale=4)
    return runs.on_report_day(comparison_pack(packed))
