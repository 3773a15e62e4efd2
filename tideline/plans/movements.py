"""Lifecycle counts and revenue movements per day, by region or by region and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.buckets import home_region, level_tier
from tideline.functions.dates import day_index, in_days
from tideline.operators.aggregates import merge_user_days
from tideline.operators.joins import attach_user_dim
from tideline.operators.levels import with_levels
from tideline.operators.lifecycle import STATES
from tideline.operators.movements import daily_movements, seen_by_run
from tideline.operators.revenue import per_day
from tideline.plans.kpi import Sources, settled_sales
from tideline.plans.runs import Runs
from tideline.plans.slices import USER_DAY, level_rows

COUNTS = [f"traffic_{s}" for s in STATES]


def lifecycle_mrr_region(spark: SparkSession, src: Sources, runs: Runs) -> DataFrame:
    first, last = runs.back(7), runs.last_report
    can = F.coalesce(F.col("can_purchasing_dim.revenue"), F.lit(0))
    sub = F.coalesce(F.col("sub_purchasing_dim.revenue"), F.lit(0))
    pays = (can > 0) | (sub > 0)
    days = (
        src["daily_user_activities"]
        .where(in_days(F.col("dt"), runs.back(67), last))
        .groupBy("user_id", "dt", home_region(F.col("country_code"), "Others").alias("region"), "day_index")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.when(pays, can)).cast("decimal(18,2)").alias("can"),
            F.sum(F.when(pays, sub)).cast("decimal(18,2)").alias("sub"),
        )
    )
    streams = {"sub_revenue": "sub", "can_revenue": "can"}
    daily = daily_movements(
        days, first, last, ["region"], "user_id", streams, axis=7, history=67, rows="n_rows"
    ).where((F.col("n_events") > 0) | (F.col("cover") > 0))
    return _shown(runs.per_run(daily, back=7), ["region"], list(streams))


def lifecycle_mrr_tier(spark: SparkSession, src: Sources, runs: Runs) -> DataFrame:
    first, last, history = runs.back(8), runs.last_report, runs.back(68)
    active = (
        src["dailyactives"]
        .where(in_days(F.col("day"), history, last))
        .select(F.col("day").cast("date").alias("dt"), "userid", F.lit(True).alias("active"))
    )
    log = merge_user_days(
        [
            active,
            settled_sales(src, history, last),
            level_rows(src, history.replace(day=1), last),
        ],
        USER_DAY,
        {"active": F.bool_or("active"), "rev": F.sum("rev"), "level": F.max("level")},
    )
    tiered = with_levels(log, "userid").where(F.col("active") | F.col("rev").isNotNull())
    days = attach_user_dim(
        tiered.select(*USER_DAY, "active", "rev", level_tier(F.col("period_level")).alias("tier")),
        src["users_data"],
        "userid",
    ).withColumn("day_index", day_index(F.col("signup_dt"), F.col("dt")))
    paid = days.withColumn("rev", F.col("rev").cast("decimal(18,2)"))
    daily = runs.per_run(
        daily_movements(
            paid, first, last, ["tier", "region"], "userid", {"revenue": "rev"},
            axis=8, history=68, active="active",
        ),
        back=8,
    )
    # A run shows every tuple it saw within its history, on all of its days.
    within_run = Window.partitionBy("run_date", "tier", "region")
    known = F.max("last_seen").over(within_run) >= F.date_sub("run_date", 68)
    daily = daily.withColumn("_known", known).where("_known")
    return _shown(daily, ["tier", "region"], ["revenue"])


def _shown(daily: DataFrame, dims: list[str], streams: list[str]) -> DataFrame:
    keys = ["run_date", "dt", *dims, *COUNTS]
    return per_day(seen_by_run(daily), keys, streams)
