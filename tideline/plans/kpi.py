"""Headline KPI, streamer activity and currency economy reports on a shared dense axis."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.dates import in_days
from tideline.functions.numbers import METRIC, MONEY
from tideline.operators.aggregates import daily_distinct, hours, user_day
from tideline.operators.economy import ratio_of_sums, sold_per_day
from tideline.operators.series import baseline_pack, comparison_pack, to_long
from tideline.operators.spine import available_only_if, calendar, on_spine, shift_date
from tideline.plans.runs import Runs

Sources = Mapping[str, DataFrame]

# Settled transaction states, and give-aways that are not sales.
SETTLED = ("AUTHORIZED", "COMPLETED")
GIVE_AWAYS = ("Games Free Bars Reward", "Games Paid Bars Reward")


def settled_sales(src: Sources, first, last) -> DataFrame:
    """Settled paid transactions: ``dt, userid, rev``, one row per transaction.

    Not folded here. Whoever merges them with other logs folds everything at once, with
    map-side combining, for one shuffle instead of two.
    """
    return (
        src["store_transaction"]
        .where(
            in_days(F.col("datecreated"), first, last)
            & F.col("status").isin(*SETTLED)
            & (F.col("amountdollars") > 0)
        )
        .select(F.to_date("datecreated").alias("dt"), "userid", F.col("amountdollars").alias("rev"))
    )


def dense_series(spark, wide: DataFrame, runs: Runs, metrics, available=None) -> DataFrame:
    """Compare a dense series once; every run date is a slice of it.

    Valid because the axis has no holes and starts at least 31 days before the first
    report day: no frame of any run reaches past its own axis.
    """
    long = to_long(wide, ["dt"], metrics, available)
    return runs.stamp(comparison_pack(baseline_pack(long)))


def main_kpi_flat(spark: SparkSession, src: Sources, runs: Runs) -> DataFrame:
    first, last = runs.back(61), runs.last_report
    active = src["dailyactives"].where(in_days(F.col("day"), first, last))
    per_user = user_day(active, F.col("day").cast("date"), "userid", {"bars": F.sum("bars_spent")})
    activity = per_user.groupBy("dt").agg(
        F.count("userid").alias("dau"),
        F.count(F.when(F.col("bars") > 0, F.col("userid"))).alias("spenders"),
    )
    sales = settled_sales(src, first, last)
    revenue = daily_distinct(sales, ["dt"], "userid", {"payers": F.lit(True)}, {"rev": F.col("rev")})
    axis = calendar(spark, first, last)
    wide = on_spine(axis, activity, fill={"dau": 0, "spenders": 0}, available="activity_available")
    wide = on_spine(wide, revenue, fill={"payers": 0, "rev": 0})
    metrics = ["dau", "payers", "spenders", "rev"]
    return dense_series(spark, wide, runs, metrics, {m: "activity_available" for m in metrics})


def main_kpi_nested(spark: SparkSession, src: Sources, runs: Runs) -> DataFrame:
    first, last = runs.back(60), runs.last_report
    can, sub = F.col("can_purchasing_dim"), F.col("sub_purchasing_dim")
    activity = daily_distinct(
        src["daily_user_activities"].where(in_days(F.col("dt"), first, last)),
        ["dt"],
        "user_id",
        {
            "dau": F.lit(True),
            "payers": can.isNotNull() | sub.isNotNull(),
            "matchers": F.col("matching_dim").isNotNull(),
            "audiences": F.col("audience_dim").isNotNull(),
        },
        {"sub_revenue": sub["revenue"], "can_revenue": can["revenue"]},
    )
    # Advertising revenue is reported a day late, on the day after it was earned.
    ads = shift_date(
        src["admob_revenue"]
        .where(in_days(F.col("dt"), first, last))
        .groupBy("dt")
        .agg(F.sum("gross_revenue").alias("admob_revenue")),
        1,
    )
    counts = ["dau", "payers", "matchers", "audiences"]
    zeros = {c: 0 for c in [*counts, "sub_revenue", "can_revenue"]}
    wide = on_spine(calendar(spark, first, last), activity, fill=zeros, available="activity_available")
    wide = on_spine(wide, ads, fill={"admob_revenue": 0}, available="admob_available")
    wide = wide.withColumns(
        {
            "total_revenue": (
                F.col("sub_revenue") + F.col("can_revenue") + F.col("admob_revenue")
            ).cast(MONEY),
            "all_available": available_only_if("activity_available", "admob_available"),
        }
    )
    available = {m: "activity_available" for m in [*counts, "sub_revenue", "can_revenue"]}
    available |= {"admob_revenue": "admob_available", "total_revenue": "all_available"}
    return dense_series(spark, wide, runs, {m: m for m in available}, available)


def streamer_activity(spark: SparkSession, src: Sources, runs: Runs) -> DataFrame:
    first, last = runs.back(60), runs.last_report
    video = F.coalesce(F.col("is_video"), F.lit(False))
    voice = F.coalesce(~F.col("is_video"), F.lit(False))
    zero = F.lit(0).cast(MONEY)
    streams = (
        src["streaming"]
        .where(in_days(F.col("start_time"), first, last))
        .withColumn("dt", F.to_date("start_time"))
    )
    daily = daily_distinct(
        streams,
        ["dt"],
        "user_id",
        {"video_das": video, "voice_das": voice},
        {
            "video_seconds": F.when(video, F.col("duration")).otherwise(zero),
            "voice_seconds": F.when(voice, F.col("duration")).otherwise(zero),
        },
    )
    # No fill: a day without streams has no value, and averages leave it out.
    wide = on_spine(calendar(spark, first, last), daily)
    metrics = {
        "video_das": "video_das",
        "voice_das": "voice_das",
        "video_duration": hours(F.col("video_seconds")),
        "voice_duration": hours(F.col("voice_seconds")),
    }
    return dense_series(spark, wide, runs, metrics)


def currency_economy(spark: SparkSession, src: Sources, runs: Runs) -> DataFrame:
    """Trailing ratios count trading days, so they depend on where a run's history starts:
    every run gets its own copy of the (one row per day) totals."""
    first, last = runs.back(91), runs.last_report
    sales = (
        src["store_transaction"]
        .where(in_days(F.col("datecreated"), first, last) & F.col("status").isin(*SETTLED))
        .withColumn("dt", F.to_date("datecreated"))
    )
    daily = runs.per_run(sold_per_day(sales, src["store_product"], GIVE_AWAYS), back=91)
    names = "rolling_{}d_bar_per_dollar"
    rolling = ratio_of_sums(daily, "bars", "dollars", (3, 16, 30), ["run_date"], names)
    axis = runs.per_run(calendar(spark, runs.back(61), last), back=61)
    wide = on_spine(axis, rolling, ["run_date", "dt"])
    metrics = {
        names.format(n): F.col(names.format(n)).cast(METRIC) for n in (3, 16, 30)
    }
    long = to_long(wide, ["run_date", "dt"], metrics)
    return runs.on_report_day(comparison_pack(baseline_pack(long, ["run_date"])))
