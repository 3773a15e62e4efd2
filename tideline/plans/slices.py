"""KPI cut by region and tier, and by exact level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.buckets import level_tier
from tideline.functions.dates import in_days
from tideline.operators.aggregates import merge_user_days
from tideline.operators.joins import attach_user_dim
from tideline.operators.levels import with_levels
from tideline.operators.series import baseline_pack, comparison_pack, to_long
from tideline.operators.spine import fill_gaps
from tideline.plans.kpi import Sources, settled_sales
from tideline.plans.runs import Runs

USER_DAY = ("dt", "userid")


def level_rows(src: Sources, first, last) -> DataFrame:
    """Logged levels: ``dt, userid, level``; whoever merges them keeps the day's highest.

    A level without a user belongs to nobody: unknown users are not one user.
    """
    known = src["crown_level_log"].where(in_days(F.col("datecreated"), first, last) & F.col("userid").isNotNull())
    return known.select(
        F.to_date("datecreated").alias("dt"), "userid", F.col("crown_level").alias("level")
    )


def main_kpi_slice(spark: SparkSession, src: Sources, runs: Runs) -> DataFrame:
    """A user's revenue of a day counts once per distinct spend value logged that day,
    and payers without activity do not count: both follow from activity being the left
    side and its rows, not its user-days, being the unit."""
    first, last = runs.back(61), runs.last_report
    spends = (
        src["dailyactives"]
        .where(in_days(F.col("day"), first, last))
        .select(F.col("day").cast("date").alias("dt"), "userid", "bars_spent")
        .distinct()
        .select(*USER_DAY, (F.col("bars_spent") > 0).alias("spender"), F.lit(1).alias("times"))
    )
    # Sales without a user pay for no active one; activity without a user still counts its tuple.
    sales = settled_sales(src, first, last).where(F.col("userid").isNotNull())
    log = merge_user_days(
        [spends, sales, level_rows(src, runs.back(77), last)],
        USER_DAY,
        {
            "times": F.sum("times"),
            "spender": F.bool_or("spender"),
            "rev": F.sum("rev"),
            "level": F.max("level"),
        },
    )
    tiered = with_levels(log, "userid").where(F.col("times").isNotNull())
    active = attach_user_dim(
        tiered.select(*USER_DAY, "times", "spender", "rev", level_tier(F.col("period_level")).alias("tier")),
        src["users_data"],
        "userid",
    )
    daily = active.groupBy("dt", "region", "tier").agg(
        F.count("userid").alias("dau"),
        F.count(F.when(F.col("rev") > 0, F.col("userid"))).alias("payers"),
        F.count(F.when(F.col("spender"), F.col("userid"))).alias("spenders"),
        F.sum(F.col("rev") * F.col("times")).alias("rev"),
    )
    metrics = ["dau", "payers", "spenders", "rev"]
    # Zero filled over the whole range; a run only knows tuples seen on its own axis.
    wide = fill_gaps(
        daily, first, last, ["region", "tier"], {m: 0 for m in metrics}, available="activity_available"
    )
    on_axis = Window.partitionBy("region", "tier").orderBy("dt").rowsBetween(-60, 0)
    wide = wide.withColumn("_seen", F.max("activity_available").over(on_axis))
    long = to_long(
        wide, ["dt", "tier", "region", "_seen"], metrics, {m: "activity_available" for m in metrics}
    )
    compared = comparison_pack(baseline_pack(long, ["region", "tier"]))
    return runs.stamp(compared).where(F.col("_seen") == 1).drop("_seen")


def kpi_by_level(spark: SparkSession, src: Sources, runs: Runs) -> DataFrame:
    """Activity carries the latest level of the last 30 days, revenue the best level of
    the half-month so far; a user may appear under two levels on one day.

    There is no axis: baselines run over the days a level occurs on. And each run's
    level history starts 77 days back, so an old level can be invisible to a late run.
    Both are settled after folding, on rows of (day, level, age of the level).
    """
    first, last = runs.back(61), runs.last_report
    active = (
        src["dailyactives"]
        .where(in_days(F.col("day"), first, last))
        .select(F.col("day").cast("date").alias("dt"), "userid", F.lit(True).alias("active"))
    )
    log = merge_user_days(
        [active, settled_sales(src, first, last), level_rows(src, runs.back(77), last)],
        USER_DAY,
        {"active": F.bool_or("active"), "rev": F.sum("rev"), "level": F.max("level")},
    )
    leveled = with_levels(log, "userid", lookback=30).where(
        F.col("active") | F.col("rev").isNotNull()
    )
    current = src["users_data"].where(F.col("terminated") == 0).select(
        "userid", F.lit(True).alias("current")
    )
    known = leveled.join(current, "userid", "left")
    pays = F.col("rev").isNotNull() & F.coalesce(F.col("current"), F.lit(False))
    nothing = F.lit(0).cast("decimal(28,2)")

    def part(applies, level, level_dt, dau, payers, rev):
        return F.when(
            applies,
            F.struct(
                F.coalesce(level, F.lit(0)).alias("crown_level"),
                level_dt.alias("level_dt"),
                dau.alias("dau"),
                payers.alias("payers"),
                rev.cast("decimal(28,2)").alias("revenue"),
            ),
        )

    someone = F.when(F.col("userid").isNotNull(), 1).otherwise(0)
    parts = F.array(
        part(F.col("active"), F.col("asof_level"), F.col("asof_level_dt"), someone, F.lit(0), nothing),
        part(pays, F.col("period_level"), F.lit(None).cast("date"), F.lit(0), someone, F.col("rev")),
    )
    measures = ["dau", "payers", "revenue"]
    folded = (
        known.select("dt", F.inline(parts))
        .where(F.col("crown_level").isNotNull())
        .groupBy("dt", "crown_level", "level_dt")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    out_of_sight = F.col("level_dt") < F.date_sub("run_date", 77)
    daily = (
        runs.per_run(folded, back=61)
        .withColumn("crown_level", F.when(out_of_sight, 0).otherwise(F.col("crown_level")))
        .groupBy("run_date", "dt", "crown_level")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    long = to_long(daily, ["run_date", "dt", "crown_level"], measures)
    return runs.on_report_day(comparison_pack(baseline_pack(long, ["run_date", "crown_level"])))
