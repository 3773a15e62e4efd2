"""Purchase distribution: how much and how often a paying user buys on a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.dates import in_days
from tideline.functions.numbers import round_half_away
from tideline.operators.aggregates import exact_percentiles, user_day
from tideline.plans.kpi import Sources
from tideline.plans.runs import Runs

POINTS = {"median": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
MEASURES = ("revenue", "transactions")


def purchase_distribution(spark: SparkSession, src: Sources, runs: Runs) -> DataFrame:
    bought = src["can_purchase"].where(
        in_days(F.col("purchased_at"), runs.back(30), runs.last_report)
    )
    spenders = user_day(
        bought,
        F.to_date("purchased_at"),
        "user_id",
        {"transactions": F.count_distinct("ch_id"), "revenue": F.sum("usd_price")},
    ).where(F.col("revenue") > 0)
    # Both measures in hundredths: interpolation between two amounts then ends on an
    # exact half often enough to matter, and halves must round up.
    hundredths = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), (F.col(m) * 100).cast("double").alias("hundredths"))
            for m in MEASURES
        ]
    )
    long = spenders.select("dt", F.inline(hundredths))
    points = exact_percentiles(long, ["dt", "measure"], "hundredths", list(POINTS.values()))
    shown = round_half_away(F.col("percentile"), 0) / 100.0
    daily = points.groupBy("dt").agg(
        *[
            F.max(F.when((F.col("measure") == m) & (F.col("fraction") == p), shown)).alias(f"{n}_{m}")
            for m in MEASURES
            for n, p in POINTS.items()
        ]
    )
    return runs.per_run(daily, back=30).withColumnRenamed("dt", "date")
