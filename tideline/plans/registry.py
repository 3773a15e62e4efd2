"""The report catalog and the two ways to run it: one day, or a range in one job."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans import distribution, kpi, movements, slices, stickiness
from tideline.plans.runs import Runs

Plan = Callable[[SparkSession, Mapping[str, DataFrame], Runs], DataFrame]


@dataclass(frozen=True)
class Report:
    name: str
    plan: Plan
    description: str
    sources: tuple[str, ...]
    order: tuple[str, ...]
    newest_first: bool = False
    role: str = "supporting"
    supports: tuple[str, ...] = ()

    def sort_keys(self) -> list[Column]:
        keys = [F.col(c).asc_nulls_last() for c in self.order]
        if self.newest_first:
            keys[0] = F.col(self.order[0]).desc_nulls_last()
        return keys


_CATALOG = [
    Report(
        "main_kpi_nested", kpi.main_kpi_nested,
        "Daily actives, payers, matchers, audiences and revenue streams with availability",
        ("daily_user_activities", "admob_revenue"), ("metric",), role="primary",
    ),
    Report(
        "purchase_distribution", distribution.purchase_distribution,
        "Percentiles of daily revenue and purchases per paying user",
        ("can_purchase",), ("date",), supports=("main_kpi_nested",),
    ),
    Report(
        "streamer_activity", kpi.streamer_activity,
        "Video and voice streamers and hours streamed per day",
        ("streaming",), ("metric",), supports=("main_kpi_nested",),
    ),
    Report(
        "lifecycle_mrr_region", movements.lifecycle_mrr_region,
        "User lifecycle and 30-day revenue movements by region over the last week",
        ("daily_user_activities",), ("dt", "region"), newest_first=True,
        supports=("main_kpi_nested",),
    ),
    Report(
        "stickiness_region", stickiness.stickiness_region,
        "Daily against rolling weekly and monthly actives by region",
        ("daily_user_activities",), ("region", "metric"), supports=("main_kpi_nested",),
    ),
    Report(
        "main_kpi_flat", kpi.main_kpi_flat,
        "Daily actives, payers, spenders and revenue",
        ("dailyactives", "store_transaction"), ("metric",), role="primary",
    ),
    Report(
        "currency_economy", kpi.currency_economy,
        "Virtual currency generated per dollar over trailing trading days",
        ("store_transaction", "store_product"), ("metric",), role="primary",
    ),
    Report(
        "main_kpi_slice", slices.main_kpi_slice,
        "Daily actives, payers, spenders and revenue by region and tier",
        ("dailyactives", "store_transaction", "users_data", "crown_level_log"),
        ("region", "tier", "metric"), supports=("main_kpi_flat",),
    ),
    Report(
        "lifecycle_mrr_tier", movements.lifecycle_mrr_tier,
        "User lifecycle and 30-day revenue movements by region and tier over eight days",
        ("dailyactives", "store_transaction", "users_data", "crown_level_log"),
        ("dt", "region", "tier"), newest_first=True, supports=("main_kpi_flat",),
    ),
    Report(
        "kpi_by_level", slices.kpi_by_level,
        "Daily actives, payers and revenue by exact user level",
        ("dailyactives", "store_transaction", "users_data", "crown_level_log"),
        ("crown_level", "metric"), supports=("main_kpi_flat",),
    ),
    Report(
        "stickiness_locale", stickiness.stickiness_locale,
        "Daily against rolling weekly and monthly actives by locale region",
        ("dailyactives", "users_data"), ("region", "metric"), supports=("main_kpi_flat",),
    ),
]

REPORTS: dict[str, Report] = {r.name: r for r in _CATALOG}


def run_report(
    spark: SparkSession, name: str, sources: Mapping[str, DataFrame], run_date: date
) -> DataFrame:
    """One report for one run date; its report day is the day before."""
    report = REPORTS[name]
    plan = report.plan(spark, sources, Runs.single(run_date))
    return plan.drop("run_date").orderBy(*report.sort_keys())


def backfill(
    spark: SparkSession,
    name: str,
    sources: Mapping[str, DataFrame],
    first_report: date,
    last_report: date,
) -> DataFrame:
    """Every report day of a range in one job: the union of the single runs, each row
    labelled with its ``run_date``."""
    report = REPORTS[name]
    plan = report.plan(spark, sources, Runs.reporting(first_report, last_report))
    return plan.orderBy("run_date", *report.sort_keys())


def catalog(spark: SparkSession) -> DataFrame:
    """The report catalog as ``name, description, role, supports``."""
    rows = [(r.name, r.description, r.role, list(r.supports)) for r in REPORTS.values()]
    return spark.createDataFrame(
        rows, "name string, description string, role string, supports array<string>"
    )
