"""Daily product metrics on Spark: dense series, baselines, lifecycle and revenue movements."""

from tideline.plans.registry import REPORTS, backfill, catalog, run_report
from tideline.plans.runs import Runs

__all__ = ["REPORTS", "Runs", "backfill", "catalog", "run_report"]
