"""The reports, for one run date and as one-job backfills."""

from __future__ import annotations

from datetime import date, timedelta

from tideline.checks.report_sql import REPORT_SQL, report_statement
from tideline.plans.registry import REPORTS, backfill, run_report
from tideline.sources.sample import EventsWorld, OrdersWorld

ON_ORDERS = {"lifecycle_mrr_region", "lifecycle_mrr_tier"}
RANGES = {
    EventsWorld: (date(2024, 1, 15), date(2024, 1, 30)),
    OrdersWorld: (date(1995, 5, 20), date(1995, 5, 31)),
}
# Names of backfills in the query list.
BACKFILLS = {
    "backfill_main_kpi": "main_kpi_flat",
    "backfill_lifecycle": "lifecycle_mrr_region",
    "backfill_lifecycle_tier": "lifecycle_mrr_tier",
    "backfill_main_kpi_nested": "main_kpi_nested",
    "backfill_main_kpi_slice": "main_kpi_slice",
    "backfill_kpi_by_level": "kpi_by_level",
    "backfill_stickiness_region": "stickiness_region",
    "backfill_stickiness_locale": "stickiness_locale",
    "backfill_currency_economy": "currency_economy",
    "backfill_streamer_activity": "streamer_activity",
    "backfill_purchase_distribution": "purchase_distribution",
}


def world_of(report: str):
    return OrdersWorld if report in ON_ORDERS else EventsWorld


def _single(report: str):
    kind = world_of(report)

    def query(spark, sf_dir):
        return run_report(spark, report, kind(spark, sf_dir), kind.run_date)

    return query


def _range(report: str):
    kind = world_of(report)

    def query(spark, sf_dir):
        return backfill(spark, report, kind(spark, sf_dir), *RANGES[kind])

    return query


QUERIES = {f"rpt_{name}": _single(name) for name in REPORTS}
QUERIES |= {key: _range(report) for key, report in BACKFILLS.items()}


def _oracles() -> dict[str, str]:
    out = {}
    for name in REPORT_SQL:
        run = world_of(name).run_date.isoformat()
        out[f"rpt_{name}"] = report_statement(name, run, run, keep_run=False)
    day = timedelta(days=1)
    for key, name in BACKFILLS.items():
        first, last = RANGES[world_of(name)]
        out[key] = report_statement(
            name, (first + day).isoformat(), (last + day).isoformat(), keep_run=True
        )
    return out


ORACLE = _oracles()
