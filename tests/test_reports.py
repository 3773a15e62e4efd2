"""Reports as a whole: backfills against single runs, and behaviour by hand-made case."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import SAMPLE, day, rows
from tideline.checks.reports import world_of
from tideline.plans.registry import REPORTS, backfill, run_report
from tideline.plans.runs import Runs
from tideline.sources.sample import EventsWorld
from tideline.sources.warehouse import SCHEMAS, TIME_COLUMNS, Warehouse, conform

RUN = day(100)
REPORT = day(99)


@pytest.mark.parametrize("name", list(REPORTS))
def test_backfill_is_the_union_of_single_runs(spark, name):
    kind = world_of(name)
    world = kind(spark, SAMPLE)
    first = kind.run_date - timedelta(days=3)
    whole = backfill(spark, name, world, first, first + timedelta(days=2))
    columns = [c for c in whole.columns if c != "run_date"]
    single = []
    for n in range(1, 4):
        run = first + timedelta(days=n)
        single += [(run, *r) for r in rows(run_report(spark, name, world, run), *columns)]
    assert rows(whole, "run_date", *columns) == sorted(single, key=repr)
    assert single


def test_backfill_forgets_what_a_run_could_not_see(spark):
    """A return after more days than a run's history is not resurrected in that run."""
    activity = [(REPORT - timedelta(days=d), 1, "TW", 500 - d) for d in (66, 64, 3, 0)] + [
        (REPORT - timedelta(days=d), 2, "TW", 500 - d) for d in (68, 1)
    ]
    src = {"daily_user_activities": activity_frame(spark, activity)}
    whole = backfill(spark, "lifecycle_mrr_region", src, REPORT - timedelta(days=1), REPORT)
    columns = ["dt", "traffic_resurrected", "traffic_churned"]
    for n in (0, 1):
        run = RUN - timedelta(days=n)
        alone = rows(run_report(spark, "lifecycle_mrr_region", src, run), *columns)
        assert rows(whole.where(F.col("run_date") == F.lit(run)), *columns) == alone


def test_levels_too_old_for_a_run_are_invisible_to_it(spark):
    src = product(
        spark,
        active=[(REPORT - timedelta(days=d), u, None) for u in (1, 2) for d in (60, 59, 30, 1, 0)],
        levels=[(REPORT - timedelta(days=77), 1, 9), (REPORT - timedelta(days=61), 2, 4)],
    )
    whole = backfill(spark, "kpi_by_level", src, REPORT - timedelta(days=1), REPORT)
    columns = [c for c in whole.columns if c != "run_date"]
    for n in (0, 1):
        run = RUN - timedelta(days=n)
        alone = rows(run_report(spark, "kpi_by_level", src, run), *columns)
        assert rows(whole.where(F.col("run_date") == F.lit(run)), *columns) == alone


def activity_frame(spark, data):
    df = spark.createDataFrame(data, "dt date, user_id long, country_code string, day_index int")
    null = F.lit(None)
    return conform(
        df.withColumns(
            {c: null for c in ("can_purchasing_dim", "sub_purchasing_dim", "matching_dim", "audience_dim")}
        ),
        "daily_user_activities",
    )


def product(spark, active=(), sales=(), users=(), levels=()):
    """Source relations from short tuples; amounts are strings."""
    def stamp(d):
        return datetime(d.year, d.month, d.day, 13)

    return {
        "dailyactives": conform(
            spark.createDataFrame(
                [(d, u, None if s is None else Decimal(s)) for d, u, s in active],
                "day date, userid long, bars_spent decimal(18,2)",
            ).withColumn("revenue", F.lit(None)),
            "dailyactives",
        ),
        "store_transaction": spark.createDataFrame(
            [(stamp(d), u, 1, Decimal(a), 10, s) for d, u, a, s in sales], SCHEMAS["store_transaction"]
        ),
        "store_product": spark.createDataFrame([(1, "pack")], SCHEMAS["store_product"]),
        "users_data": spark.createDataFrame(list(users), SCHEMAS["users_data"]),
        "crown_level_log": spark.createDataFrame(
            [(stamp(d), u, v) for d, u, v in levels], SCHEMAS["crown_level_log"]
        ),
    }


def values(df, *keys):
    return {tuple(r[k] for k in [*keys, "metric"]): r["value"] for r in df.collect()}


def test_repeated_spend_rows_repeat_the_revenue_in_the_slice(spark):
    src = product(
        spark,
        active=[(REPORT, 1, "1.00"), (REPORT, 1, "2.00"), (REPORT, 1, "2.00"), (REPORT, 2, None)],
        sales=[(REPORT, 1, "10.00", "COMPLETED")],
    )
    sliced = values(run_report(spark, "main_kpi_slice", src, RUN), "region", "tier")
    flat = values(run_report(spark, "main_kpi_flat", src, RUN))
    assert sliced[("others", "no", "rev")] == 20.0 and flat[("rev",)] == 10.0
    assert sliced[("others", "no", "dau")] == 2.0 and sliced[("others", "no", "spenders")] == 1.0


def test_payers_without_activity_are_not_in_the_slice(spark):
    src = product(spark, active=[(REPORT, 1, None)], sales=[(REPORT, 2, "10.00", "AUTHORIZED")])
    assert values(run_report(spark, "main_kpi_slice", src, RUN), "region", "tier")[("others", "no", "payers")] == 0.0
    flat = run_report(spark, "main_kpi_flat", src, RUN)
    assert values(flat)[("payers",)] == 1.0


def test_only_settled_positive_sales_count(spark):
    src = product(
        spark, active=[(REPORT, 1, None)],
        sales=[(REPORT, 1, "5.00", "DECLINED"), (REPORT, 1, "0.00", "COMPLETED"), (RUN, 1, "9.00", "COMPLETED")],
    )
    assert values(run_report(spark, "main_kpi_flat", src, RUN))[("rev",)] == 0.0


def test_availability_follows_activity(spark):
    src = product(spark, sales=[(REPORT, 1, "5.00", "COMPLETED")])
    got = run_report(spark, "main_kpi_flat", src, RUN).collect()
    assert {r["data_available"] for r in got} == {0} and len(got) == 4


def test_slice_adds_up_to_the_flat_report(spark):
    world = EventsWorld(spark, SAMPLE)
    sliced = run_report(spark, "main_kpi_slice", world, world.run_date).where("metric = 'dau'")
    flat = values(run_report(spark, "main_kpi_flat", world, world.run_date))
    assert sliced.agg(F.sum("value")).first()[0] == flat[("dau",)]


def test_ad_revenue_appears_a_day_later(spark):
    ads = spark.createDataFrame([(REPORT - timedelta(days=1), Decimal("7.00"))], SCHEMAS["admob_revenue"])
    src = {"daily_user_activities": activity_frame(spark, [(REPORT, 1, "TW", 0)]), "admob_revenue": ads}
    got = {r["metric"]: r for r in run_report(spark, "main_kpi_nested", src, RUN).collect()}
    assert got["admob_revenue"].value == 7.0 and got["total_revenue"].data_available == 1
    late = {r["metric"]: r for r in run_report(spark, "main_kpi_nested", src, REPORT).collect()}
    assert late["admob_revenue"].value == 0.0 and late["total_revenue"].data_available == 0


def test_streamer_days_without_data_stay_empty(spark):
    schema = SCHEMAS["streaming"]
    shown = [(datetime(2024, 4, 8, 10), 1, True, Decimal(3600)), (datetime(2024, 4, 6, 10), 1, None, Decimal(60))]
    src = {"streaming": spark.createDataFrame(shown, schema)}
    got = {r["metric"]: r for r in run_report(spark, "streamer_activity", src, date(2024, 4, 9)).collect()}
    assert got["video_duration"].value == 1.0 and got["video_das"].previous_day is None
    # The day with an unknown kind has a value of zero; days without rows have none.
    assert got["video_das"].previous_7d_avg == 0.0 and got["voice_das"].value == 0.0


def test_tier_change_looks_like_churn_in_the_old_tier(spark):
    sales = [(REPORT - timedelta(days=40), 1, "30.00", "COMPLETED"), (REPORT - timedelta(days=2), 1, "60.00", "COMPLETED")]
    levels = [(REPORT - timedelta(days=40), 1, 1), (REPORT - timedelta(days=2), 1, 13)]
    got = run_report(spark, "lifecycle_mrr_tier", product(spark, sales=sales, levels=levels), RUN)
    shown = {r["tier"]: r for r in got.where(F.col("dt") == F.lit(REPORT)).collect()}
    assert shown["red"].revenue_churned == 1.0 and shown["golden"].revenue_expansion == 0.0


def test_tier_report_covers_eight_days(spark):
    got = run_report(spark, "lifecycle_mrr_tier", product(spark, active=[(REPORT, 1, None)]), RUN)
    assert len(rows(got)) == 8 and got.first()["dt"] == REPORT


def test_activity_and_revenue_may_show_different_levels(spark):
    # The latest level counts for activity, the best of the half-month for revenue.
    src = product(
        spark, active=[(day(8), 1, None)], sales=[(day(8), 1, "5.00", "COMPLETED")],
        users=[(1, "US", "en", day(0), 0)], levels=[(day(2), 1, 12), (day(6), 1, 3)],
    )
    got = values(run_report(spark, "kpi_by_level", src, day(9)), "crown_level")
    assert got[(3, "dau")] == 1.0 and got[(12, "payers")] == 1.0 and got[(3, "payers")] == 0.0


def test_revenue_by_level_leaves_terminated_and_unknown_users_out(spark):
    src = product(
        spark, active=[(REPORT, 1, None)],
        sales=[(REPORT, u, "5.00", "COMPLETED") for u in (1, 2, 3)],
        users=[(1, "US", "en", day(0), 0), (2, "US", "en", day(0), 1)],
    )
    assert values(run_report(spark, "kpi_by_level", src, RUN), "crown_level")[(0, "revenue")] == 5.0


def test_empty_axis_day_of_stickiness(spark):
    src = {"daily_user_activities": activity_frame(spark, [(REPORT - timedelta(days=40), 1, "TW", 0)])}
    got = run_report(spark, "stickiness_region", src, RUN).collect()
    assert {r["region"] for r in got} == {None}
    assert {r["metric"]: r["value"] for r in got} == {
        "dau/rolling_wau": None, "dau/rolling_mau": None, "rolling_7d_wau": 0.0, "rolling_30d_mau": 0.0,
    }


def test_stickiness_ratio_is_rounded_before_its_baselines(spark):
    data = [(REPORT - timedelta(days=n), u, "TW", 0) for n in range(3) for u in range(3) if n or u]
    got = {r["metric"]: r for r in run_report(spark, "stickiness_region", {"daily_user_activities": activity_frame(spark, data)}, RUN).collect()}
    assert got["dau/rolling_wau"].value == 0.67


def test_runs_reject_a_reversed_range():
    with pytest.raises(ValueError):
        Runs.reporting(date(2024, 1, 2), date(2024, 1, 1))


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The dense world written out as a warehouse folder, one parquet table per relation."""
    root = str(tmp_path_factory.mktemp("warehouse"))
    world = EventsWorld(spark, SAMPLE)
    for name in {s for r in REPORTS.values() for s in r.sources}:
        conform(world[name], name).write.parquet(f"{root}/{name}")
    return Warehouse(spark, root)


@pytest.mark.parametrize("name", sorted(set(REPORTS) - {"purchase_distribution"}))
def test_each_source_is_scanned_once_and_pruned_by_date(spark, stored, name):
    report = REPORTS[name]
    plan = physical(run_report(spark, name, stored, EventsWorld.run_date))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == len(report.sources)
    for source in report.sources:
        scan = next(s for s in scans if f"/{source}]" in s or f"/{source}," in s)
        if source in TIME_COLUMNS:
            column = TIME_COLUMNS[source]
            assert f"GreaterThanOrEqual({column}," in scan and f"LessThan({column}," in scan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Expand" not in plan


def test_only_used_struct_fields_are_read(spark, stored):
    plan = physical(run_report(spark, "lifecycle_mrr_region", stored, EventsWorld.run_date))
    assert "matching_dim" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_user_days_are_shuffled_by_user_once(spark, stored):
    """One fold by user-day, one exchange by user for activity, user join and revenue."""
    plan = physical(run_report(spark, "lifecycle_mrr_tier", stored, EventsWorld.run_date))
    by_user = [line for line in plan.splitlines() if "Exchange hashpartitioning(userid" in line]
    assert len(by_user) <= 2  # the log, and the user table where it is not broadcast
