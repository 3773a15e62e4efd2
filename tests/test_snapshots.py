from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import SAMPLE, day, rows
from tideline.operators.ordered import release
from tideline.sources.sample import EventsWorld
from tideline.sources.snapshots import (
    RowBudgetExceeded, budget_status, guard_rows, latest_payloads, live_runs, placed_rows, read_payloads, read_run,
    read_snapshot, run_status, save_payload, snapshot_reports, store_report, to_cells, write_snapshot,
)
from tideline.sources.warehouse import SCHEMAS, Warehouse, conform


def test_budget_passes_exactly_at_the_limit(spark):
    assert guard_rows(spark.range(200), 200).count() == 200
    with pytest.raises(RowBudgetExceeded, match="200"):
        guard_rows(spark.range(201), 200)
    assert rows(budget_status(spark.range(5000), 3)) == [(5000, False)]


def test_cells_of_wide_and_long_results(spark):
    wide = spark.createDataFrame([(day(1), 2), (day(0), None)], "dt date, n int")
    got = rows(to_cells(wide, "q", [F.col("dt")], day(9)))
    assert (day(9), "q", 1, "n", "NULL", "", None) in got and (day(9), "q", 2, "dt", "2024-01-02T00:00:00Z", "", None) in got
    long = spark.createDataFrame([("dau", 2.0)], "metric string, value double")
    assert (day(9), "q", 1, "value", "2.0000", "dau", None) in rows(to_cells(long, "q", ["metric"], day(9)))


def test_one_failing_report_leaves_the_others_alone(spark, tmp_path):
    world = EventsWorld(spark, SAMPLE)
    src = {n: world[n] for n in ("dailyactives", "store_transaction")}
    path = str(tmp_path / "cells")
    names = ["main_kpi_flat", "stickiness_locale"]
    errors = snapshot_reports(spark, src, world.run_date, path, names)
    assert list(errors) == ["stickiness_locale"]
    status = {r["query"]: r.status for r in run_status(spark, path).collect()}
    assert status == {"main_kpi_flat": "stored", "stickiness_locale": "failed"}
    assert read_snapshot(spark, path).where("query = 'main_kpi_flat'").select("row_no").distinct().count() == 4


def test_a_failed_job_is_isolated_and_keeps_earlier_cells(spark, tmp_path):
    world = EventsWorld(spark, SAMPLE)
    path, names = str(tmp_path / "cells"), ["stickiness_locale", "main_kpi_flat"]
    src = {n: world[n] for n in ("dailyactives", "store_transaction", "users_data")}
    assert not snapshot_reports(spark, src, world.run_date, path, names)
    before = rows(read_snapshot(spark, path))
    broken = tmp_path / "users"
    conform(world["users_data"], "users_data").write.parquet(str(broken))
    src["users_data"] = spark.read.parquet(str(broken))
    for part in broken.glob("*.parquet"):
        part.write_bytes(b"PAR1 not a table")
    for last in (None, world.run_date - timedelta(days=1)):
        assert list(snapshot_reports(spark, src, world.run_date, path, names, last_report=last)) == ["stickiness_locale"]
    assert rows(read_snapshot(spark, path)) == before


def test_both_routes_store_the_same_cells_whatever_their_number(spark, tmp_path):
    world = EventsWorld(spark, SAMPLE)
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    assert "max_rows=3" in snapshot_reports(spark, world, world.run_date, one, ["main_kpi_flat"], max_rows=3)["main_kpi_flat"]
    snapshot_reports(spark, world, world.run_date, many, ["main_kpi_flat"], last_report=world.run_date - timedelta(days=1))
    assert rows(read_snapshot(spark, one)) == rows(read_snapshot(spark, many)) != []


def test_an_empty_rerun_clears_its_day(spark, tmp_path):
    path = str(tmp_path / "cells")
    result = spark.createDataFrame([("dau", 2.0)], "metric string, value double")
    write_snapshot(to_cells(result, "q", ["metric"], day(0)), path, [day(0)], "q")
    write_snapshot(to_cells(result, "other", ["metric"], day(0)), path, [day(0)], "other")
    write_snapshot(to_cells(result.limit(0), "q", ["metric"], day(0)), path, [day(0)], "q")
    assert rows(read_snapshot(spark, path).select("query").distinct()) == [("other",)]


def test_the_last_payload_of_a_run_counts(spark):
    data = [("r1", "context", day(0), "a", 1), ("r1", "context", day(0), "b", 2), ("r1", "report", day(0), "c", 1), ("r2", "context", day(1), "d", 1)]
    df = spark.createDataFrame(data, "run_id string, kind string, report_date date, payload string, saved_at int")
    assert rows(latest_payloads(df), "run_id", "kind", "payload") == [("r1", "context", "b"), ("r1", "report", "c"), ("r2", "context", "d")]


def test_rerun_replaces_its_own_day_only(spark, tmp_path):
    path = str(tmp_path / "cells")
    result = spark.createDataFrame([("dau", 2.0)], "metric string, value double")
    for d, df in [(day(0), result), (day(1), result.union(result)), (day(1), result)]:
        write_snapshot(to_cells(df, "q", ["metric"], d), path)
    counted = read_snapshot(spark, path).groupBy("report_date").count()
    assert rows(counted) == [(day(0), 2), (day(1), 2)]


def test_a_run_that_dies_leaves_the_old_one_readable(spark, tmp_path, monkeypatch):
    from tideline.sources import manifests

    path = str(tmp_path / "cells")
    assert read_snapshot(spark, path).isEmpty() and run_status(spark, path).isEmpty()
    old, new = (spark.createDataFrame([("dau", v)], "metric string, value double") for v in (1.0, 2.0))
    first = write_snapshot(to_cells(old, "q", ["metric"], day(0)), path, [day(0)], "q")
    before = rows(read_snapshot(spark, path))
    with monkeypatch.context() as broken:
        broken.setattr(manifests, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            write_snapshot(to_cells(new, "q", ["metric"], day(0)), path, [day(0)], "q")
    assert len(list((tmp_path / "cells" / "cells").glob("run_id=*"))) == 2 and rows(read_snapshot(spark, path)) == before
    # Replaced runs stay readable by their id.
    second = write_snapshot(to_cells(new, "q", ["metric"], day(0)), path, [day(0)], "q")
    assert rows(live_runs(spark, path), "query", "run_id", "n_rows") == [("q", second, 1)]
    assert rows(read_run(spark, path, first)) == before != rows(read_snapshot(spark, path))
    with pytest.raises(ValueError, match="nothing"):
        read_run(spark, path, "nothing")
    with pytest.raises(FileExistsError):
        manifests.publish(spark, f"{path}/_runs", first, [])


def test_rows_of_one_day_are_numbered_in_many_tasks(spark):
    many = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("x"))
    placed = placed_rows(many, [F.col("x").desc_nulls_last(), F.col("k")], day(3))
    got = placed.orderBy("_no").select("k", "x", "_no").collect()
    want = sorted(many.collect(), key=lambda r: (r["x"] is None, -(r["x"] or 0), r["k"]))
    assert [tuple(r) for r in got] == [(r["k"], r["x"], n) for n, r in enumerate(want, 1)]
    assert placed.select(F.spark_partition_id()).distinct().count() > 1
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()
    release(placed)


def test_odd_numbers_have_cells(spark):
    odd = spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", 1e300), ("d", None), ("e", -0.00005)], "metric string, value double")
    got = {r["row_metric"]: r["value"] for r in to_cells(odd, "q", ["metric"], day(0)).where("column = 'value'").collect()}
    assert got == {"a": "NaN", "b": "Infinity", "c": "1.0E300", "d": "NULL", "e": "-0.0001"}


def test_a_result_without_rows_is_stored(spark, tmp_path):
    path = str(tmp_path / "cells")
    empty = spark.createDataFrame([], "metric string, value double")
    assert store_report(spark, lambda: empty, "q", ["metric"], [day(0), day(1)], path) is None
    assert rows(run_status(spark, path), "report_date", "status") == [(day(0), "stored"), (day(1), "stored")]
    assert read_snapshot(spark, path).isEmpty()


def test_payloads_append_by_day_and_kind(spark, tmp_path):
    path = str(tmp_path / "payloads")
    df = spark.createDataFrame([("r1", day(0), "{}")], "run_id string, report_date date, payload string")
    save_payload(df, "input", path)
    save_payload(df, "report", path)
    save_payload(df.withColumn("kind", F.lit("context")), None, path)
    assert rows(read_payloads(spark, path), "run_id", "kind") == [("r1", "context"), ("r1", "input"), ("r1", "report")]


def test_warehouse_reads_relations_when_asked(spark, tmp_path):
    ads = spark.createDataFrame([(date(2024, 1, 1), None)], SCHEMAS["admob_revenue"])
    ads.write.parquet(str(tmp_path / "admob_revenue"))
    house = Warehouse(spark, str(tmp_path))
    assert house["admob_revenue"].count() == 1
    with pytest.raises(KeyError):
        house["no_such_relation"]


def test_command_line_run_and_backfill(spark, tmp_path):
    from tideline.__main__ import main

    world = EventsWorld(spark, SAMPLE)
    sources, out = str(tmp_path / "src"), str(tmp_path / "cells")
    for name in ("dailyactives", "store_transaction"):
        conform(world[name], name).write.parquet(f"{sources}/{name}")
    args = ["--sources", sources, "--out", out]
    assert main([*args, "--report-date", "2024-01-30", "--reports", "main_kpi_flat", "stickiness_locale"]) == 1
    once = rows(read_snapshot(spark, out).where("query = 'main_kpi_flat'"))
    assert main([*args, "--report-date", "2024-01-29", "--to", "2024-01-30", "--reports", "main_kpi_flat"]) == 0
    both = read_snapshot(spark, out).where("query = 'main_kpi_flat'")
    assert rows(both.where("report_date = date '2024-01-30'")) == once
    assert both.select("report_date").distinct().count() == 2


def test_catalog_labels_resolve(spark):
    from tideline import catalog
    from tideline.operators.knowledge import resolve_labels

    labels = {r.name: r for r in resolve_labels(catalog(spark)).collect()}
    assert labels["main_kpi_slice"].supports_label == labels["main_kpi_flat"].label
    assert labels["main_kpi_flat"].supports_label == ""
