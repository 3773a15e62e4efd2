"""Result snapshots: every report's rows as text cells, and a log of how its runs ended."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.text import cell_text
from tideline.operators.levels import latest_per_key
from tideline.operators.ordered import numbered, release
from tideline.sources import manifests

CELLS = (
    "report_date date, query string, row_no int, column string, value string, "
    "row_metric string, error string"
)
CELL_COLUMNS = [c.split()[0] for c in CELLS.split(", ")]
RUNS = "report_date date, query string, run_id string, status string, error string, n_rows bigint, saved_at bigint"


class RowBudgetExceeded(ValueError):
    """A result is larger than a report may be."""


def budget_status(df: DataFrame, max_rows: int) -> DataFrame:
    """How many rows a result has and whether that fits."""
    seen = F.count(F.lit(1))
    return df.agg(seen.alias("rows_seen"), (seen <= max_rows).alias("within_budget"))


def guard_rows(df: DataFrame, max_rows: int) -> DataFrame:
    """Fail, never truncate, when a result has more than ``max_rows`` rows."""
    status = budget_status(df, max_rows).first()
    if not status["within_budget"]:
        raise RowBudgetExceeded(f"result exceeds max_rows={max_rows}; aggregate further")
    return df


def placed_rows(df: DataFrame, order: Iterable, report_date=None) -> DataFrame:
    """The rows with ``_report``, their report date, and ``_no``, their number in it by ``order``.

    No task orders a whole day; the rows stay cached until ``release``.
    """
    if "run_date" in df.columns:
        dated = df.withColumn("_report", F.date_sub("run_date", 1))
    else:
        dated = df.withColumn("_report", F.lit(report_date).cast("date"))
    return numbered(dated, ["_report"], order)


def to_cells(df: DataFrame, query: str, order: Iterable, report_date=None) -> DataFrame:
    """Cells ``report_date, query, row_no, column, value, row_metric, error``.

    Rows are numbered by ``order`` within their report date. A frame with ``run_date``
    (a backfill) is dated by it, otherwise ``report_date`` applies. ``row_metric`` is the
    row's metric in a long result and empty in a wide one. Rows from ``placed_rows`` keep
    their numbers.
    """
    placed = df if "_no" in df.columns else placed_rows(df, order, report_date)
    metric = F.col("metric") if "metric" in df.columns else F.lit("")
    columns = [f for f in df.schema.fields if f.name not in ("run_date", "_report", "_no")]
    cells = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), cell_text(F.col(f.name), f.dataType).alias("value"))
            for f in columns
        ]
    )
    return placed.select(
        F.col("_report").alias("report_date"),
        F.lit(query).alias("query"),
        F.col("_no").cast("int").alias("row_no"),
        F.inline(cells),
        metric.alias("row_metric"),
        F.lit(None).cast("string").alias("error"),
    )


def write_snapshot(cells: DataFrame, path: str, days: Iterable[date] = (), query: str | None = None, errors: Mapping[date, str] | None = None) -> str:
    """Store cells as a run of its own and publish it; returns the run's id.

    The run replaces what readers see of the (report date, query) pairs in ``cells``, and of
    ``query`` on each of ``days``, rows or not. Its folder is new and never touched again, and its
    manifest, with a line for each pair, is written last: until then, and for good if the job
    dies, readers see the runs before.
    """
    spark = cells.sparkSession
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    cells.write.partitionBy("report_date").parquet(f"{path}/cells/run_id={run}")
    counts = spark.read.schema(CELLS).parquet(f"{path}/cells/run_id={run}").groupBy("report_date", "query").agg(F.max("row_no").alias("n"))
    found = {(r["report_date"], r["query"]): r["n"] for r in counts.collect()}
    for day in days:
        found.setdefault((day, query), 0)
    _publish(spark, path, run, [(day, name, n, (errors or {}).get(day)) for (day, name), n in found.items()])
    return run


def _publish(spark: SparkSession, path: str, run: str, lines: list[tuple], status: str = "stored") -> None:
    named = ("report_date", "query", "n_rows", "error")
    now = time.time_ns()
    manifests.publish(spark, f"{path}/_runs", run, [{**dict(zip(named, line, strict=True)), "run_id": run, "status": status, "saved_at": now} for line in lines])


def _runs(spark: SparkSession, path: str) -> DataFrame:
    if not manifests.exists(spark, f"{path}/_runs"):
        return spark.createDataFrame([], RUNS)
    return spark.read.schema(RUNS).json(f"{path}/_runs")


def live_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run that counts for each report date and query: the newest that was stored whole."""
    stored = _runs(spark, path).where("status = 'stored'")
    return latest_per_key(stored, ["report_date", "query"], "saved_at", ["run_id", "n_rows"])


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The cells of the runs that count."""
    if not manifests.exists(spark, f"{path}/cells"):
        return spark.createDataFrame([], CELLS)
    cells = spark.read.schema(f"{CELLS}, run_id string").parquet(f"{path}/cells")
    keys = ["run_id", "report_date", "query"]
    return cells.join(live_runs(spark, path).select(*keys), keys, "left_semi").select(*CELL_COLUMNS)


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The cells of one published run, also of one that a later run has replaced."""
    if _runs(spark, path).where((F.col("run_id") == run_id) & (F.col("status") == "stored")).isEmpty():
        raise ValueError(f"no run {run_id} was stored")
    return spark.read.schema(CELLS).parquet(f"{path}/cells/run_id={run_id}").select(*CELL_COLUMNS)


def run_status(spark: SparkSession, path: str) -> DataFrame:
    """How the last run of each report and day ended; its cells are those of the last good run."""
    return latest_per_key(_runs(spark, path), ["report_date", "query"], "saved_at", ["status", "error"])


def store_report(
    spark: SparkSession, result: Callable[[], DataFrame], name: str, order: Iterable, days: list[date],
    path: str, max_rows: int | None = None,
) -> str | None:
    """Compute one report and store its cells; returns the error, if it has one.

    Whatever goes wrong is this report's own: it is logged, and the cells of earlier runs
    stay. A result over ``max_rows`` a day is stored in full and noted as the day's error.
    """
    try:
        report_date = days[0] if len(days) == 1 else None
        placed = placed_rows(result(), order, report_date)
        try:
            over = {}
            if max_rows is not None:
                for row in placed.groupBy("_report").agg(F.max("_no").alias("n")).where(F.col("n") > max_rows).collect():
                    over[row["_report"]] = f"result has {row['n']} rows a day, more than max_rows={max_rows}; aggregate further"
            write_snapshot(to_cells(placed, name, order), path, days, name, over)
            return next(iter(over.values()), None)
        finally:
            release(placed)
    except Exception as problem:  # noqa: BLE001 - any failure is isolated, that of a job too
        error = (str(problem).splitlines() or [type(problem).__name__])[0]
    _publish(spark, path, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", [(day, name, None, error) for day in days], "failed")
    return error


def snapshot_reports(
    spark: SparkSession,
    sources: Mapping[str, DataFrame],
    run_date: date,
    path: str,
    names: Iterable[str] | None = None,
    max_rows: int | None = None,
    last_report: date | None = None,
    at_once: int = 4,
) -> dict[str, str]:
    """Run reports for one date, or for all report days up to ``last_report``, and store
    their cells; returns the errors by report.

    Independent reports are submitted ``at_once`` at a time. One report's failure leaves
    the others, and the cells it stored before, alone.
    """
    from tideline.plans.registry import REPORTS, backfill, run_report

    first = run_date - timedelta(days=1)
    days = [first + timedelta(days=n) for n in range(((last_report or first) - first).days + 1)]

    def one(name: str) -> str | None:
        def result() -> DataFrame:
            if last_report is None:
                return run_report(spark, name, sources, run_date)
            return backfill(spark, name, sources, first, last_report)

        return store_report(spark, result, name, REPORTS[name].sort_keys(), days, path, max_rows)

    names = list(names or REPORTS)
    with ThreadPoolExecutor(at_once) as pool:
        found = dict(zip(names, pool.map(one, names), strict=True))
    return {name: error for name, error in found.items() if error}


PAYLOADS = "run_id string, report_date date, kind string, payload string, saved_at timestamp"


def save_payload(df: DataFrame, kind: str | None, path: str) -> None:
    """Append run payloads (``run_id, report_date, payload``) of one kind: input,
    context, report or validation; without ``kind`` the rows name theirs. The last one of a
    run and kind counts."""
    (
        df.select(
            "run_id",
            "report_date",
            (F.col("kind") if kind is None else F.lit(kind)).alias("kind"),
            "payload",
            F.current_timestamp().alias("saved_at"),
        )
        .write.mode("append")
        .partitionBy("report_date", "kind")
        .parquet(path)
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOADS).parquet(path)


def latest_payloads(payloads: DataFrame) -> DataFrame:
    """The last payload of each run and kind."""
    return latest_per_key(payloads, ["run_id", "kind"], "saved_at", ["report_date", "payload"])
