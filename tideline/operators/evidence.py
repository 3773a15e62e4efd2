"""Report documents and the check that every cited value exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT = (
    "struct<summary: string, insights: array<string>, anomalies: array<struct<"
    "metric: string, detail: string, investigation_plan: array<string>, "
    "evidence: array<struct<query: string, column: string, value: string, row_metric: string>>>>, "
    "failed_metrics: array<string>>"
)
CELL_KEY = ["report_date", "query", "column", "value", "row_metric"]


def parse_reports(documents: DataFrame, body: str = "body") -> DataFrame:
    """Documents with their body as a ``report`` struct; NULL when it is neither.

    The body is one object or an array whose first element counts. The leading character
    decides which parser applies, because a permissive parser answers the wrong shape
    with a struct of NULLs instead of NULL.
    """
    text = F.ltrim(F.col(body))
    wrapped = F.from_json(text, f"array<{REPORT}>")
    single = F.from_json(text, REPORT)
    report = F.when(F.startswith(text, F.lit("[")), F.try_element_at(wrapped, F.lit(1))).when(
        F.startswith(text, F.lit("{")), single
    )
    return documents.withColumn("report", report).drop(body)


def explode_evidence(parsed: DataFrame) -> DataFrame:
    """One row per cited value: ``run_id, report_date, anomaly_no, evidence_no, metric,
    query, column, value, row_metric``."""
    anomalies = parsed.select(
        "run_id", "report_date", F.posexplode("report.anomalies").alias("anomaly_no", "anomaly")
    )
    return anomalies.select(
        "run_id",
        "report_date",
        "anomaly_no",
        F.col("anomaly.metric").alias("metric"),
        F.posexplode("anomaly.evidence").alias("evidence_no", "cited"),
    ).select("run_id", "report_date", "anomaly_no", "evidence_no", "metric", "cited.*")


def judge_evidence(evidence: DataFrame, cells: DataFrame) -> DataFrame:
    """Each cited value with ``matched``.

    It must equal, character by character, a stored cell of that day's result of a query
    that did not fail. ``row_metric`` is part of the key: cells of a long result carry
    it, those of a wide one hold the empty string. Cells fold to distinct keys first, so
    a match never multiplies a citation.
    """
    return evidence.join(citable(cells), CELL_KEY, "left").withColumn(
        "matched", F.coalesce("found", F.lit(False))
    ).drop("found")


def citable(cells: DataFrame) -> DataFrame:
    """Distinct cell keys of results without an error, marked ``found``.

    Failed results are found by a fold, one row for each day and query, so the cells of a
    wide result never meet in one task.
    """
    failed = cells.where(F.col("error").isNotNull()).select("report_date", "query").distinct()
    good = cells.join(failed, ["report_date", "query"], "left_anti")
    return good.select(*CELL_KEY).distinct().withColumn("found", F.lit(True))


def evidence_failures(evidence: DataFrame, cells: DataFrame) -> DataFrame:
    """The citations without a matching cell."""
    return judge_evidence(evidence, cells).where(~F.col("matched")).drop("matched")


def reconcile(parsed: DataFrame, cells: DataFrame) -> DataFrame:
    """Per report: counts and whether it passes.

    It passes when its body parsed with insights and failed metrics (empty lists will do), the
    summary is not empty, every anomaly has a metric, a detail, a plan and evidence, and every
    citation matches.
    """

    def blank(items: Column) -> Column:
        return F.coalesce(F.size(items) == 0, F.lit(True))

    anomalies = F.coalesce(F.col("report.anomalies"), F.array().cast(_anomalies(parsed)))
    shape = parsed.select(
        "run_id",
        "report_date",
        F.struct(
            F.coalesce(
                F.col("report.insights").isNotNull() & F.col("report.failed_metrics").isNotNull(), F.lit(False)
            ).alias("parsed"),
            F.coalesce(F.length(F.trim("report.summary")) > 0, F.lit(False)).alias("summarised"),
            F.size(anomalies).cast("bigint").alias("anomalies"),
            F.size(
                F.filter(
                    anomalies,
                    lambda a: blank(a["investigation_plan"]) | blank(a["evidence"])
                    | a["metric"].isNull() | a["detail"].isNull(),
                )
            ).cast("bigint").alias("incomplete"),
        ).alias("shape"),
        F.explode_outer(F.flatten(F.transform(anomalies, lambda a: a["evidence"]))).alias("cited"),
    )
    # Documents without any citation keep one row with none.
    cited = shape.select("run_id", "report_date", "shape", "cited.*")
    judged = judge_evidence(cited, cells).groupBy("run_id").agg(
        F.max("shape").alias("shape"),
        F.count("query").alias("cited"),
        F.count(F.when(F.col("matched"), 1)).alias("matched"),
    )
    counts = judged.select("run_id", "shape.*", "cited", "matched")
    passed = (
        F.col("parsed")
        & F.col("summarised")
        & (F.col("incomplete") == 0)
        & (F.col("cited") == F.col("matched"))
    )
    return counts.withColumn("passed", passed)


def _anomalies(parsed: DataFrame):
    return parsed.schema["report"].dataType["anomalies"].dataType


def merge_failed_metrics(declared: DataFrame, results: DataFrame) -> DataFrame:
    """Failed metrics per run: those the report names, then queries that errored, each
    once and in order.

    ``declared`` is ``run_id, failed_metrics``; ``results`` is ``run_id, position, query,
    error``. Names fold to their first position before they are listed, so a list is as
    long as the query catalog, not as the log.
    """
    errored = (
        results.where(F.coalesce(F.length("error") > 0, F.lit(False)))
        .groupBy("run_id", "query")
        .agg(F.min("position").alias("position"))
        .groupBy("run_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "query"))).alias("e"))
        .select("run_id", F.col("e.query").alias("errored"))
    )
    empty = F.array().cast("array<string>")
    return declared.join(errored, "run_id", "full").select(
        "run_id",
        F.array_distinct(
            F.concat(F.coalesce("failed_metrics", empty), F.coalesce("errored", empty))
        ).alias("failed_metrics"),
    )
