"""Interaction log, report documents and run results derived from the sample tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.text import cell_text
from tideline.operators import feedback as fb
from tideline.plans.registry import REPORTS, backfill
from tideline.sources.sample import EventsWorld, World
from tideline.sources.snapshots import to_cells

CHANNEL = "C1"
FLAT = "main_kpi_flat"
FIRST_REPORT, LAST_REPORT = date(2024, 1, 15), date(2024, 1, 30)


def interaction_log(world: World) -> DataFrame:
    """Every conversation turn as a request body: ``body, received_at``.

    User turns are reviewer actions, assistant turns submit some other form, system turns
    are not JSON. Even conversations are form-encoded. One reviewer's client sends
    everything twice.
    """
    run, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    run_id = run.cast("string")
    event = F.concat_ws("-", F.lit("e"), run, turn)
    stamp = F.concat_ws(".", run, turn)
    user = F.struct(F.concat(F.lit("U"), (run % 7).cast("string")).alias("id"))
    positive = turn % 4 == 0
    pending = (run + turn) % 5 == 4
    action = (
        F.when(positive & (run % 5 == 4), fb.ACTION_REPLAY_NEXT)
        .when(positive, fb.ACTION_POSITIVE)
        .otherwise(fb.ACTION_CORRECTION)
    )
    block = F.to_json(
        F.struct(
            F.lit("block_actions").alias("type"),
            user.alias("user"),
            F.struct(F.lit(CHANNEL).alias("id")).alias("channel"),
            F.struct(stamp.alias("ts")).alias("message"),
            F.array(
                F.struct(action.alias("action_id"), run_id.alias("value"), event.alias("action_ts")),
                F.struct(F.lit("other").alias("action_id"), F.lit("0").alias("value"), F.lit("0").alias("action_ts")),
            ).alias("actions"),
        )
    )
    meta = F.to_json(F.struct(F.lit(CHANNEL).alias("channel_id"), stamp.alias("message_ts"), run_id.alias("run_id")))
    typed = F.create_map(
        F.lit(fb.BLOCK_CORRECTION),
        F.create_map(F.lit(fb.INPUT_CORRECTION), F.struct(F.col("text").alias("value"))),
    )
    form = F.to_json(
        F.struct(
            F.lit("view_submission").alias("type"),
            user.alias("user"),
            F.struct(
                event.alias("id"),
                F.when(role == "user", fb.CALLBACK_CORRECTION).otherwise("other").alias("callback_id"),
                meta.alias("private_metadata"),
                F.struct(typed.alias("values")).alias("state"),
            ).alias("view"),
        )
    )
    payload = (
        F.when(role == "system", F.col("text")).when((role == "user") & (positive | pending), block).otherwise(form)
    )
    encoded = F.concat(F.lit("payload="), F.url_encode(payload), F.lit("&token=t"))
    day = F.date_add(F.lit(date(2024, 1, 1)), (run % 30).cast("int")).cast("timestamp_ntz")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), turn.cast("int"), F.lit(0))
    log = world.table("conversations").select(
        F.when((run % 2 == 0) & (role != "system"), encoded).otherwise(payload).alias("body"),
        (day + minutes).alias("received_at"),
        (run % 7 == 0).alias("retried"),
    )
    later = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(5), F.lit(0))
    again = log.where("retried").withColumn("received_at", F.col("received_at") + later)
    return log.unionByName(again).drop("retried")


def flat_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backfill(spark, FLAT, EventsWorld(spark, sf_dir), FIRST_REPORT, LAST_REPORT)


def result_cells(results: DataFrame) -> DataFrame:
    """Stored cells of the results, and an error row on every eleventh of a month."""
    cells = to_cells(results, FLAT, REPORTS[FLAT].sort_keys())
    failed = cells.where(F.dayofmonth("report_date") % 11 == 0).select("report_date").distinct()
    errors = failed.select(
        "report_date",
        F.lit(FLAT).alias("query"),
        F.lit(0).alias("row_no"),
        F.lit("").alias("column"),
        F.lit("").alias("value"),
        F.lit("").alias("row_metric"),
        F.lit("timeout").alias("error"),
    )
    return cells.unionByName(errors)


def report_documents(results: DataFrame) -> DataFrame:
    """One report document per report date: ``run_id, report_date, body``.

    Each metric is an anomaly citing its value and z-score. By day of the month some
    documents misquote revenue, omit a row metric, lack a plan or come wrapped in a list.
    """
    types = {f.name: f.dataType for f in results.schema.fields}
    day = F.dayofmonth(F.date_sub("run_date", 1))

    def cited(column: str):
        text = cell_text(F.col(column), types[column])
        wrong = (F.col("metric") == "rev") & (day % 9 == 0)
        unlabelled = (F.col("metric") == "payers") & (day % 5 == 0)
        return F.struct(
            F.lit(FLAT).alias("query"),
            F.lit(column).alias("column"),
            F.when(wrong, F.concat(text, F.lit("1"))).otherwise(text).alias("value"),
            F.when(unlabelled, "").otherwise(F.col("metric")).alias("row_metric"),
        )

    plan = F.when((F.col("metric") == "spenders") & (day % 7 == 0), F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("split "), "metric"))
    )
    anomaly = F.struct(
        "metric",
        F.concat("metric", F.lit(" moved")).alias("detail"),
        plan.alias("investigation_plan"),
        F.array(cited("value"), cited("z_score_30d")).alias("evidence"),
    )
    per_day = results.groupBy(F.date_sub("run_date", 1).alias("report_date")).agg(
        F.array_sort(F.collect_list(anomaly)).alias("anomalies")
    )
    body = F.to_json(
        F.struct(
            F.concat(F.lit("day "), F.col("report_date").cast("string")).alias("summary"),
            F.array(F.lit("one"), F.lit("two")).alias("insights"),
            "anomalies",
            F.array().cast("array<string>").alias("failed_metrics"),
        )
    )
    wrapped = F.dayofmonth("report_date") % 4 == 0
    return per_day.select(
        F.date_format("report_date", "yyyyMMdd").alias("run_id"),
        "report_date",
        F.when(wrapped, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("body"),
    )


def thread_log(world: World) -> DataFrame:
    """Every conversation as a thread below a posted report: ``body, received_at``.

    User turns reply, assistant turns are what a bot says, system turns open a thread of their own.
    Every seventh conversation's events come twice.
    """
    run, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    channel = F.concat(F.lit("C"), (run % 3).cast("string"))
    root, own = F.concat(run.cast("string"), F.lit(".0")), F.concat_ws(".", run, turn + 1)
    event = F.struct(
        F.lit("message").alias("type"),
        F.when(role == "assistant", "B1").alias("bot_id"),
        F.concat(F.lit("U"), (run % 7).cast("string")).alias("user"),
        channel.alias("channel"),
        F.col("text"),
        F.when(role == "system", root).otherwise(own).alias("ts"),
        root.alias("thread_ts"),
    )
    body = F.to_json(F.struct(F.lit("event_callback").alias("type"), F.concat_ws("-", F.lit("Ev"), run, turn).alias("event_id"), event.alias("event")))
    day = F.date_add(F.lit(date(2024, 1, 1)), (run % 30).cast("int")).cast("timestamp_ntz")
    log = world.table("conversations").select(
        body.alias("body"), (day + F.make_dt_interval(F.lit(0), F.lit(0), turn.cast("int"), F.lit(0))).alias("received_at"), (run % 7 == 0).alias("retried")
    )
    later = F.make_dt_interval(F.lit(40), F.lit(0), F.lit(0), F.lit(0))
    return log.unionByName(log.where("retried").withColumn("received_at", F.col("received_at") + later)).drop("retried")


def posted_reports(world: World) -> DataFrame:
    """The message of each conversation's report; every tenth was never posted."""
    run = F.col("conv_id")
    posted = world.table("conversations").where(run % 10 != 9).select("conv_id").distinct()
    return posted.select(F.concat(F.lit("C"), (run % 3).cast("string")).alias("channel_id"), F.concat(run.cast("string"), F.lit(".0")).alias("message_ts"), run.cast("string").alias("run_id"))


def review_log(world: World) -> DataFrame:
    """Up to six review events of each correction, out of order, some illegal, every fourth sent twice."""
    item = F.col("id")
    corrections = world["agent_feedback"].where("feedback_type = 'correction'")
    each = corrections.select(item.alias("feedback_id"), "run_id", F.explode(F.sequence(F.lit(0), (item % 7).cast("int") - 1 + (item % 7 == 0).cast("int"))).alias("j"))
    each = each.where(F.col("feedback_id") % 7 > 0)
    number, j = F.col("feedback_id"), F.col("j")
    action = F.element_at(F.array(*map(F.lit, ("draft", "approve", "reject", "reopen"))), ((number + j * j) % 4 + 1).cast("int"))
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), ((j * 37 + number) % 50).cast("int"), F.lit(0))
    log = each.select(
        "feedback_id", (number * 100 + j).alias("event_id"), (F.lit(date(2024, 2, 1)).cast("timestamp_ntz") + minutes).alias("at"), action.alias("action"),
        (F.col("run_id") + j).alias("guideline_id"),
    )
    return log.unionByName(log.where(F.col("event_id") % 4 == 0))
