"""Snapshots, guidelines, feedback, evidence and the ingest stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.checks.relations import EVENTS, run_dates, statement
from tideline.checks.report_sql import COMPARED, main_kpi_flat
from tideline.checks.reports import QUERIES as REPORT_QUERIES
from tideline.checks.reports import ORACLE as REPORT_ORACLE
from tideline.operators import evidence, feedback, knowledge
from tideline.sources import dialogue
from tideline.sources.sample import EventsWorld, OrdersWorld
from tideline.sources.snapshots import budget_status, to_cells
from tideline.streaming import ingest

QUERIES, ORACLE = {}, {}


def check(name: str, ctes: dict, final: str):
    def register(query):
        QUERIES[name] = query
        ORACLE[name] = statement(EVENTS, ctes, final)
        return query

    return register


# --- snapshots -----------------------------------------------------------------------

RUNS = {"runs": run_dates("2024-01-16", "2024-01-31")}
_flat_ctes, _ = main_kpi_flat()
FLAT_RESULT = RUNS | _flat_ctes
SHOWN = ["dt", "metric", "value", "data_available", *COMPARED.split(", ")]


def _cell(column: str) -> str:
    if column == "dt":
        return "strftime(dt, '%Y-%m-%dT00:00:00Z')"
    if column in ("metric", "data_available"):
        return f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(CAST({column} AS DECIMAL(38,4)) AS VARCHAR), 'NULL')"


def cells_of(placed: str) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST(run - 1 AS DATE) AS report_date, 'main_kpi_flat' AS query, CAST(row_no AS INTEGER) AS row_no, "
        f"'{c}' AS \"column\", {_cell(c)} AS value, metric AS row_metric, CAST(NULL AS VARCHAR) AS error FROM {placed}"
        for c in SHOWN
    )


CELLS = {
    "placed": "SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric) AS row_no FROM compared",
    "good_cells": cells_of("placed"),
    "cells": """
SELECT * FROM good_cells
UNION ALL SELECT DISTINCT report_date, query, 0, '', '', '', 'timeout' FROM good_cells WHERE day(report_date) % 11 = 0""",
}


@check("result_cells", FLAT_RESULT | CELLS, "SELECT * FROM good_cells")
def _(spark, d):
    return to_cells(dialogue.flat_results(spark, d), dialogue.FLAT, [F.col("metric")])


def _budget(spark, d):
    results = {
        "lifecycle_mrr_tier": REPORT_QUERIES["rpt_lifecycle_mrr_tier"](spark, d),
        "main_kpi_slice": REPORT_QUERIES["rpt_main_kpi_slice"](spark, d),
        "dailyactives": OrdersWorld(spark, d)["dailyactives"],
    }
    rows = [budget_status(df, 200).select(F.lit(n).alias("result"), "*") for n, df in results.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES["row_budget_guard"] = _budget
ORACLE["row_budget_guard"] = " UNION ALL ".join(
    f"SELECT '{name}' AS result, count(*) AS rows_seen, count(*) <= 200 AS within_budget FROM ({sql})"
    for name, sql in {
        "lifecycle_mrr_tier": REPORT_ORACLE["rpt_lifecycle_mrr_tier"],
        "main_kpi_slice": REPORT_ORACLE["rpt_main_kpi_slice"],
        "dailyactives": "SELECT DISTINCT o_custkey, o_orderdate FROM orders",
    }.items()
)


# --- guidelines ----------------------------------------------------------------------


@check("active_guidelines", {}, """
SELECT id, category, rule_text, coalesce(source, 'manual') AS source FROM guidelines WHERE is_active""")
def _(spark, d):
    return knowledge.active_guidelines(EventsWorld(spark, d)["agent_guidelines"])


@check("seed_if_empty", {"seed": "SELECT DISTINCT category, 'default for ' || category AS rule_text FROM guidelines"}, """
SELECT 'filled' AS target, * FROM seed WHERE NOT EXISTS (SELECT 1 FROM guidelines WHERE is_active)
UNION ALL SELECT 'empty', * FROM seed WHERE NOT EXISTS (SELECT 1 FROM guidelines WHERE category = 'none')""")
def _(spark, d):
    rules = EventsWorld(spark, d)["agent_guidelines"]
    seed = rules.select("category").distinct().withColumn("rule_text", F.concat(F.lit("default for "), "category"))
    filled = knowledge.seed_if_empty(rules.where("is_active"), seed)
    empty = knowledge.seed_if_empty(rules.where(F.col("category") == "none"), seed)
    return filled.select(F.lit("filled").alias("target"), "*").union(empty.select(F.lit("empty").alias("target"), "*"))


@check("normalise_rules", {}, """
SELECT d.doc_id, CASE lang WHEN 'en' THEN 'metric_logic' WHEN 'de' THEN 'formatting' ELSE 'context' END AS category,
       trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(12288)) AS rule_text
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE coalesce(quality, 1) <> 0
  AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(12288)) <> ''""")
def _(spark, d):
    world = EventsWorld(spark, d)
    lang = F.col("lang")
    drafts = world.table("documents").join(world.table("labels"), "doc_id", "left").select(
        "doc_id",
        F.when(lang == "en", "  metric_logic\t").when(lang == "de", "formatting\n").when(lang == "es", "other")
        .otherwise("").alias("category"),
        F.when(F.col("quality") == 0, "  \n").otherwise(F.concat(F.lit(" \n"), "text", F.lit(" 　"))).alias("rule_text"),
    )
    return knowledge.normalise_rules(drafts)


@check("budgeted_selection", {
    "fits": "SELECT * FROM documents WHERE length(text) <= 240 AND NOT contains(text, chr(10))",
    "placed": """
SELECT lang, doc_id, row_number() OVER w AS position, sum(strlen(text)) OVER w AS bytes_so_far
FROM fits WINDOW w AS (PARTITION BY lang ORDER BY source, doc_id ROWS UNBOUNDED PRECEDING)""",
}, """
SELECT d.lang, d.doc_id, CAST(CASE WHEN position <= 12 THEN position END AS INTEGER) AS position,
       CAST(CASE WHEN position <= 12 THEN bytes_so_far END AS BIGINT) AS bytes_so_far,
       CASE WHEN length(text) > 240 THEN 'too long' WHEN contains(text, chr(10)) THEN 'several lines'
            WHEN position > 12 THEN 'over items' WHEN bytes_so_far > 900 THEN 'over bytes' ELSE 'kept' END AS status
FROM documents d LEFT JOIN placed p ON p.doc_id = d.doc_id""")
def _(spark, d):
    items = EventsWorld(spark, d).table("documents").select("lang", "source", "doc_id", "text")
    judged = knowledge.budgeted_selection(
        items, "text", ["source", "doc_id"], ["lang"], max_items=12, max_bytes=900, max_chars=240
    )
    return judged.select("lang", "doc_id", "position", "bytes_so_far", "status")


@check("resolve_labels", {
    "entry": """
SELECT c_custkey AS k, replace(c_name, '#', '_') AS name,
       CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN '  '
            ELSE ' ' || c_mktsegment || ' ' || c_custkey || ' ' END AS description FROM customer""",
    "labels_of": """
SELECT k, name, CASE WHEN trim(coalesce(description, '')) = '' THEN replace(name, '_', ' ')
            ELSE trim(description) END AS label FROM entry""",
}, """
SELECT a.name, a.label, coalesce(b.label, 'Customer ' || lpad(CAST(a.k + 1 AS VARCHAR), 9, '0'))
       || '、daily total、' || z.label AS supports_label
FROM labels_of a LEFT JOIN labels_of b ON b.k = a.k + 1 JOIN labels_of z ON z.k = 0""")
def _(spark, d):
    segment, key = F.col("c_mktsegment"), F.col("c_custkey")

    def named(k):
        return F.concat(F.lit("Customer_"), F.lpad(k.cast("string"), 9, "0"))

    catalog = EventsWorld(spark, d).table("customer").select(
        F.replace("c_name", F.lit("#"), F.lit("_")).alias("name"),
        F.when(segment == "BUILDING", None).when(segment == "MACHINERY", "  ")
        .otherwise(F.concat(F.lit(" "), segment, F.lit(" "), key.cast("string"), F.lit(" "))).alias("description"),
        F.array(named(key + 1), F.lit("daily_total"), named(F.lit(0))).alias("supports"),
    )
    return knowledge.resolve_labels(catalog)


# --- feedback ------------------------------------------------------------------------

PARSED = """
SELECT received_at, kind, CASE WHEN acted THEN event END AS event_id, CASE WHEN acted THEN run END AS run_id,
       CASE WHEN acted THEN who END AS user_id, CASE WHEN acted THEN 'C1' END AS channel_id,
       CASE WHEN acted THEN stamp END AS message_ts, CASE WHEN kind = 'correction' THEN text END AS raw_text
FROM (
  SELECT *, kind NOT IN ('ignored', 'invalid') AS acted FROM (
    SELECT CAST(conv_id AS VARCHAR) AS run, 'e-' || conv_id || '-' || turn AS event, conv_id || '.' || turn AS stamp,
           'U' || (conv_id % 7) AS who, text, conv_id,
           DATE '2024-01-01' + to_days(CAST(conv_id % 30 AS INTEGER)) + to_minutes(turn) AS received_at,
           CASE role WHEN 'system' THEN 'invalid' WHEN 'assistant' THEN 'ignored' ELSE
             CASE WHEN turn % 4 = 0 AND conv_id % 5 = 4 THEN 'replay_next' WHEN turn % 4 = 0 THEN 'positive'
                  WHEN (conv_id + turn) % 5 = 4 THEN 'correction_open' ELSE 'correction' END END AS kind
    FROM conversations))
"""
LOG = {"once": PARSED}
LOG["log"] = """
SELECT * FROM once UNION ALL
SELECT received_at + INTERVAL 5 MINUTE AS received_at, kind, event_id, run_id, user_id, channel_id, message_ts, raw_text
FROM (""" + PARSED.replace("FROM conversations", "FROM conversations WHERE conv_id % 7 = 0") + ")"


@check("parse_interactions", LOG, "SELECT * FROM log")
def _(spark, d):
    return feedback.parse_interactions(dialogue.interaction_log(EventsWorld(spark, d)))


GATE = {
    "gate": """
SELECT run_id, count(*) FILTER (WHERE feedback_type = 'positive') AS positives,
       count(*) FILTER (WHERE state = 'incorporated') AS incorporated,
       count(*) FILTER (WHERE state = 'rejected') AS rejected,
       count(*) FILTER (WHERE state = 'pending') AS unresolved,
       count(DISTINCT derived_guideline_id) FILTER (
         WHERE derived_guideline_id NOT IN (SELECT id FROM guidelines WHERE is_active)) AS unpublished
FROM feedback GROUP BY run_id""",
    "judged": "SELECT *, positives + incorporated >= 1 AND unresolved = 0 AND unpublished = 0 AS open FROM gate",
}


def _gate(world):
    in_use = world["agent_guidelines"].where("is_active")
    return feedback.review_gate(world["agent_feedback"], in_use)


@check("review_gate", GATE, """
SELECT run_id, CAST(positives AS BIGINT) AS positives, CAST(incorporated AS BIGINT) AS incorporated,
       CAST(rejected AS BIGINT) AS rejected, CAST(unresolved AS BIGINT) AS unresolved, unpublished, open FROM judged""")
def _(spark, d):
    return _gate(EventsWorld(spark, d))


@check("replay_next_date", GATE | {
    "days_of": "SELECT run_id // 10 AS session_id, CAST(DATE '2024-01-01' + CAST(run_id % 10 AS INTEGER) AS DATE) AS report_date, open FROM judged",
    "span": "SELECT session_id, min(report_date) AS a, max(report_date) AS b FROM days_of GROUP BY ALL",
    "planned": "SELECT session_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS report_date FROM span",
    "next_of": """
SELECT p.session_id, min(p.report_date) FILTER (WHERE NOT coalesce(open, false)) AS next_date
FROM planned p LEFT JOIN days_of d ON d.session_id = p.session_id AND d.report_date = p.report_date GROUP BY ALL""",
}, "SELECT *, CASE WHEN next_date IS NULL THEN 'complete' ELSE 'waiting' END AS status FROM next_of")
def _(spark, d):
    from datetime import date

    runs = _gate(EventsWorld(spark, d)).select(
        F.floor(F.col("run_id") / 10).alias("session_id"),
        F.date_add(F.lit(date(2024, 1, 1)), (F.col("run_id") % 10).cast("int")).alias("report_date"),
        "open",
    )
    sessions = runs.groupBy("session_id").agg(
        F.min("report_date").alias("from_date"), F.max("report_date").alias("to_date")
    )
    return feedback.replay_next_date(sessions, runs)


@check("feedback_summary", {}, """
SELECT feedback_type, created_on, category, count(*) AS feedback, count(category) AS linked
FROM feedback f LEFT JOIN guidelines g ON g.id = f.derived_guideline_id GROUP BY ALL""")
def _(spark, d):
    world = EventsWorld(spark, d)
    return feedback.feedback_summary(world["agent_feedback"], world["agent_guidelines"])


# --- evidence ------------------------------------------------------------------------


def _cited(column: str, no: int) -> str:
    text = _cell(column)
    return f"""
SELECT strftime(run - 1, '%Y%m%d') AS run_id, CAST(run - 1 AS DATE) AS report_date, anomaly_no, {no} AS evidence_no, metric,
       'main_kpi_flat' AS query, '{column}' AS "column",
       {text} || CASE WHEN metric = 'rev' AND day(run - 1) % 9 = 0 THEN '1' ELSE '' END AS value,
       CASE WHEN metric = 'payers' AND day(run - 1) % 5 = 0 THEN '' ELSE metric END AS row_metric
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY metric) - 1 AS INTEGER) AS anomaly_no FROM compared)"""


EVIDENCE = FLAT_RESULT | {"cited": _cited("value", 0) + " UNION ALL " + _cited("z_score_30d", 1)}
JUDGED = EVIDENCE | CELLS | {
    "marked": """
SELECT c.*, EXISTS (SELECT 1 FROM cells k WHERE k.report_date = c.report_date AND k.query = c.query
  AND k."column" = c."column" AND k.value = c.value AND k.row_metric = c.row_metric)
  AND NOT EXISTS (SELECT 1 FROM cells k WHERE k.report_date = c.report_date AND k.query = c.query
  AND k.error IS NOT NULL) AS matched FROM cited c""",
}


def _documents(spark, d):
    results = dialogue.flat_results(spark, d)
    return evidence.parse_reports(dialogue.report_documents(results)), dialogue.result_cells(results)


@check("explode_report_evidence", EVIDENCE, "SELECT * FROM cited")
def _(spark, d):
    parsed, _cells = _documents(spark, d)
    return evidence.explode_evidence(parsed)


@check("evidence_failures", JUDGED, "SELECT * EXCLUDE (matched) FROM marked WHERE NOT matched")
def _(spark, d):
    parsed, cells = _documents(spark, d)
    return evidence.evidence_failures(evidence.explode_evidence(parsed), cells)


@check("reconcile_evidence", JUDGED, """
SELECT run_id, true AS parsed, true AS summarised, count(DISTINCT anomaly_no) AS anomalies,
       count(DISTINCT anomaly_no) FILTER (WHERE metric = 'spenders' AND day(report_date) % 7 = 0) AS incomplete,
       count(*) AS cited, count(*) FILTER (WHERE matched) AS matched,
       bool_and(matched AND NOT (metric = 'spenders' AND day(report_date) % 7 = 0)) AS passed
FROM marked GROUP BY run_id""")
def _(spark, d):
    return evidence.reconcile(*_documents(spark, d))


@check("merge_failed_metrics", {
    "named": """
SELECT conv_id AS run_id, turn, role || '_' || (turn % 3) AS query, length(text) % 5 = 0 AS declared,
       length(text) % 3 = 0 AS errored FROM conversations""",
    "listed": """
SELECT run_id, query, min(spot) AS spot FROM (
  SELECT run_id, query, turn AS spot FROM named WHERE declared
  UNION ALL SELECT run_id, query, 1000000 + turn FROM named WHERE errored) GROUP BY ALL""",
}, """
SELECT n.run_id, coalesce(string_agg(l.query, '|' ORDER BY spot), '') AS failed_metrics
FROM (SELECT DISTINCT run_id FROM named) n LEFT JOIN listed l ON l.run_id = n.run_id GROUP BY n.run_id""")
def _(spark, d):
    named = EventsWorld(spark, d).table("conversations").select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("position"),
        F.concat("role", F.lit("_"), (F.col("turn") % 3).cast("string")).alias("query"),
        (F.length("text") % 5 == 0).alias("declared"),
        F.when(F.length("text") % 3 == 0, "timeout").otherwise("").alias("error"),
    )
    said = F.array_sort(F.collect_list(F.when(F.col("declared"), F.struct("position", "query"))))
    declared = named.groupBy("run_id").agg(said.alias("s")).select("run_id", F.col("s.query").alias("failed_metrics"))
    merged = evidence.merge_failed_metrics(declared, named.select("run_id", "position", "query", "error"))
    return merged.select("run_id", F.array_join("failed_metrics", "|").alias("failed_metrics"))


# --- streaming -----------------------------------------------------------------------

STREAMED = """
SELECT DISTINCT event_id, kind, run_id, user_id, message_ts, raw_text,
       CASE kind WHEN 'positive' THEN 'recorded' ELSE 'pending' END AS status
FROM log WHERE kind IN ('positive', 'correction')"""
STREAM_COLUMNS = ["event_id", "kind", "run_id", "user_id", "message_ts", "raw_text", "status"]


def _log_stream(spark, d):
    """The interaction log as a stream of several files."""
    source = ingest.work_dir(spark, "interaction-log")
    log = dialogue.interaction_log(EventsWorld(spark, d))
    log.repartitionByRange(4, "received_at").write.parquet(source)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(source)


@check("stream_dedupe_feedback", LOG, STREAMED)
def _(spark, d):
    sink = ingest.work_dir(spark, "feedback")
    stream = _log_stream(spark, d)
    query = ingest.ingest_feedback(stream, sink, ingest.work_dir(spark, "progress"), available_now=True)
    query.awaitTermination()
    return spark.read.parquet(sink).select(*STREAM_COLUMNS)


@check("stream_watermark_dedupe", LOG, STREAMED)
def _(spark, d):
    sink = ingest.work_dir(spark, "feedback")
    query = ingest.ingest_recent(_log_stream(spark, d), sink, ingest.work_dir(spark, "progress"), days=60, available_now=True)
    query.awaitTermination()
    return spark.read.parquet(sink).select(*STREAM_COLUMNS)
