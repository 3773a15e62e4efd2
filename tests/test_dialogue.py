import json
from datetime import datetime
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from tests.conftest import day, rows
from tideline.operators.evidence import (
    evidence_failures, explode_evidence, merge_failed_metrics, parse_reports, reconcile,
)
from tideline.operators.feedback import feedback_summary, parse_interactions, replay_next_date, review_gate
from tideline.operators.knowledge import (
    active_guidelines, budgeted_selection, normalise_rules, resolve_labels, seed_if_empty,
)
from tideline.operators.ordered import release
from tideline.sources.snapshots import CELLS


def action(action_id, run="r1", event="e1"):
    return {
        "type": "block_actions", "user": {"id": "U1"}, "channel": {"id": "C1"}, "message": {"ts": "1.2"},
        "actions": [{"action_id": action_id, "value": run, "action_ts": event}, {"action_id": "replay_next", "value": "x", "action_ts": "y"}],
    }


def submission(values, callback="correction_modal", meta='{"run_id":"r1","channel_id":"C1","message_ts":"1.2"}'):
    return {"type": "view_submission", "user": {"id": "U1"}, "view": {"id": "V1", "callback_id": callback, "private_metadata": meta, "state": {"values": values}}}


TYPED = {"correction_input_block": {"correction_text": {"value": "a & b = 100% 中"}}}


@pytest.mark.parametrize("form", [True, False])
@pytest.mark.parametrize(
    "payload, kind, event, run, text",
    [
        (action("feedback_positive"), "positive", "e1", "r1", None),
        (action("feedback_correction"), "correction_open", "e1", "r1", None),
        (action("replay_next"), "replay_next", "e1", "r1", None),
        (action("something_else"), "ignored", None, None, None),
        ({"type": "block_actions", "actions": []}, "ignored", None, None, None),
        (submission(TYPED), "correction", "V1", "r1", "a & b = 100% 中"),
        (submission({}), "correction", "V1", "r1", ""),
        (submission(TYPED, meta="broken"), "correction", "V1", None, "a & b = 100% 中"),
        (submission(TYPED, callback="other"), "ignored", None, None, None),
        ({"type": "shortcut"}, "ignored", None, None, None),
    ],
)
def test_parse_interactions(spark, form, payload, kind, event, run, text):
    body = json.dumps(payload, ensure_ascii=False)
    body = f"payload={quote_plus(body)}" if form else body
    got = parse_interactions(spark.createDataFrame([(body,)], "body string")).first()
    assert (got.kind, got.event_id, got.run_id, got.raw_text) == (kind, event, run, text)


def test_body_that_is_not_json(spark):
    assert parse_interactions(spark.createDataFrame([("hello",)], "body string")).first().kind == "invalid"


FEEDBACK = "run_id long, feedback_type string, state string, derived_guideline_id long"


@pytest.mark.parametrize(
    "given, is_open",
    [
        ([("correction", "rejected", None)], False),
        ([("positive", "recorded", None), ("correction", "pending", None)], False),
        ([("correction", "incorporated", 1)], True),
        ([("correction", "incorporated", 99)], False),
        ([("positive", "recorded", None), ("correction", "rejected", None)], True),
        ([("positive", "recorded", None), ("correction", None, None)], False),
    ],
)
def test_review_gate(spark, given, is_open):
    feedback = spark.createDataFrame([(7, *g) for g in given], FEEDBACK)
    catalog = spark.createDataFrame([(1,)], "id long")
    assert rows(review_gate(feedback, catalog), "run_id", "open") == [(7, is_open)]


def test_replay_stops_at_the_first_blocked_day(spark):
    sessions = spark.createDataFrame([(1, day(0), day(3)), (2, day(0), day(1)), (3, day(0), day(2))], "session_id int, from_date date, to_date date")
    runs = spark.createDataFrame(
        [(1, day(0), True), (1, day(1), False), (1, day(2), True), (2, day(0), True), (2, day(1), True), (3, day(0), True)],
        "session_id int, report_date date, open boolean",
    )
    assert rows(replay_next_date(sessions, runs)) == [(1, day(1), "waiting"), (2, None, "complete"), (3, day(1), "waiting")]


def test_feedback_summary_keeps_dangling_links(spark):
    feedback = spark.createDataFrame([("correction", datetime(2024, 1, 1, 5), 1), ("correction", datetime(2024, 1, 1, 6), 42)], "feedback_type string, created_at timestamp_ntz, derived_guideline_id long")
    rules = spark.createDataFrame([(1, "context")], "id long, category string")
    assert rows(feedback_summary(feedback, rules)) == [("correction", day(0), "context", 1, 1), ("correction", day(0), None, 1, 0)]


RULES = "id long, category string, rule_text string, is_active boolean, source string"


def test_active_guidelines(spark):
    data = [(2, "b", "x", True, None), (1, "b", "y", True, "s"), (3, "a", "z", True, None), (4, "a", "q", False, None), (5, "a", "n", None, None)]
    got = active_guidelines(spark.createDataFrame(data, RULES)).collect()
    assert [(r.id, r.source) for r in got] == [(3, "manual"), (1, "s"), (2, "manual")]


def test_seed_only_an_empty_table(spark):
    seed = spark.createDataFrame([("a",), ("b",)], "category string")
    full = spark.createDataFrame([(1, "b", "x", True, None)], RULES)
    assert seed_if_empty(full, seed).count() == 0
    assert seed_if_empty(full.where("id = 9"), seed).count() == 2


def test_normalise_rules(spark):
    data = [(" context ", " a \n"), ("nonsense", "b"), (None, "c"), ("formatting", " 　\t")]
    got = normalise_rules(spark.createDataFrame(data, "category string, rule_text string"))
    assert rows(got) == [("context", "a"), ("context", "b"), ("context", "c")]


def test_budget_accounts_for_every_item(spark):
    data = [("p", i, "中" * 10) for i in range(20)] + [("p", -1, "x" * 241), ("p", -2, "a\nb"), ("q", 1, "z"), (None, 1, "n")]
    items = spark.createDataFrame(data, "product string, id int, text string")
    judged = budgeted_selection(items, "text", ["id"], ["product"], max_items=12, max_bytes=95, max_chars=240)
    assert rows(judged.where("status = 'kept'"), "product", "id") == [("p", 0), ("p", 1), ("p", 2), ("q", 1), (None, 1)]
    assert rows(judged.groupBy("status").count()) == [
        ("kept", 5), ("over bytes", 9), ("over items", 8), ("several lines", 1), ("too long", 1),
    ]
    assert budgeted_selection(items, "text", ["id", "product"], max_items=12, max_bytes=8000, max_chars=240).where("status = 'kept'").count() == 12


def test_no_task_ranks_a_whole_group(spark):
    items = spark.range(4000).select(F.lit("p").alias("product"), F.col("id").cast("int"), F.lit("x").alias("text"))
    judged = budgeted_selection(items, "text", ["id"], ["product"], max_items=12, max_bytes=8000, max_chars=240)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(" in plan and "WindowGroupLimit" not in plan
    assert judged.where("status = 'over items'").count() == 3988 and judged.where("status = 'kept'").count() == 12
    release(judged)


def test_repeated_items_are_each_counted_once(spark):
    items = spark.createDataFrame([(1, "a", None), (1, "a", None), (1, "a", None), (2, "b", None), (3, "c\nd", "x")], "id int, text string, product string")
    judged = budgeted_selection(items, "text", ["id"], ["product"], max_items=3, max_bytes=2, max_chars=9)
    assert rows(judged, "id", "position", "bytes_so_far", "status") == [
        (1, 1, 1, "kept"), (1, 2, 2, "kept"), (1, 3, 3, "over bytes"), (2, None, None, "over items"), (3, None, None, "several lines")
    ]


def test_labels(spark):
    data = [("main_kpi", " Start ", []), ("das_day", None, ["main_kpi", "no_such", "main_kpi"])]
    got = resolve_labels(spark.createDataFrame(data, "name string, description string, supports array<string>"))
    assert rows(got) == [("das_day", "das day", "Start、no such、Start"), ("main_kpi", "Start", "")]


def document(**change):
    cited = {"query": "q", "column": "value", "value": "2.0000", "row_metric": "dau"}
    cited |= change.pop("cited", {})
    anomaly = {"metric": "dau", "detail": "d", "investigation_plan": ["look"], "evidence": [cited]}
    anomaly |= change.pop("anomaly", {})
    return {"summary": "s", "insights": [], "anomalies": [anomaly], "failed_metrics": []} | change


def cells(spark):
    good = [(day(0), "q", 1, "value", "2.0000", "dau", None), (day(0), "w", 1, "n", "5", "", None), (day(0), "bad", 1, "n", "5", "", None), (day(0), "bad", 0, "", "", "", "timeout")]
    return spark.createDataFrame(good, CELLS)


@pytest.mark.parametrize(
    "body, passes",
    [
        (json.dumps(document()), True),
        (json.dumps([document(), document(summary="")]), True),
        (json.dumps(document(anomalies=[])), True),
        (json.dumps(document(cited={"value": "2.0"})), False),
        (json.dumps(document(cited={"row_metric": ""})), False),
        (json.dumps(document(cited={"query": "w", "column": "n", "value": "5", "row_metric": ""})), True),
        (json.dumps(document(cited={"query": "bad", "column": "n", "value": "5", "row_metric": ""})), False),
        (json.dumps(document(anomaly={"investigation_plan": []})), False),
        (json.dumps(document(anomaly={"evidence": []})), False),
        (json.dumps(document(summary=" ")), False),
        (json.dumps(document(insights=None)), False),
        (json.dumps(document(failed_metrics=None)), False),
        (json.dumps(document(anomaly={"metric": None})), False),
        (json.dumps(document(anomaly={"detail": None})), False),
        ("[]", False),
        ("not json", False),
    ],
)
def test_reconcile(spark, body, passes):
    parsed = parse_reports(spark.createDataFrame([("r", day(0), body)], "run_id string, report_date date, body string"))
    assert rows(reconcile(parsed, cells(spark)), "run_id", "passed") == [("r", passes)]


def test_duplicate_cells_do_not_multiply_citations(spark):
    parsed = parse_reports(spark.createDataFrame([("r", day(0), json.dumps(document()))], "run_id string, report_date date, body string"))
    twice = cells(spark).union(cells(spark))
    assert explode_evidence(parsed).count() == 1
    assert rows(reconcile(parsed, twice), "cited", "matched") == [(1, 1)]
    assert evidence_failures(explode_evidence(parsed), twice).count() == 0


def test_merge_failed_metrics(spark):
    declared = spark.createDataFrame([(1, ["b", "a", "b"]), (2, [])], "run_id int, failed_metrics array<string>")
    results = spark.createDataFrame([(1, 0, "c", "boom"), (1, 1, "a", "boom"), (1, 2, "d", ""), (3, 0, "z", "boom")], "run_id int, position int, query string, error string")
    got = {r.run_id: r.failed_metrics for r in merge_failed_metrics(declared, results).collect()}
    assert got == {1: ["b", "a", "c"], 2: [], 3: ["z"]}


def test_sample_documents_cover_every_outcome(spark):
    from tests.conftest import SAMPLE
    from tideline.sources import dialogue

    results = dialogue.flat_results(spark, SAMPLE)
    got = reconcile(parse_reports(dialogue.report_documents(results)), dialogue.result_cells(results))
    assert got.count() == 16 and got.where("passed").count() > 5 and got.where("not passed").count() > 2
    assert got.where(~F.col("parsed")).count() == 0
