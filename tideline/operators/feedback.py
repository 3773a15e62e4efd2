"""Reviewer feedback: parsing the interaction log, review gate, replay progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import form_value

# Identifiers inside the interaction payload.
ACTION_REPLAY_NEXT = "replay_next"
ACTION_POSITIVE = "feedback_positive"
ACTION_CORRECTION = "feedback_correction"
CALLBACK_CORRECTION = "correction_modal"
BLOCK_CORRECTION = "correction_input_block"
INPUT_CORRECTION = "correction_text"

PAYLOAD = (
    "type string, trigger_id string, user struct<id: string>, channel struct<id: string>, "
    "message struct<ts: string>, "
    "actions array<struct<action_id: string, value: string, action_ts: string>>, "
    "view struct<id: string, callback_id: string, private_metadata: string, "
    "state: struct<values: map<string, map<string, struct<value: string>>>>>, "
    "event_id string, event struct<type: string, subtype: string, bot_id: string, user: string, channel: string, "
    "text: string, ts: string, thread_ts: string>"
)
METADATA = "map<string, string>"


def parse_interactions(log: DataFrame, body: str = "body") -> DataFrame:
    """Interaction bodies as ``kind, event_id, run_id, user_id, channel_id, message_ts,
    raw_text``, further columns of the log kept.

    A body is form-encoded with a ``payload`` field, or plain JSON. Only the first action
    of a block counts. Bodies that are not JSON have kind ``invalid``, the ones nobody
    acts on ``ignored``.
    """
    carried = [c for c in log.columns if c != body]
    text = F.coalesce(form_value(F.col(body), "payload"), F.col(body))
    # An object without a type is valid, only nobody acts on it.
    is_object = F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(text), F.lit("{"))
    parsed = log.select(*carried, F.from_json(text, PAYLOAD).alias("p"), is_object.alias("json"))
    action = F.try_element_at(F.col("p.actions"), F.lit(1))
    view = F.col("p.view")
    meta = F.from_json(F.col("p.view.private_metadata"), METADATA)
    staged = parsed.select(
        *carried, "p", "json", action.alias("action"), view.alias("view"), meta.alias("meta")
    )
    is_block = F.col("p.type") == "block_actions"
    is_view = (F.col("p.type") == "view_submission") & (F.col("view.callback_id") == CALLBACK_CORRECTION)
    kind = (
        F.when(~F.coalesce(F.col("json"), F.lit(False)), "invalid")
        .when(is_block & (F.col("action.action_id") == ACTION_POSITIVE), "positive")
        .when(is_block & (F.col("action.action_id") == ACTION_CORRECTION), "correction_open")
        .when(is_block & (F.col("action.action_id") == ACTION_REPLAY_NEXT), "replay_next")
        .when(is_view, "correction")
        .otherwise("ignored")
    )
    typed = F.try_element_at(
        F.try_element_at(F.col("view.state.values"), F.lit(BLOCK_CORRECTION)), F.lit(INPUT_CORRECTION)
    )["value"]

    def pick(block: Column, submitted: Column) -> Column:
        on_block = F.col("kind").isin("positive", "correction_open", "replay_next")
        return F.when(on_block, block).when(F.col("kind") == "correction", submitted)

    def from_meta(key: str) -> Column:
        return F.try_element_at(F.col("meta"), F.lit(key))

    return staged.withColumn("kind", kind).select(
        *carried,
        "kind",
        pick(F.col("action.action_ts"), F.col("view.id")).alias("event_id"),
        pick(F.col("action.value"), from_meta("run_id")).alias("run_id"),
        F.when(~F.col("kind").isin("ignored", "invalid"), F.col("p.user.id")).alias("user_id"),
        pick(F.col("p.channel.id"), from_meta("channel_id")).alias("channel_id"),
        pick(F.col("p.message.ts"), from_meta("message_ts")).alias("message_ts"),
        F.when(F.col("kind") == "correction", F.coalesce(typed, F.lit(""))).alias("raw_text"),
    )


def parse_replies(log: DataFrame, body: str = "body") -> DataFrame:
    """Replies of people in a thread: ``event_id, user_id, channel_id, message_ts, raw_text``,
    further columns of the log kept; ``message_ts`` is the message that opened the thread.

    Other events are left out: messages outside threads and those that open one, edits and
    other subtypes, what bots say, and replies without text.
    """
    carried = [c for c in log.columns if c != body]
    text = F.coalesce(form_value(F.col(body), "payload"), F.col(body))
    parsed = log.select(*carried, F.from_json(text, PAYLOAD).alias("p")).select(*carried, "p.type", "p.event_id", "p.event")
    event = F.col("event")
    is_reply = (
        (F.col("type") == "event_callback") & (event["type"] == "message") & event["subtype"].isNull() & event["bot_id"].isNull()
        & (event["thread_ts"] != event["ts"]) & (F.trim(event["text"]) != "")
    )
    return parsed.where(is_reply).select(
        *carried,
        "event_id",
        event["user"].alias("user_id"),
        event["channel"].alias("channel_id"),
        event["thread_ts"].alias("message_ts"),
        event["text"].alias("raw_text"),
    )


def review_gate(feedback: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per run: may its day be left?

    Open when at least one positive or incorporated correction exists, no correction is
    unresolved, and every adopted rule is in the catalog in use. Rejections alone do not
    make a report right. Feedback folds to run and rule before it meets the catalog.
    """
    kind, state = F.col("feedback_type"), F.col("state")
    correction = kind == "correction"
    settled = state.isin("incorporated", "rejected")
    adopted = correction & (state == "incorporated")

    def many(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    folded = feedback.groupBy(
        "run_id", F.when(adopted, F.col("derived_guideline_id")).alias("rule")
    ).agg(
        many(kind == "positive").alias("positives"),
        many(adopted).alias("incorporated"),
        many(correction & (state == "rejected")).alias("rejected"),
        many(correction & ~F.coalesce(settled, F.lit(False))).alias("unresolved"),
    )
    used = catalog.select(F.col("id").alias("rule"), F.lit(True).alias("in_use"))
    # Rows without a rule, most of them, have nothing to look up and would all share one key.
    ruled = folded.where(F.col("rule").isNotNull()).join(used, "rule", "left")
    checked = ruled.unionByName(folded.where(F.col("rule").isNull()), allowMissingColumns=True)
    counts = ["positives", "incorporated", "rejected", "unresolved"]
    unpublished = F.count(F.when((F.col("incorporated") > 0) & F.col("in_use").isNull(), 1))
    gate = checked.groupBy("run_id").agg(
        *[F.sum(c).alias(c) for c in counts], unpublished.alias("unpublished")
    )
    passes = (
        (F.col("positives") + F.col("incorporated") >= 1)
        & (F.col("unresolved") == 0)
        & (F.col("unpublished") == 0)
    )
    return gate.withColumn("open", passes)


def replay_next_date(sessions: DataFrame, runs: DataFrame) -> DataFrame:
    """Where each replay session stands: ``session_id, next_date, status``.

    ``sessions`` are ``session_id, from_date, to_date``; ``runs`` are ``session_id,
    report_date, open``. The next date is the first one not approved, so a later
    approval never jumps a day that is still blocked; NULL once all are approved.
    """
    planned = sessions.select(
        "session_id", F.explode(F.sequence("from_date", "to_date")).alias("report_date")
    )
    approved = runs.where("open").select("session_id", "report_date").distinct().withColumn("ok", F.lit(True))
    progress = planned.join(approved, ["session_id", "report_date"], "left")
    first_open = F.min(F.when(F.col("ok").isNull(), F.col("report_date")))
    return progress.groupBy("session_id").agg(first_open.alias("next_date")).withColumn(
        "status", F.when(F.col("next_date").isNull(), "complete").otherwise("waiting")
    )


def feedback_summary(feedback: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Feedback per type, day and category of the linked rule, if that rule exists."""
    folded = feedback.groupBy(
        "feedback_type", F.to_date("created_at").alias("created_on"), "derived_guideline_id"
    ).agg(F.count(F.lit(1)).alias("n"))
    rules = guidelines.select(F.col("id").alias("derived_guideline_id"), "category")
    linked = folded.join(rules, "derived_guideline_id", "left")
    return linked.groupBy("feedback_type", "created_on", "category").agg(
        F.sum("n").alias("feedback"),
        F.coalesce(F.sum(F.when(F.col("category").isNotNull(), F.col("n"))), F.lit(0)).alias("linked"),
    )
