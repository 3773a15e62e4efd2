"""The state of feedback items from the log of their reviews."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordered import numbered, running_states

INITIAL = "pending"
#: What an action makes of a state; anything else is illegal and changes nothing.
TRANSITIONS: Mapping[tuple[str, str], str] = {
    ("pending", "draft"): "candidate",
    ("pending", "reject"): "rejected",
    ("candidate", "draft"): "candidate",
    ("candidate", "approve"): "incorporated",
    ("candidate", "reject"): "rejected",
    ("incorporated", "reopen"): "pending",
    ("rejected", "reopen"): "pending",
}


def review_events(log: DataFrame, transitions: Mapping[tuple[str, str], str] = TRANSITIONS, initial: str = INITIAL) -> DataFrame:
    """Each event of a review log with the item's state ``before`` and ``after`` it, and ``legal``.

    The log has ``feedback_id, event_id, at, action, guideline_id`` in any order; an item's events
    count by time, then by event id, retries of an event once. Events of no item are left out.
    """
    states = sorted({initial, *(s for s, _ in transitions), *transitions.values()})
    index = {s: n for n, s in enumerate(states)}
    effect = F.lit("".join(chr(65 + n) for n in range(len(states))))
    for action in sorted({a for _, a in transitions}):
        spelled = "".join(chr(65 + index[transitions.get((s, action), s)]) for s in states)
        effect = F.when(F.col("action") == action, spelled).otherwise(effect)
    columns = ["feedback_id", "event_id", "at", "action", "guideline_id"]
    once = log.where(F.col("feedback_id").isNotNull()).dropDuplicates(["feedback_id", "event_id", "at", "action"]).select(*columns)
    placed = numbered(once.withColumn("_effect", effect), ["feedback_id"], [F.col("at"), F.col("event_id"), F.col("action")])
    walked = running_states(placed, "feedback_id", "_effect", len(states), index[initial])
    named = F.array(*map(F.lit, states))

    def state(letter: str):
        return F.element_at(named, F.ascii(letter) - 64)

    legal = F.lit(False)
    for before, action in transitions:
        legal = legal | ((F.col("before") == before) & (F.col("action") == action))
    met = placed.select(*columns, "_no").join(walked, ["feedback_id", "_no"])
    met = met.withColumns({"before": state("before"), "after": state("after")}).withColumn("legal", F.coalesce(legal, F.lit(False)))
    return met.select(*columns, F.col("_no").alias("event_no"), "before", "after", "legal")


def review_state(events: DataFrame) -> DataFrame:
    """Where each item stands: ``feedback_id, state, guideline_id, events, illegal``.

    The guideline is that of the last approval, while it stands.
    """
    adopted = F.col("legal") & (F.col("after") == "incorporated")
    rule = F.max(F.when(adopted, F.struct("event_no", "guideline_id")))["guideline_id"]
    state = F.max(F.struct("event_no", "after"))["after"]
    folded = events.groupBy("feedback_id").agg(
        state.alias("state"), rule.alias("_rule"), F.count(F.lit(1)).alias("events"), F.count_if(~F.col("legal")).alias("illegal")
    )
    return folded.select("feedback_id", "state", F.when(F.col("state") == "incorporated", F.col("_rule")).alias("guideline_id"), "events", "illegal")


def reviewed(feedback: DataFrame, states: DataFrame) -> DataFrame:
    """Feedback with ``state`` and ``derived_guideline_id`` from its reviews, as the review gate takes it.

    A correction that nobody reviewed is pending; other kinds need no review and keep their state.
    """
    found = states.select(F.col("feedback_id").alias("id"), F.col("state").alias("_state"), F.col("guideline_id").alias("_rule"))
    is_correction = F.col("feedback_type") == "correction"
    met = feedback.join(found, "id", "left")
    state = F.when(is_correction, F.coalesce("_state", F.lit(INITIAL))).otherwise(F.col("state"))
    rule = F.when(is_correction, F.col("_rule")).otherwise(F.col("derived_guideline_id"))
    return met.withColumns({"state": state, "derived_guideline_id": rule}).drop("_state", "_rule").select(*feedback.columns)


def pending_due(pending: DataFrame, done: DataFrame, now: datetime, after_minutes: int, key: str = "event_key") -> DataFrame:
    """What was saved, is still without a result and is due for another try: the rows with ``age_minutes`` and ``tries_due``.

    A row is due when a multiple of ``after_minutes`` has passed since ``received_at``; ``done`` lists the keys
    that have a result, and a row without a key never has one. What is too young is left out at the scan.
    """
    kind = pending.schema["received_at"].dataType
    now = F.lit(now).cast("timestamp_ntz").cast(kind)
    limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(after_minutes), F.lit(0))
    aged = pending.where(F.col("received_at") <= now - limit)
    waiting = aged.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    age = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("received_at").cast("timestamp"))) / 60)
    return waiting.withColumn("age_minutes", age).withColumn("tries_due", F.floor(F.col("age_minutes") / after_minutes))
