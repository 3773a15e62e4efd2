"""Thread replies, review logs and pending work."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tideline.operators.feedback import parse_replies
from tideline.operators.ordered import BLOCK, numbered, release, running_states
from tideline.operators.reviews import TRANSITIONS, pending_due, review_events, review_state, reviewed
from tideline.streaming.threads import corrections, ingest_replies, waiting_replies

START = datetime(2024, 1, 1, 12)
LOG = "body string, received_at timestamp_ntz"
POSTS = "channel_id string, message_ts string, run_id string"


def reply(event, thread="1.0", ts="1.5", text="wrong", **more):
    said = {"type": "message", "user": "U1", "channel": "C1", "text": text, "ts": ts, "thread_ts": thread, **more}
    return json.dumps({"type": "event_callback", "event_id": event, "event": said})


def test_only_replies_of_people_count(spark):
    bodies = [reply("e1"), reply("e2", ts="1.0"), reply("e3", thread=None), reply("e4", bot_id="B1"), reply("e5", text="  "), reply("e6", subtype="message_changed"),
              reply("e7", type="reaction_added"), json.dumps({"type": "url_verification", "challenge": "x"}), "not json", "", None, "[]", reply(None)]
    found = parse_replies(spark.createDataFrame([(b, START) for b in bodies], LOG))
    assert rows(found, "event_id", "message_ts", "raw_text") == [("e1", "1.0", "wrong"), (None, "1.0", "wrong")]


def test_replies_meet_their_report_in_any_order(spark, tmp_path):
    log, posts, folder, progress = (str(tmp_path / n) for n in ("log", "posts", "out", "progress"))

    def add(path, schema, data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)

    def drain():
        def stream(path, schema):
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

        ingest_replies(stream(log, LOG), stream(posts, POSTS), folder, progress, available_now=True).awaitTermination()
        return rows(corrections(spark, folder), "event_id", "run_id"), rows(waiting_replies(spark, folder), "event_id")

    # A reply ahead of its report waits; an unknown thread does for good.
    add(log, LOG, [(reply("e1"), START), (reply("e1"), START + timedelta(hours=1)), (reply("e2", thread="9.9"), START)])
    add(posts, POSTS, [("C1", "2.0", "r2"), (None, "1.0", "nobody"), ("C2", "1.0", "elsewhere")])
    assert drain() == ([], [("e1",), ("e2",)])
    # After a restart: its report, twice, and nothing else.
    add(posts, POSTS, [("C1", "1.0", "r1"), ("C1", "1.0", "r1-again")])
    assert drain() == ([("e1", "r1")], [("e2",)])
    # A retry a year later, and a reply to an old report.
    add(log, LOG, [(reply("e1"), START + timedelta(days=365)), (reply("e3", thread="2.0"), START + timedelta(days=365))])
    assert drain() == ([("e1", "r1"), ("e3", "r2")], [("e2",)])


def plain_walk(events):
    state, rule, illegal, out = "pending", None, 0, []
    for at, event, action, guideline in sorted(events):
        after = TRANSITIONS.get((state, action))
        illegal += after is None
        rule = guideline if after == "incorporated" else rule
        out.append((at, event, state, after or state, after is not None))
        state = after or state
    return (state, rule if state == "incorporated" else None, len(events), illegal), out


def test_states_of_long_and_short_histories(spark):
    rng = random.Random(1)
    log = []
    for item in [None, *range(12)]:
        for k in range(3 * BLOCK + 7 if item == 5 else rng.randint(1, 9)):
            log.append((item, k, START + timedelta(minutes=rng.randrange(5000)), rng.choice(["draft", "approve", "reject", "reopen", "dance", None]), rng.randrange(9)))
    rng.shuffle(log)
    df = spark.createDataFrame(log + log[:9], "feedback_id long, event_id long, at timestamp_ntz, action string, guideline_id long")
    events = review_events(df).persist()
    for item in range(12):
        total, walked = plain_walk([(at, e, a or "", g) for i, e, at, a, g in log if i == item])
        assert rows(review_state(events.where(F.col("feedback_id") == item))) == [(item, *total)]
        assert [tuple(r) for r in events.where(F.col("feedback_id") == item).orderBy("event_no").select("at", "event_id", "before", "after", "legal").collect()] == walked
    assert events.where("feedback_id is null").isEmpty()
    events.unpersist()
    assert review_state(review_events(df.limit(0))).isEmpty()


def test_a_history_of_blocks_of_blocks(spark):
    n = BLOCK * BLOCK + 300
    toggles = spark.range(n).select(F.lit("k").alias("key"), "id", F.when(F.col("id") % 3 == 0, "BA").otherwise("AB").alias("f"))
    placed = numbered(toggles, ["key"], [F.col("id")])
    walked = running_states(placed, "key", "f", 2, 0)
    wrong = walked.withColumn("want", F.when(F.floor((F.col("_no") + 2) / 3) % 2 == 1, "B").otherwise("A")).where("after != want")
    assert walked.count() == n and wrong.isEmpty()
    release(placed)


def test_feedback_takes_the_state_of_its_reviews(spark):
    feedback = spark.createDataFrame(
        [(1, 9, "correction", "pending", None), (2, 9, "correction", "incorporated", 5), (3, 9, "positive", "recorded", None)],
        "id long, run_id long, feedback_type string, state string, derived_guideline_id long",
    )
    states = spark.createDataFrame([(1, "incorporated", 7), (3, "rejected", 8)], "feedback_id long, state string, guideline_id long")
    assert rows(reviewed(feedback, states), "id", "state", "derived_guideline_id") == [(1, "incorporated", 7), (2, "pending", None), (3, "recorded", None)]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_pending_work_is_due_until_done(spark, kind):
    data = [("a", START), ("b", START), ("c", START + timedelta(minutes=51)), (None, START), ("d", START + timedelta(minutes=50))]
    saved = spark.createDataFrame(data, "event_key string, received_at timestamp_ntz").withColumn("received_at", F.col("received_at").cast(kind))
    done = spark.createDataFrame([("b",), (None,)], "event_key string")
    due = pending_due(saved, done, START + timedelta(minutes=60), 10)
    assert rows(due, "event_key", "age_minutes", "tries_due") == [("a", 60, 6), ("d", 10, 1), (None, 60, 6)]
