"""Jobs that go on from what earlier ones left: replays, published runs, reviews, replies and pending work."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tideline.checks.dialogue import FLAT_RESULT, cells_of
from tideline.checks.operators import WHOLE_DAYS, _whole_days
from tideline.checks.relations import EVENTS, ORDERS, statement
from tideline.checks.report_sql import MOVED, TRAFFIC, lifecycle_ctes, movement_ctes
from tideline.operators import feedback, reviews
from tideline.operators.replay import Replay, Shape
from tideline.sources import dialogue, snapshots
from tideline.sources.sample import EventsWorld
from tideline.streaming import threads
from tideline.streaming.ingest import work_dir

QUERIES, ORACLE = {}, {}


def check(name: str, relations: dict, ctes: dict, final: str):
    def register(query):
        QUERIES[name] = query
        ORACLE[name] = statement(relations, ctes, final).replace("WITH ", "WITH RECURSIVE ", 1)
        return query

    return register


# --- replay ---------------------------------------------------------------------------

_SPAN = "(SELECT CAST(max(dt) - min(dt) + 1 AS INTEGER) FROM ord)"
_ACTIVE = [f"active_{w}d" for w in (1, 7, 30)]
_AMOUNTS = [f"paid_{m}" for m in MOVED]
_REPLAY = {
    "runs": "SELECT CAST(max(dt) + 1 AS DATE) AS run FROM ord",
    **lifecycle_ctes(WHOLE_DAYS.split(" FROM runs")[0] + " FROM runs JOIN activity ON dt < run", ["region"], _SPAN),
    **movement_ctes("SELECT * FROM days WHERE paid > 0", ["region"], ["paid"], _SPAN),
    "rolling": """
SELECT x.dt, region, count(DISTINCT who) FILTER (WHERE a.dt = x.dt) AS active_1d,
       count(DISTINCT who) FILTER (WHERE a.dt > x.dt - 7) AS active_7d, count(DISTINCT who) AS active_30d
FROM mrr_axis x JOIN days a ON a.dt BETWEEN x.dt - 29 AND x.dt GROUP BY x.dt, region""",
    "met": "SELECT dt, region, " + ", ".join(
        [f"coalesce({c}, 0) AS {c}" for c in _ACTIVE + TRAFFIC] + [f"coalesce({c}, 0e0) AS {c}" for c in _AMOUNTS]
    ) + " FROM rolling FULL JOIN counts USING (dt, region) FULL JOIN moves USING (dt, region)",
}


@check("replay_incremental", ORDERS, _REPLAY, "SELECT * FROM met WHERE " + " OR ".join(f"{c} <> 0" for c in _ACTIVE + TRAFFIC + _AMOUNTS))
def _(spark, d):
    """A step for each year of the order log; each reads its own year and the state that the one before left."""
    folder = work_dir(spark, "replay")
    days = _whole_days(spark, d).withColumn("active", F.lit(True)).withColumn("year", F.year("dt"))
    days.write.partitionBy("year").parquet(f"{folder}/log")
    log = spark.read.parquet(f"{folder}/log")
    first, last = log.agg(F.min("dt"), F.max("dt")).first()

    def span(start: date, end: date):
        return log.where(F.col("year").between(start.year, end.year))

    replay = Replay(spark, folder, Shape("user_id", ("region",), {"paid": "paid"}), span, buckets=8)
    for year in range(first.year, last.year + 1):
        replay.advance(max(first, date(year, 1, 1)), min(last, date(year, 12, 31)))
    return replay.results()


# --- published runs -------------------------------------------------------------------

_ROUNDTRIP = FLAT_RESULT | {
    "placed": """
SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric) AS row_no FROM compared
WHERE NOT (day(run - 1) % 2 = 0 AND metric = 'rev') AND day(run - 1) % 10 <> 0""",
    "good_cells": cells_of("placed"),
}


@check("snapshot_roundtrip", EVENTS, _ROUNDTRIP, "SELECT * FROM good_cells")
def _(spark, d):
    """A run over all days, one without a metric on even days, an empty one on each tenth, a failed one and one that died."""
    path = work_dir(spark, "cells")
    results, order = dialogue.flat_results(spark, d).persist(), [F.col("metric")]
    days = sorted(r[0] for r in results.select(F.date_sub("run_date", 1)).distinct().collect())
    fewer = results.where((F.dayofmonth(F.date_sub("run_date", 1)) % 2 == 0) & (F.col("metric") != "rev"))
    tenth = [x for x in days if x.day % 10 == 0]

    def store(rows, of, name=dialogue.FLAT):
        return snapshots.store_report(spark, lambda: rows, name, order, of, path)

    store(results, days)
    store(fewer, [x for x in days if x.day % 2 == 0])
    store(results.limit(0), tenth)
    store(results.where(F.raise_error(F.lit("broken")).isNull()), days)
    snapshots.to_cells(results, dialogue.FLAT, order).write.partitionBy("report_date").parquet(f"{path}/cells/run_id=died")
    results.unpersist()
    return snapshots.read_snapshot(spark, path)


_KIND = "CASE turn % 4 WHEN 0 THEN 'input' WHEN 1 THEN 'context' WHEN 2 THEN 'report' ELSE 'validation' END"


@check("run_payload_latest", {}, {}, f"""
SELECT 'run-' || conv_id AS run_id, {_KIND} AS kind, CAST(DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS DATE) AS report_date,
       text AS payload
FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn % 4 ORDER BY turn DESC) = 1""")
def _(spark, d):
    """Payloads saved in two waves; the later turn of a run and kind counts."""
    path = work_dir(spark, "payloads")
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    kind = F.element_at(F.array(*map(F.lit, ("input", "context", "report", "validation"))), (F.col("turn") % 4 + 1).cast("int"))
    rows = turns.select(
        F.concat(F.lit("run-"), "conv_id").alias("run_id"),
        F.date_add(F.lit(date(2024, 1, 1)), (F.col("conv_id") % 30).cast("int")).alias("report_date"),
        kind.alias("kind"), F.col("text").alias("payload"), F.expr("turn div 4").alias("wave"),
    )
    for wave in range(int(rows.agg(F.max("wave")).first()[0]) + 1):
        snapshots.save_payload(rows.where(F.col("wave") == wave), None, path)
    return snapshots.latest_payloads(snapshots.read_payloads(spark, path)).drop("saved_at")


# --- thread replies -------------------------------------------------------------------


@check("stream_thread_corrections", {}, {
    "replies": """
SELECT DISTINCT 'Ev-' || conv_id || '-' || turn AS event_id, conv_id, 'U' || (conv_id % 7) AS user_id, 'C' || (conv_id % 3) AS channel_id,
       conv_id || '.0' AS message_ts, text AS raw_text
FROM conversations WHERE role = 'user' AND trim(text) <> ''""",
}, """
SELECT event_id, CASE WHEN conv_id % 10 <> 9 THEN CAST(conv_id AS VARCHAR) END AS run_id, user_id, channel_id, message_ts, raw_text,
       CASE WHEN conv_id % 10 <> 9 THEN 'pending' ELSE 'waiting' END AS status FROM replies""")
def _(spark, d):
    """Replies, retries and posts in several batches, the posts of one batch behind the replies of another."""
    world, folder = EventsWorld(spark, d), work_dir(spark, "threads")
    log, posts = dialogue.thread_log(world), dialogue.posted_reports(world)
    log.repartitionByRange(4, "received_at").write.parquet(f"{folder}/log")
    posts.repartitionByRange(3, F.col("run_id").desc()).write.parquet(f"{folder}/post-log")

    def stream(name, schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")

    threads.ingest_replies(stream("log", log.schema), stream("post-log", posts.schema), folder, f"{folder}/progress", available_now=True).awaitTermination()
    shown = ["event_id", "run_id", "user_id", "channel_id", "message_ts", "raw_text", "status"]
    waiting = threads.waiting_replies(spark, folder).withColumns({"run_id": F.lit(None).cast("string"), "status": F.lit("waiting")})
    return threads.corrections(spark, folder).select(*shown).unionByName(waiting.select(*shown))


# --- reviews --------------------------------------------------------------------------

_MOVES = ", ".join(f"('{a}', '{b}', '{c}')" for (a, b), c in reviews.TRANSITIONS.items())
_REVIEWS = {
    "moves(state, action, target)": f"VALUES {_MOVES}",
    "acts": """
SELECT id AS feedback_id, id * 100 + j AS event_id, (j * 37 + id) % 50 AS at_minute, run_id + j AS guideline_id,
       ['draft', 'approve', 'reject', 'reopen'][((id + j * j) % 4) + 1] AS action
FROM feedback, unnest(range(6)) t(j) WHERE feedback_type = 'correction' AND j < id % 7""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY feedback_id ORDER BY at_minute, event_id) AS event_no FROM acts",
    "walked": """
SELECT feedback_id, CAST(0 AS BIGINT) AS event_no, 'pending' AS state, CAST(NULL AS BIGINT) AS rule, 0 AS illegal FROM placed WHERE event_no = 1
UNION ALL
SELECT w.feedback_id, p.event_no, coalesce(m.target, w.state), CASE WHEN m.target = 'incorporated' THEN p.guideline_id ELSE w.rule END,
       w.illegal + CASE WHEN m.target IS NULL THEN 1 ELSE 0 END
FROM walked w JOIN placed p ON p.feedback_id = w.feedback_id AND p.event_no = w.event_no + 1
  LEFT JOIN moves m ON m.state = w.state AND m.action = p.action""",
    "stood": """
SELECT feedback_id, arg_max(state, event_no) AS state, arg_max(coalesce(rule, -1), event_no) AS rule, max(event_no) AS events,
       CAST(arg_max(illegal, event_no) AS BIGINT) AS illegal FROM walked GROUP BY feedback_id""",
}


@check("review_state", EVENTS, _REVIEWS, """
SELECT feedback_id, state, CASE WHEN state = 'incorporated' THEN rule END AS guideline_id, events, illegal FROM stood""")
def _(spark, d):
    return reviews.review_state(reviews.review_events(dialogue.review_log(EventsWorld(spark, d))))


@check("review_gate_from_log", EVENTS, _REVIEWS | {
    "judged_items": """
SELECT f.run_id, f.feedback_type, CASE WHEN feedback_type = 'correction' THEN coalesce(s.state, 'pending') ELSE f.state END AS state, s.rule
FROM feedback f LEFT JOIN stood s ON s.feedback_id = f.id""",
    "used": "SELECT id FROM guidelines WHERE is_active",
}, """
SELECT run_id, count(*) FILTER (WHERE feedback_type = 'positive') AS positives,
       count(*) FILTER (WHERE feedback_type = 'correction' AND state = 'incorporated') AS incorporated,
       count(*) FILTER (WHERE feedback_type = 'correction' AND state = 'rejected') AS rejected,
       count(*) FILTER (WHERE feedback_type = 'correction' AND state NOT IN ('incorporated', 'rejected')) AS unresolved,
       count(DISTINCT rule) FILTER (WHERE feedback_type = 'correction' AND state = 'incorporated' AND rule NOT IN (SELECT id FROM used)) AS unpublished
FROM judged_items GROUP BY run_id""")
def _(spark, d):
    world = EventsWorld(spark, d)
    states = reviews.review_state(reviews.review_events(dialogue.review_log(world)))
    in_use = world["agent_guidelines"].where("is_active")
    return feedback.review_gate(reviews.reviewed(world["agent_feedback"], states), in_use).drop("open")


@check("pending_due", EVENTS, {
    "saved": """
SELECT conv_id || '-' || turn AS event_key, text AS raw_text,
       CAST(10080 - 1440 * (conv_id % 7) - 60 * turn AS BIGINT) AS age_minutes, length(text) % 3 = 0 AS done
FROM conversations WHERE role = 'user'""",
}, """
SELECT event_key, raw_text, age_minutes, age_minutes // 360 AS tries_due FROM saved WHERE NOT done AND age_minutes >= 360""")
def _(spark, d):
    turns = EventsWorld(spark, d).table("conversations").where("role = 'user'")
    since = F.make_dt_interval((F.col("conv_id") % 7).cast("int"), F.col("turn").cast("int"), F.lit(0), F.lit(0))
    saved = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("event_key"), F.col("text").alias("raw_text"),
        (F.lit(date(2024, 1, 1)).cast("timestamp_ntz") + since).alias("received_at"),
    )
    due = reviews.pending_due(saved, saved.where(F.length("raw_text") % 3 == 0), datetime(2024, 1, 8), 360)
    return due.select("event_key", "raw_text", "age_minutes", "tries_due")
