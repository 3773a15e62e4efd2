"""Feedback ingest: retries carry the same event id and must not add a second row."""

from __future__ import annotations

import tempfile
import uuid
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.operators.feedback import parse_interactions

FEEDBACK_KINDS = ("positive", "correction")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="tideline-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def feedback_rows(log: DataFrame) -> DataFrame:
    """Interaction log (``body, received_at``) to feedback rows with their day, status and key.

    A correction waits for a rule to be drafted from it; a positive is done. ``event_key`` is
    what retries have in common: the event id, or a hash of the whole body where it has none.
    """
    status = F.when(F.col("kind") == "positive", "recorded").otherwise("pending")
    unnamed = F.sha2(F.concat_ws("\n", "kind", "_body"), 256)
    return (
        parse_interactions(log.withColumn("_body", F.col("body")))
        .where(F.col("kind").isin(*FEEDBACK_KINDS))
        .withColumns(
            {"status": status, "event_day": F.to_date("received_at"), "event_key": F.coalesce("event_id", unnamed)}
        )
        .drop("_body")
    )


def ingest_feedback(log: DataFrame, sink: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Stream the raw interaction log into the feedback table at ``sink``.

    Every key ever seen stays in the state store, spread over the executors by key and saved
    with the checkpoint: a retry of any age is recognised, no row is too late, and a
    micro-batch costs what it brings, not what the table holds. The file sink's own log makes
    each batch appear once, also when it is repeated after a failure.
    """
    unique = feedback_rows(log).dropDuplicates(["event_key"])
    writer = (
        unique.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("event_day")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(sink)


def ingest_recent(
    log: DataFrame, sink: str, checkpoint: str, days: int, available_now: bool = False
) -> StreamingQuery:
    """As ``ingest_feedback``, without state: for sources whose retries come within ``days``.

    Each micro-batch is compared with the stored days around its own, so what it reads is
    bounded by the days it brings. A row of any age is kept, however late; only a retry more
    than ``days`` from its first row adds a second one. A batch repeated after a failure finds
    its own rows and adds those that are missing.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["event_key"]).persist()
        try:
            span = rows.agg(F.min("event_day").alias("first"), F.max("event_day").alias("last")).first()
            if span["first"] is None:
                return
            near = F.col("event_day").between(F.lit(span["first"] - timedelta(days=days)), F.lit(span["last"] + timedelta(days=days)))
            try:
                stored = spark.read.schema(rows.schema).parquet(sink).where(near).select("event_key").distinct()
            except AnalysisException as problem:  # nothing stored yet
                if problem.getCondition() != "PATH_NOT_FOUND":
                    raise
                stored = rows.limit(0).select("event_key")
            new = rows.join(stored, "event_key", "left_anti")
            new.write.mode("append").partitionBy("event_day").parquet(sink)
        finally:
            rows.unpersist()

    writer = feedback_rows(log).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
