"""Thread replies as corrections: replies meet the reports they answer, in whatever order both arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.operators.feedback import parse_replies
from tideline.sources import manifests

THREAD = ["channel_id", "message_ts"]
REPLIES = "received_at timestamp, event_id string, user_id string, channel_id string, message_ts string, raw_text string, event_key string"
POSTS = "channel_id string, message_ts string, run_id string"


def thread_replies(log: DataFrame) -> DataFrame:
    """Replies of an event log (``body, received_at``) with ``event_key``, which retries share."""
    unnamed = F.sha2(F.concat_ws("\n", "channel_id", "message_ts", "user_id", "raw_text", F.col("received_at").cast("string")), 256)
    named = parse_replies(log.withColumn("received_at", F.col("received_at").cast("timestamp")))
    return named.withColumn("event_key", F.coalesce("event_id", unnamed))


def ingest_replies(log: DataFrame, posts: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Stream replies into corrections as soon as the report they answer is known.

    ``log`` streams raw events, ``posts`` the posted reports (``channel_id, message_ts, run_id``).
    A retry of any age is recognised by its key in the state store. Each micro-batch matches what it
    brings and what still waits with all posts so far; a reply ahead of its report waits and is never
    dropped, a report may get replies for good. Every batch writes folders of its own number,
    computed from those of the batch before, so that a batch repeated after a failure writes the
    same again.
    """
    replies = thread_replies(log).dropDuplicates(["event_key"])
    both = replies.withColumn("_is_post", F.lit(False)).unionByName(
        posts.select(*THREAD, "run_id").withColumn("_is_post", F.lit(True)), allowMissingColumns=True
    )

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            rows.where("_is_post").select(*THREAD, "run_id").write.mode("overwrite").parquet(f"{folder}/posts/batch={number}")
            names = [c.split()[0] for c in REPLIES.split(", ")]
            waiting = rows.where("not _is_post").select(*names)
            if number > 0:
                waiting = waiting.unionByName(spark.read.schema(REPLIES).parquet(f"{folder}/waiting/batch={number - 1}"))
            # A post may be reported twice; its first run counts.
            known = spark.read.schema(f"{POSTS}, batch int").parquet(f"{folder}/posts").where(F.col("batch") <= number)
            known = known.where(F.col("channel_id").isNotNull() & F.col("message_ts").isNotNull()).groupBy(*THREAD).agg(F.min("run_id").alias("run_id"))
            met = waiting.join(known, THREAD, "left").select(*names, "run_id").persist()
            met.where("run_id is not null").write.mode("overwrite").parquet(f"{folder}/corrections/batch={number}")
            met.where("run_id is null").select(*names).write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")
            met.unpersist()
            if number > 1:
                manifests.remove(spark, f"{folder}/waiting/batch={number - 2}")
        finally:
            rows.unpersist()

    writer = both.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Replies that answer a known report, as pending corrections."""
    found = spark.read.schema(f"{REPLIES}, run_id string").parquet(f"{folder}/corrections")
    return found.select(F.lit("correction").alias("kind"), "event_id", "event_key", "run_id", "user_id", *THREAD, "raw_text", "received_at", F.lit("pending").alias("status"))


def waiting_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Replies whose report isn't known yet: those of the last batch."""
    found = spark.read.schema(f"{REPLIES}, batch int").parquet(f"{folder}/waiting")
    last = found.select("batch").agg(F.max("batch").alias("batch"))
    return found.join(last, "batch", "left_semi").drop("batch")
