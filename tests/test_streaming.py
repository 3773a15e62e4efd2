import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest

from tests.conftest import rows
from tests.test_dialogue import TYPED, action, submission
from tideline.streaming.ingest import ingest_feedback, ingest_recent, work_dir

LOG = "body string, received_at timestamp_ntz"
START = datetime(2024, 1, 1, 12)


def write(spark, path, *bodies):
    data = [(json.dumps(b), START + timedelta(minutes=m)) for b, m in bodies]
    spark.createDataFrame(data, LOG).coalesce(1).write.mode("append").parquet(path)


def positive(event):
    return action("feedback_positive", event=event)


def drain(spark, source, sink, checkpoint):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    ingest_feedback(stream, sink, checkpoint, available_now=True).awaitTermination()
    return rows(spark.read.parquet(sink), "event_id", "kind", "status")


def test_retries_never_add_a_second_row(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("log", "feedback", "progress"))
    write(spark, source, (positive("e1"), 0), (positive("e1"), 1), (submission(TYPED), 2), (action("replay_next"), 3))
    first = [("V1", "correction", "pending"), ("e1", "positive", "recorded")]
    assert drain(spark, source, sink, checkpoint) == first
    # A retry months later, in a new batch after a restart, next to a new event.
    write(spark, source, (positive("e1"), 60 * 24 * 90), (positive("e2"), 4))
    assert drain(spark, source, sink, checkpoint) == [*first, ("e2", "positive", "recorded")]


def test_late_rows_are_kept(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("log", "feedback", "progress"))
    write(spark, source, (positive("e1"), 60 * 24 * 365))
    drain(spark, source, sink, checkpoint)
    write(spark, source, (positive("e0"), 0))
    assert [r[0] for r in drain(spark, source, sink, checkpoint)] == ["e0", "e1"]


def test_recent_dedupe_keeps_late_rows(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("log", "out", "progress"))

    def drain_recent():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
        ingest_recent(stream, sink, checkpoint, days=2, available_now=True).awaitTermination()
        return [r[0] for r in rows(spark.read.parquet(sink), "event_id")]

    year = 60 * 24 * 365
    write(spark, source, (positive("e1"), year), (positive("e1"), year + 5), (positive("e2"), year + 6))
    assert drain_recent() == ["e1", "e2"]
    # A year late, and a retry a day after its first row.
    write(spark, source, (positive("e0"), 0), (positive("e2"), year + 60 * 24))
    assert drain_recent() == ["e0", "e1", "e2"]


def test_feedback_without_an_event_id_is_kept(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("log", "out", "progress"))

    def by(user):
        body = positive(None)
        return body | {"user": {"id": user}}

    write(spark, source, (by("U1"), 0), (by("U2"), 1), (by("U3"), 2), (by("U1"), 3))
    stream = spark.readStream.schema(LOG).parquet(source)
    ingest_feedback(stream, sink, checkpoint, available_now=True).awaitTermination()
    assert rows(spark.read.parquet(sink), "user_id") == [("U1",), ("U2",), ("U3",)]


def session_like(setting, master):
    conf = SimpleNamespace(get=lambda key, default: setting)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_work_folder_follows_the_session():
    assert work_dir(session_like("hdfs://c/check/", "yarn"), "x").startswith("hdfs://c/check/x-")
    assert work_dir(session_like(None, "local[8]"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(session_like(None, "yarn"), "x")
