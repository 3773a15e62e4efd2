"""The pipeline's stages take effect and keep clean documents."""

from __future__ import annotations

import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from tideline.llm import queries  # noqa: E402

SAMPLE = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SAMPLE).write.parquet(out := str(tmp_path / str(k)))
        docs = spark.read.parquet(out)
        kept[name] = (before, {r.doc_id: r.text for r in docs.collect()})
        assert docs.columns == columns or name == "mixing"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SAMPLE}/labels.parquet").collect()}
    before, after = kept["quality"]
    assert sum(labels[i] == (i in after) for i in before if i in labels) >= 0.95 * sum(i in labels for i in before)
    before, after = kept["line_dedup"]
    left = dict(brute.line_windows(list(before.items())))
    assert after == {i: t for i, t in left.items() if t or not before[i]}
    before, after = kept["near_dedup"]
    assert set(after) == {c for _, c, _ in brute.near(list(before.items()))}
    before, after = kept["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SAMPLE}/benchmark.parquet").collect()]
    assert set(after) == {i for i, _, hit, _ in brute.windows(list(before.items()), items) if not hit}
    before, after = kept["mixing"]
    assert after and set(after) <= set(before)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SAMPLE).count() > 0 and len(corpus_pipeline.STAGES) == 5


def test_line_windows_equal_their_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SAMPLE}/documents.parquet'")
    assert brute.ordered(queries.op5_line_windows(spark, SAMPLE).collect()) == brute.ordered(con.sql(queries.OP5_SQL).fetchall())


def test_every_number_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
