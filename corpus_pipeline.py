"""A training corpus from raw documents: five stages, each on all that the one before kept.

Every stage takes and returns the columns of ``documents``; the last adds what the mix takes
of each document. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.decontaminate import contained
from tideline.llm.frames import fresh, keys, stored, table
from tideline.llm.line_windows import dedupe_lines
from tideline.llm.lsh_forest import near_duplicates
from tideline.llm.mixing import mix
from tideline.llm.quality import scored, train

LEAST_SCORE = 0.5


def _with_keys(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with the two keys that operators give back."""
    names = fresh(docs, "k1", "k2")
    return docs.withColumns(dict(zip(names, keys("doc_id", "text"), strict=True))), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of ids that aren't held out."""
    trees = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, trees).where(F.col("_score") >= LEAST_SCORE).drop("_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line passages; those of which nothing is left go."""
    left = dedupe_lines(docs)
    changed = F.col("_n_removed") > 0
    return (
        left.where(~(changed & (F.col("_n_removed") == F.col("_n_lines"))))
        .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(docs.columns)
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies; of equal rows, one."""
    keep = near_duplicates(docs).where("first").select("k1", "k2").distinct()
    rows, names = _with_keys(docs)
    met = rows.join(keep.toDF(*names), names, "left_semi")
    return met.dropDuplicates(names).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = contained(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("k1", "k2").distinct()
    rows, names = _with_keys(docs)
    return rows.join(found.toDF(*names), names, "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``size``, ``target`` of the source, ``copies`` and words ``taken``."""
    mixed = mix(docs).where("_copies > 0")
    return mixed.select(
        *docs.columns, F.col("_size").alias("size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), F.col("_taken").alias("taken")
    )


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

#: A classifier and a rounding in order are not SQL; the tests hold stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
