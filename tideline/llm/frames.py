"""Keys, sizes and checkpoints that several operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.bytework import BITS

#: Null ids rank behind every other id.
LAST_ID = (1 << 63) - 1
MB = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front as long as a column has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def keys(id_column: str, text: str) -> tuple[Column, Column]:
    """The id, the largest possible one if null, and a hash of the text."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)), F.xxhash64(text_column(text))


def keyed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``text``, ``k1`` and ``k2`` only; other columns may have any name.

    ``k1`` is the id, the largest possible one if null; ``k2`` tells texts under one id apart.
    Rows with the same id and text are one document wherever they stand.
    """
    k1, k2 = keys(id_column, text)
    return docs.select(F.col(id_column).cast("long").alias("id"), text_column(text).alias("text"), k1.alias("k1"), k2.alias("k2"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    row = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()
    return int(row["n"] or 0)


def parts_for(spark: SparkSession, size: int, each: int = 16 * MB) -> int:
    """So many parts that none has more than about ``each`` bytes; at least Spark's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / each))


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate files may go: ``spark.checkpoint.dir``, a folder that all executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage of a small table with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage of a large table with a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes in ``h``: a fixed size, so it may be sent to every task."""
    words = (
        hashes.select(F.expr(f"shiftright({BITS - 1}L & h, 6)").alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    out = np.zeros(BITS >> 6, np.int64)
    for row in words:
        out[row["word"]] = row["bits"]
    return out
