"""Positions of rows in order, counted without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.frames import parts_for, stored

ROW_BYTES = 200


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The rows with ``i``, their position in the group from 0, and ``n``, the rows of the group; stored.

    Rows are dealt by ranges of (group, order), so that a hot group takes many tasks, and sorted
    there; what stands before a range in its group is a sum over counts, one for each range and group
    that meet. ``rows`` should be a stored table of short rows: it is read twice, once to find the
    ranges. Rows equal in ``order`` should be equal altogether; names ``_at``, ``_part``, ``_first``
    and ``_before`` must be free.
    """
    spark = rows.sparkSession
    parts = parts_for(spark, rows.count() * ROW_BYTES)
    dealt = rows.repartitionByRange(parts, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33).cast("int")))
    by_part = Window.partitionBy(group).orderBy("_part")
    counts = (
        placed.groupBy(group, "_part")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(by_part) - F.col("_n"))
        .withColumn("n", F.sum("_n").over(Window.partitionBy(group)))
        .drop("_n")
    )
    at = F.col("_at") - F.col("_first") + F.col("_before")
    return stored(placed.join(counts, [group, "_part"]).withColumn("i", at).drop("_at", "_part", "_first", "_before"))
