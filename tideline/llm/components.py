"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.frames import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for each node of ``edges`` (``u``, ``v``) but the roots.

    Alternates large and small stars: each step hangs neighbours on the least one known, by a fold and
    a join, until nothing moves. Steps grow with the logarithm of the longest path.
    """
    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        head = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(head, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(head.select("u", F.col("m").alias("v"))).distinct())
        after = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("s")).first()
        if after == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = after
