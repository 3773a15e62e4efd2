"""Joins to user dimensions and between daily results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.buckets import locale_region


def attach_user_dim(days: DataFrame, users: DataFrame, user: str) -> DataFrame:
    """Add ``region`` and ``signup_dt`` from the user table (one row per user).

    ``days`` comes folded to user-days, so a busy user brings one row per day. No
    broadcast hint: the user table grows with the product, Spark decides by its size.
    """
    known = users.select(
        F.col("userid").alias(user),
        locale_region(F.col("country"), F.col("locale")).alias("_region"),
        F.col("datecreated").cast("date").alias("signup_dt"),
    )
    joined = days.join(known, user, "left")
    return joined.withColumn("region", F.coalesce("_region", F.lit("others"))).drop("_region")


def attach_user_day(days: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two user-day relations, ``other`` unique per user-day."""
    return days.join(other, list(keys), "left")


def merge_outer(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on shared keys; missing measures become 0."""
    joined = a.join(b, list(keys), "full")
    measures = [c for c in joined.columns if c not in keys]
    types = {f.name: f.dataType for f in joined.schema.fields}
    return joined.select(
        *keys, *[F.coalesce(F.col(c), F.lit(0).cast(types[c])).alias(c) for c in measures]
    )
