"""Declared schemas of the source relations and the date-pruned scan."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "daily_user_activities": (
        "dt date, user_id bigint, country_code string, day_index int, "
        "can_purchasing_dim struct<revenue: decimal(18,2)>, "
        "sub_purchasing_dim struct<revenue: decimal(18,2)>, "
        "matching_dim struct<n: bigint>, audience_dim struct<n: bigint>"
    ),
    "can_purchase": "purchased_at timestamp_ntz, user_id bigint, ch_id bigint, usd_price decimal(18,2)",
    "streaming": (
        "start_time timestamp_ntz, user_id bigint, is_video boolean, duration decimal(18,2)"
    ),
    "admob_revenue": "dt date, gross_revenue decimal(18,2)",
    "dailyactives": (
        "day date, userid bigint, bars_spent decimal(18,2), revenue decimal(18,2)"
    ),
    "store_transaction": (
        "datecreated timestamp_ntz, userid bigint, productid bigint, "
        "amountdollars decimal(18,2), amountbars bigint, status string"
    ),
    "store_product": "id bigint, name string",
    "users_data": "userid bigint, country string, locale string, datecreated date, terminated int",
    "crown_level_log": "datecreated timestamp_ntz, userid bigint, crown_level int",
    "agent_guidelines": (
        "id bigint, category string, rule_text string, is_active boolean, source string"
    ),
    "agent_feedback": (
        "id bigint, run_id bigint, turn bigint, raw_text string, feedback_type string, "
        "state string, user_id string, message_ts string, derived_guideline_id bigint, "
        "created_at timestamp_ntz"
    ),
}

# The day or instant each relation is pruned by.
TIME_COLUMNS = {
    "daily_user_activities": "dt",
    "can_purchase": "purchased_at",
    "streaming": "start_time",
    "admob_revenue": "dt",
    "dailyactives": "day",
    "store_transaction": "datecreated",
    "crown_level_log": "datecreated",
}


def scan(
    spark: SparkSession,
    path: str,
    time_column: str,
    first: date,
    last: date,
    schema: str | None = None,
) -> DataFrame:
    """Rows of the whole days ``first..last``, both included.

    The range is half-open on the bare column, so parquet skips row groups by min/max
    and a table partitioned by that column skips whole directories.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    column = F.col(time_column)
    return reader.parquet(path).where(
        (column >= F.lit(first)) & (column < F.lit(last + timedelta(days=1)))
    )


class Warehouse(dict):
    """Source relations by name, each read lazily from ``<root>/<name>``.

    Reports only look up the relations they use, and prune them by date themselves.
    """

    def __init__(self, spark: SparkSession, root: str):
        super().__init__()
        self._spark, self._root = spark, root.rstrip("/")

    def __missing__(self, name: str) -> DataFrame:
        frame = self._spark.read.schema(SCHEMAS[name]).parquet(f"{self._root}/{name}")
        self[name] = frame
        return frame


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of ``df`` selected and cast to the declared schema of relation ``name``."""
    target = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])
