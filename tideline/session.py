"""Session for local runs; on a cluster pass your own session to the library."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tideline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Recording the Python call site of every column expression doubles planning time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
