from __future__ import annotations

import os
from datetime import date, timedelta

import pytest

from tideline.session import local_session

SAMPLE = os.environ.get("TIDELINE_SAMPLE", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.default.parallelism": "4",
            "spark.sql.maxMetadataStringLength": "2000",  # plans are read by tests
        }
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int, start: date = date(2024, 1, 1)) -> date:
    """The n-th day of a test calendar; day(0) is 2024-01-01."""
    return start + timedelta(days=n)


def rows(df, *columns):
    """Result as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
