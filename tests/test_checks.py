"""Every registered query against its SQL, on the smallest sample."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SAMPLE
from tideline.checks import dialogue, operators, reports, runs

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SAMPLE}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, (datetime.datetime, decimal.Decimal)):
        return str(value)
    return value


def table_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


# The training-data operators have their own tests, and can be left out with them.
NAMES = sorted({**reports.QUERIES, **operators.QUERIES, **dialogue.QUERIES, **runs.QUERIES})


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SAMPLE)
    cursor = duck.execute(entry.oracle_sql()[name])
    expected = table_of([c[0] for c in cursor.description], cursor.fetchall())
    assert table_of(df.columns, df.collect()) == expected
    assert expected[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 4
