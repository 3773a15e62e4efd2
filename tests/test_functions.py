from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tideline.functions.buckets import home_region, level_tier, locale_region, payer_flag
from tideline.functions.dates import day_index, half_month_start, in_days
from tideline.functions.numbers import pct_change, ratio, round_half_away, round_ratio
from tideline.functions.text import (
    cell_text, comma_list, escape_cell, form_value, metric_label, trim_space,
)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, digits, expected",
    [(2.5, 0, 3.0), (-2.5, 0, -3.0), (0.125, 2, 0.13), (-0.125, 2, -0.13), (-0.001, 2, 0.0), (1e6 + 0.005, 2, 1000000.01)],
)
def test_rounding_is_half_away_from_zero(spark, value, digits, expected):
    got = one(spark, round_half_away(F.lit(value), digits))
    assert got == expected and str(got) == str(expected)


@pytest.mark.parametrize(
    "n, d, expected", [("4.05", 30, 0.14), ("23", 40, 0.58), ("-23", 40, -0.58), ("1", 3, 0.33), ("0", 7, 0.0), ("5", 0, None), ("1.15", 1, 1.15)]
)
def test_quotients_are_rounded_exactly(spark, n, d, expected):
    assert one(spark, round_ratio(F.lit(Decimal(n)), F.lit(d), 2)) == expected


def test_percentages_are_rounded_exactly(spark):
    assert one(spark, pct_change(F.lit(103.0), F.lit(160.0))) == -35.63


def test_ratio_without_base_is_null(spark):
    assert one(spark, ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, ratio(F.lit(1), F.lit(None).cast("int"))) is None
    assert one(spark, pct_change(F.lit(3), F.lit(0))) is None
    assert one(spark, pct_change(F.lit(3), F.lit(2))) == 50.0


def test_half_month(spark):
    days = [date(2024, 2, 1), date(2024, 2, 15), date(2024, 2, 16), date(2024, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "dt date")
    starts = [r[0] for r in df.select(half_month_start(F.col("dt"))).collect()]
    assert starts == [date(2024, 2, 1)] * 2 + [date(2024, 2, 16)] * 2


def test_day_index_of_unknown_user_is_null(spark):
    df = spark.createDataFrame([(date(2024, 1, 5), date(2024, 1, 1)), (date(2024, 1, 5), None)], "dt date, s date")
    assert [r[0] for r in df.select(day_index(F.col("s"), F.col("dt"))).collect()] == [4, None]


def test_in_days_includes_both_whole_days(spark):
    stamps = [datetime(2024, 1, 1, 23, 59, 59), datetime(2024, 1, 2), datetime(2024, 1, 3, 23, 59, 59, 999999), datetime(2024, 1, 4)]
    df = spark.createDataFrame([(t,) for t in stamps], "t timestamp_ntz")
    kept = df.where(in_days(F.col("t"), date(2024, 1, 2), date(2024, 1, 3))).collect()
    assert [r[0] for r in kept] == stamps[1:3]


@pytest.mark.parametrize(
    "level, tier",
    [(None, "no"), (0, "no"), (1, "red"), (5, "red"), (6, "platinum"), (10, "platinum"), (11, "titanium"), (12, "titanium"), (13, "golden"), (14, "golden")],
)
def test_tier_floors(spark, level, tier):
    assert one(spark, level_tier(F.lit(level).cast("int"))) == tier


def test_regions(spark):
    none = F.lit(None).cast("string")
    assert one(spark, home_region(F.lit("TW"))) == "TW"
    assert one(spark, home_region(none)) == "others"
    assert one(spark, home_region(F.lit("JP"), "Others")) == "Others"
    assert one(spark, locale_region(F.lit("US"), F.lit("es"))) == "na"
    assert one(spark, locale_region(F.lit("FR"), F.lit("me"))) == "me"
    assert one(spark, locale_region(F.lit("FR"), F.lit("fr"))) == "others"
    assert one(spark, locale_region(none, none)) == "others"
    assert one(spark, payer_flag(F.lit(None).cast("int"))) is False


def test_cells(spark):
    df = spark.createDataFrame(
        [(date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), 12345678.5, "a|b", None, 7, True, Decimal("1.50"))],
        "d date, t timestamp_ntz, x double, s string, n string, i int, b boolean, m decimal(18,2)",
    )
    got = df.select(*[cell_text(F.col(f.name), f.dataType) for f in df.schema.fields]).first()
    assert list(got) == ["2024-01-02T00:00:00Z", "2024-01-02T03:04:05Z", "12345678.5000", "a|b", "NULL", "7", "true", "1.50"]
    assert one(spark, escape_cell(F.lit("a|b\nc"))) == "a\\|b c"


def test_text_helpers(spark):
    assert one(spark, trim_space(F.lit("　\t x y \n"))) == "x y"
    assert one(spark, comma_list(F.lit(" a, ,b ,"))) == ["a", "b"]
    assert one(spark, metric_label(F.lit("main_kpi"), F.lit("  "))) == "main kpi"
    assert one(spark, metric_label(F.lit("main_kpi"), F.lit(None).cast("string"))) == "main kpi"
    assert one(spark, metric_label(F.lit("main_kpi"), F.lit(" Start here "))) == "Start here"


def test_form_value(spark):
    assert one(spark, form_value(F.lit("a=1&payload=%7B%22x%22%3A+1%7D&b=2"), "payload")) == '{"x": 1}'
    assert one(spark, form_value(F.lit("a=1"), "payload")) is None
    assert one(spark, form_value(F.lit("payload="), "payload")) is None
    assert one(spark, form_value(F.lit("payload=%zz"), "payload")) is None


def test_bounds_reach_the_parquet_scan(spark):
    from tests.conftest import SAMPLE
    from tideline.sources.warehouse import scan

    df = scan(spark, f"{SAMPLE}/events.parquet", "ts", date(2024, 1, 3), date(2024, 1, 4)).select("user_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "props" not in plan.split("ReadSchema")[1]
    assert len(rows(df)) > 0
