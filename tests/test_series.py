from datetime import date

from pyspark.sql import functions as F

from tests.conftest import day, rows
from tideline.operators.series import anomaly_shortlist, baseline_pack, comparison_pack, to_long
from tideline.operators.spine import (
    available_only_if, calendar, dimension_spine, fill_gaps, on_spine, shift_date,
)

LONG = "dt date, metric string, value decimal(38,4)"


def series(spark, values):
    return spark.createDataFrame([(day(i), "m", v) for i, v in enumerate(values)], "dt date, metric string, value double").select(
        "dt", "metric", F.col("value").cast("decimal(38,4)").alias("value")
    )


def at(df, n):
    return df.where(F.col("dt") == F.lit(day(n))).first()


def test_baselines_exclude_the_day_itself(spark):
    packed = baseline_pack(series(spark, [float(i) for i in range(40)]))
    row = at(packed, 35)
    assert (row.previous_day, row.last_week) == (34.0, 28.0)
    assert row.previous_7d_avg == 31.0 and row.previous_30d_avg == 19.5
    assert row.previous_30d_stddev == 8.8
    first = at(packed, 0)
    assert first.previous_day is None and first.previous_7d_avg is None and first.previous_30d_stddev is None


def test_missing_values_are_left_out_of_averages(spark):
    row = at(baseline_pack(series(spark, [10.0, None, 20.0, None, 5.0])), 4)
    assert row.previous_day is None and row.previous_7d_avg == 15.0


def test_no_z_score_from_one_value_or_a_flat_series(spark):
    compared = comparison_pack(baseline_pack(series(spark, [3.0, 3.0, 3.0, 9.0])))
    assert at(compared, 1).z_score_30d is None
    assert at(compared, 3).previous_30d_stddev == 0.0 and at(compared, 3).z_score_30d is None
    assert at(compared, 3).dod_pct == 200.0


def test_zero_base_gives_no_percentage(spark):
    compared = comparison_pack(baseline_pack(series(spark, [0.0, 5.0])))
    row = at(compared, 1)
    assert row.dod_pct is None and row.vs_7d_avg_pct is None and row.value == 5.0


def test_comparisons_use_rounded_baselines(spark):
    # Mean 1/3 is rounded to 0.33 first: 1 / 0.33 - 1 is 203.03 %, not 200 %.
    compared = comparison_pack(baseline_pack(series(spark, [0.0, 0.0, 1.0, 1.0])))
    assert at(compared, 3).vs_7d_avg_pct == 203.03


def test_scale_of_baselines(spark):
    assert at(baseline_pack(series(spark, [0.0, 0.0, 1.0, 1.0]), scale=4), 3).previous_7d_avg == 0.3333


def test_to_long_keeps_nulls(spark):
    wide = spark.createDataFrame([(day(0), 1, None)], "dt date, a int, b int")
    assert len(rows(to_long(wide, ["dt"], ["a", "b"]))) == 2


def test_anomalies(spark):
    rows_ = [("a", 3.0, 60.0), ("b", -3.0, 1.0), ("c", 0.1, -80.0), ("d", 0.1, 1.0), ("e", None, 10.0)]
    df = spark.createDataFrame(rows_, "metric string, z_score_30d double, vs_7d_avg_pct double")
    got = dict(rows(anomaly_shortlist(df, 2, 50), "metric", "status"))
    assert got == {"a": "level and spread", "b": "spread", "c": "level", "e": "not comparable"}


def test_calendar_is_longer_than_any_recursion_limit(spark):
    assert calendar(spark, date(2000, 1, 1), date(2024, 12, 31)).count() == 9132


def test_spine_fill_keep_and_availability(spark):
    daily = spark.createDataFrame([(day(1), 5, None)], "dt date, a int, b int")
    got = on_spine(calendar(spark, day(0), day(1)), daily, fill={"a": 0}, available="ok")
    assert rows(got, "dt", "a", "b", "ok") == [(day(0), 0, None, 0), (day(1), 5, None, 1)]


def test_total_is_available_only_with_all_parts(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1)], "x int, y int")
    assert [r[0] for r in df.select(available_only_if("x", "y")).collect()] == [1, 0, 0]


def test_shift(spark):
    df = spark.createDataFrame([(date(2024, 2, 28),)], "dt date")
    assert rows(shift_date(df, 1)) == [(date(2024, 2, 29),)]


def test_fill_gaps_equals_the_spine_join(spark):
    data = [(day(3), "x", 1), (day(5), "x", 2), (day(0), "y", 7), (day(9), "y", 8), (day(4), None, 3)]
    daily = spark.createDataFrame(data, "dt date, d string, n int")
    filled = fill_gaps(daily, day(0), day(9), ["d"], {"n": 0}, available="ok")
    known = daily.where("d is not null")
    spine = dimension_spine(known.select("d").distinct(), day(0), day(9))
    joined = on_spine(spine, known, ["dt", "d"], {"n": 0}, "ok")
    columns = ["dt", "d", "n", "ok"]
    assert rows(filled.where("d is not null"), *columns) == rows(joined, *columns)
    assert filled.count() == 30
