"""Rolling actives, lifecycle, revenue and levels, against brute force and by edge case."""

import random
import struct
from datetime import timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import day, rows
from tideline.operators.actives import rolling_distinct, trailing_sums
from tideline.operators.aggregates import daily_distinct, exact_percentiles, merge_user_days, order_key
from tideline.operators.economy import ratio_of_sums, sold_per_day
from tideline.operators.levels import asof_level, latest_per_key, period_to_date_level
from tideline.operators.lifecycle import lifecycle_counts, lifecycle_events
from tideline.operators.movements import daily_movements
from tideline.operators.revenue import mrr_movements, per_day, revenue_movements, rolling_revenue


def test_rolling_distinct_against_brute_force(spark):
    rng = random.Random(7)
    data = [(day(rng.randrange(0, 75)), rng.randrange(12), rng.choice("ab")) for _ in range(160)]
    # Day 75 onwards is silent, so the end of the axis has no user at all.
    first, last = 20, 115
    active = spark.createDataFrame(data + data[:20], "dt date, u int, region string")
    expected = []
    for n in range(first, last + 1):
        t = day(n)
        regions = {r for d, _, r in data if t - timedelta(days=29) <= d <= t}
        for r in regions or {None}:
            near = lambda w: {u for d, u, x in data if x == r and t - timedelta(days=w - 1) <= d <= t}
            expected.append((t, r, len(near(1)), len(near(7)), len(near(30))))
    got = rolling_distinct(spark, active, day(first), day(last), ["region"], "u")
    assert rows(got) == sorted(expected, key=repr)


def test_trailing_sums_equal_a_range_join(spark):
    data = [(day(n), k, n + 1) for n in (0, 3, 4, 20) for k in "xy"]
    got = trailing_sums(spark.createDataFrame(data, "dt date, k string, v int"), day(2), day(8), ["k"], ["v"], 4)
    expected = []
    for n in range(2, 9):
        for k in "xy":
            inside = [v for d, x, v in data if x == k and day(n - 3) <= d <= day(n)]
            if inside:
                expected.append((day(n), k, sum(inside)))
    assert rows(got) == sorted(expected, key=repr)


def events_of(spark, days_, first, last):
    df = spark.createDataFrame(days_, "dt date, u int, day_index int, region string")
    events = lifecycle_events(df, day(first), day(last), ["region"], "u")
    return rows(events, "dt", "region", "state")


def test_gap_edges(spark):
    for gap, age, state in [(7, 7, "retaining"), (8, 8, "other_active"), (30, 30, "other_active"), (31, 31, "resurrected"), (31, 29, "other_active")]:
        got = events_of(spark, [(day(0), 1, age - gap, "r"), (day(gap), 1, age, "r")], gap, gap)
        assert (day(gap), "r", state) in got, (gap, age, got)


def test_return_on_day_8_prevents_sleep(spark):
    alone = events_of(spark, [(day(0), 1, 5, "r")], 0, 30)
    assert (day(8), "r", "sleeping") in alone and (day(30), "r", "churned") in alone
    back = events_of(spark, [(day(0), 1, 5, "r"), (day(8), 1, 13, "r")], 0, 30)
    assert (day(8), "r", "sleeping") not in back and (day(16), "r", "sleeping") in back


def test_return_on_day_30_prevents_churn(spark):
    got = events_of(spark, [(day(0), 1, 5, "r"), (day(30), 1, 35, "r")], 0, 30)
    assert (day(30), "r", "churned") not in got and (day(8), "r", "sleeping") in got
    got = events_of(spark, [(day(0), 1, 5, "r"), (day(31), 1, 36, "r")], 0, 31)
    assert (day(30), "r", "churned") in got and (day(31), "r", "resurrected") in got


def test_absence_carries_the_dims_of_the_last_active_day(spark):
    got = events_of(spark, [(day(0), 1, 0, "old"), (day(1), 1, 1, "new")], 0, 9)
    assert (day(9), "new", "sleeping") in got and not any(r == "old" and s == "sleeping" for _, r, s in got)


def test_unknown_age_is_never_new_nor_resurrected(spark):
    got = {s for _, _, s in events_of(spark, [(day(0), 1, None, "r"), (day(3), 1, None, "r"), (day(40), 1, None, "r")], 0, 40)}
    assert "new" not in got and "resurrected" not in got and "retaining" in got


def test_only_other_activity_still_gives_a_row_of_zeros(spark):
    df = spark.createDataFrame([(day(0), 1, 9, "r")], "dt date, u int, day_index int, region string")
    counts = lifecycle_counts(lifecycle_events(df, day(0), day(0), ["region"], "u"), ["dt", "region"])
    assert rows(counts) == [(day(0), "r", 0, 0, 0, 0, 0)]


def random_days(seed, n=220, users=9, span=150):
    rng = random.Random(seed)
    seen = {}
    for _ in range(n):
        u, d = rng.randrange(users), rng.randrange(span)
        amount = rng.choice([None, Decimal("0.00"), Decimal(rng.randrange(1, 9999)) / 100])
        seen[(u, d)] = (day(d), u, rng.choice([d, d % 40, None]), rng.choice("ab"), rng.choice("xy"), amount)
    return list(seen.values())


DAYS = "dt date, u int, day_index int, region string, tier string, paid decimal(18,2)"


@pytest.mark.parametrize("seed, first, last", [(1, 0, 149), (2, 70, 77), (3, 100, 140)])
def test_revenue_changes_equal_the_rolling_form(spark, seed, first, last):
    df = spark.createDataFrame(random_days(seed), DAYS).where("paid > 0")
    dims, streams = ["region", "tier"], {"paid": "paid"}
    rolled = rolling_revenue(df, day(first), day(last), dims, "u", streams)
    slow = mrr_movements(rolled, ["dt", *dims], ["paid"])
    fast = per_day(revenue_movements(df, day(first), day(last), dims, "u", streams), ["dt", *dims], ["paid"])
    assert rows(fast) == rows(slow)


def test_rolling_revenue_against_brute_force(spark):
    data = [r for r in random_days(6) if r[5]]
    first, last = 40, 60
    expected = []
    for n in range(first, last + 1):
        for key in {r[1:2] + r[3:5] for r in data}:
            mine = [r for r in data if r[1:2] + r[3:5] == key and day(n - 60) <= r[0] <= day(n)]
            if not mine:
                continue

            def paid(a, b, young=False):
                inside = [r[5] for r in mine if day(n - b) <= r[0] <= day(n - a) and (not young or (r[2] is not None and r[2] < 30))]
                return sum(inside, Decimal("0.00"))

            expected.append((day(n), *key, paid(0, 0, True), paid(1, 30), paid(31, 60)))
    df = spark.createDataFrame(data, DAYS)
    got = rolling_revenue(df, day(first), day(last), ["region", "tier"], "u", {"paid": "paid"})
    assert rows(got) == sorted(expected, key=repr)


@pytest.mark.parametrize("seed", [4, 5])
def test_one_pass_movements_equal_the_single_operators(spark, seed):
    df = spark.createDataFrame(random_days(seed), DAYS)
    first, last, dims = day(80), day(95), ["region", "tier"]
    daily = daily_movements(df, first, last, dims, "u", {"paid": "paid"}, axis=16, history=1000)
    counts = lifecycle_counts(lifecycle_events(df, first, last, dims, "u"), ["dt", *dims])
    shown = daily.where("n_events > 0").withColumn("traffic_resurrected", F.element_at("resurrected", 1))
    columns = ["dt", *dims, *[c for c in counts.columns if c.startswith("traffic")]]
    assert rows(shown, *columns) == rows(counts, *columns)
    alone = revenue_movements(df.where("paid > 0"), first, last, dims, "u", {"paid": "paid"})
    keys = ["dt", *dims]
    assert rows(per_day(daily.where("cover > 0"), keys, ["paid"])) == rows(per_day(alone, keys, ["paid"]))


def test_folded_source_rows_count_as_retaining(spark):
    df = spark.createDataFrame(
        [(day(0), 1, 0, "r", 1), (day(20), 1, 20, "r", 3)], "dt date, u int, day_index int, region string, n long"
    ).withColumn("paid", F.lit(None).cast("decimal(18,2)"))
    daily = daily_movements(df, day(20), day(20), ["region"], "u", {"paid": "paid"}, 1, 100, rows="n")
    # One row 20 days after the last (other activity) and two repeats at distance 0.
    assert rows(daily, "n_events", "traffic_retaining", "traffic_new") == [(3, 2, 0)]


def paying(spark, *purchases):
    return spark.createDataFrame([(day(d), 1, 90, "r", Decimal(a)) for d, a in purchases], "dt date, u int, day_index int, region string, paid decimal(18,2)")


def moves_on(spark, n, *purchases):
    got = per_day(revenue_movements(paying(spark, *purchases), day(n), day(n), ["region"], "u", {"paid": "paid"}), ["dt", "region"], ["paid"])
    return [r[2:] for r in rows(got)]


def test_equal_windows_expand_by_nothing(spark):
    assert moves_on(spark, 70, (20, "30.00"), (50, "30.00")) == [(0.0, 0.0, 0.0, 0.0)]


def test_nothing_in_the_past_window_is_churn(spark):
    assert moves_on(spark, 70, (20, "60.00")) == [(0.0, 0.0, 0.0, 2.0)]


def test_nothing_before_is_no_movement(spark):
    assert moves_on(spark, 70, (50, "60.00")) == [(0.0, 0.0, 0.0, 0.0)]


def test_contraction_and_window_edges(spark):
    assert moves_on(spark, 70, (40, "30.00"), (39, "90.00")) == [(0.0, 0.0, 2.0, 0.0)]
    assert moves_on(spark, 70, (9, "30.00")) == []


def levels_of(spark, activity, levels_, op, **kw):
    a = spark.createDataFrame([(day(d), 1) for d in activity], "dt date, u int")
    b = spark.createDataFrame([(day(d), 1, v) for d, v in levels_], "dt date, u int, level int")
    return [r[2] for r in rows(op(a, b, "u", **kw))]


def test_asof_look_back_edges(spark):
    assert levels_of(spark, [30], [(0, 5)], asof_level) == [5]
    assert levels_of(spark, [31], [(0, 5)], asof_level) == [0]
    assert levels_of(spark, [3], [(3, 5), (4, 9)], asof_level) == [5]
    assert levels_of(spark, [9], [(1, 8), (5, 2)], asof_level) == [2]


def test_period_level_stays_in_its_half_month(spark):
    # day(14) is the 15th, day(15) the 16th.
    assert levels_of(spark, [14, 15, 17], [(2, 9), (10, 4), (16, 3)], period_to_date_level) == [9, None, 3]


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, day(0), 3), (1, day(2), 1), (2, day(1), 4)], "u int, t date, v int")
    assert rows(latest_per_key(df, ["u"], "t", ["v"])) == [(1, day(2), 1), (2, day(1), 4)]


@pytest.mark.parametrize("hot", [0, 3000])
def test_percentiles_equal_numpy(spark, hot):
    rng = random.Random(3)
    values = [round(rng.choice([-1, 1]) * rng.lognormvariate(3, 2), 2) for _ in range(700)] + [12.5] * hot + [0.0, 0.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("one", 4.0), ("none", None)], "k string, v double")
    points = [0.0, 0.25, 0.5, 0.9, 0.99, 0.999, 1.0]
    got = {(k, p): v for k, p, v in rows(exact_percentiles(df, ["k"], "v", points))}
    for p in points:
        assert got[("g", p)] == pytest.approx(float(np.percentile(values, p * 100)), abs=1e-9)
        assert got[("one", p)] == 4.0
    assert not any(k == "none" for k, _ in got)


def test_percentiles_scan_and_fold_once(spark, tmp_path):
    path = str(tmp_path / "values")
    spark.range(1000).selectExpr("id % 3 as k", "cast(id as double) as v").write.parquet(path)
    got = exact_percentiles(spark.read.parquet(path), ["k"], "v", [0.5])
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") >= 1


def test_percentiles_of_odd_and_crowded_values(spark):
    nan, inf = float("nan"), float("inf")
    crowd = [1000 + k * 1e-5 for k in range(100_000)]  # all within a thousandth
    data = [("crowd", v) for v in crowd] + [("odd", v) for v in (nan, inf, -inf, 5e-324, -5e-324, 0.0, -0.0, 1e308, nan)] + [("nan", nan), (None, 1.0)]
    got = {(k, p): v for k, p, v in rows(exact_percentiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", [0.0, 0.25, 0.5, 0.999, 1.0]))}
    for p in (0.0, 0.25, 0.5, 0.999, 1.0):
        assert got["crowd", p] == pytest.approx(float(np.percentile(crowd, p * 100)), abs=1e-9)
    # In order: -inf, -5e-324, 0, 0, 5e-324, 1e308, inf, nan, nan
    assert [got["odd", p] for p in (0.0, 0.25, 0.5)] == [-inf, 0.0, 5e-324]
    assert np.isnan(got["odd", 1.0]) and np.isnan(got["nan", 0.5]) and len(got) == 15


def test_order_keys_are_in_the_order_of_the_doubles(spark):
    rng = random.Random(5)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(2000)]
    for e in range(-1074, 1024, 7):
        values += [2.0**e, -(2.0**e), np.nextafter(2.0**e, 0).item(), np.nextafter(2.0**e, np.inf).item()]
    values = [v for v in values if v == v]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v")).alias("k")).collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["k"])] == sorted(values)
    assert len({r["k"] for r in got}) == len(set(values))


def test_distinct_counts_ignore_missing_users_and_count_once(spark):
    data = [(day(0), 1, 5), (day(0), 1, -1), (day(0), None, 9), (day(0), 2, -1)]
    df = spark.createDataFrame(data, "dt date, u int, v int")
    got = daily_distinct(df, ["dt"], "u", {"all": F.lit(True), "pos": F.col("v") > 0}, {"total": F.col("v")})
    assert rows(got) == [(day(0), 2, 1, 12)]


def test_merge_replaces_a_full_outer_join(spark):
    a = spark.createDataFrame([(1, "a")], "u int, x string")
    b = spark.createDataFrame([(1, 2), (2, 3)], "u int, y int")
    got = merge_user_days([a, b], ["u"], {"x": F.max("x"), "y": F.sum("y")})
    assert rows(got) == [(1, "a", 2), (2, None, 3)]


def test_ratio_counts_trading_days_not_calendar_days(spark):
    df = spark.createDataFrame([(day(0), 10, 1), (day(9), 20, 1), (day(10), 30, 0)], "dt date, b int, d int")
    got = ratio_of_sums(df, "b", "d", (1, 3))
    assert rows(got, "ratio_1", "ratio_3") == sorted([(10.0, 10.0), (20.0, 15.0), (None, 30.0)], key=repr)


def test_unnamed_and_unknown_products_do_not_sell(spark):
    sales = spark.createDataFrame([(day(0), p, 1, 10) for p in (1, 2, 3, 4)], "dt date, productid int, amountdollars int, amountbars int")
    products = spark.createDataFrame([(1, "pack"), (2, None), (3, "gift")], "id int, name string")
    assert rows(sold_per_day(sales, products, ["gift"])) == [(day(0), 1, 10)]
