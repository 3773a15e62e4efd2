"""Steps with a carried state against one backfill over all days."""

import random
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import day, rows
from tideline.operators.replay import Replay, Shape, daily_results, still_acting
from tideline.sources import manifests

SHAPE = Shape("who", ("region", "tier"), {"paid": "paid", "sub": "sub"})
LAST = 75


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rng = random.Random(1)
    found = []
    for who in [None, *range(14)]:
        signup, often = rng.randrange(-40, 20), rng.choice([0.04, 0.15, 0.6])
        for n in range(max(0, signup), LAST + 1):
            if rng.random() < often:
                money = [rng.choice([None, Decimal(0), Decimal(rng.randint(1, 900)) / 100]) for _ in range(2)]
                found.append((who, day(n), n - signup, rng.random() < 0.9, rng.choice(["a", "b", None]), rng.choice(["x", "y"]), *money))
    path = str(tmp_path_factory.mktemp("replay") / "log")
    columns = "who long, dt date, day_index int, active boolean, region string, tier string, paid decimal(18,2), sub decimal(18,2)"
    spark.createDataFrame(found, columns).withColumn("day", F.col("dt").cast("string")).write.partitionBy("day").parquet(path)
    return path


def replay(spark, log, folder, **how):
    def logs(first, last):
        return spark.read.parquet(log).where(F.col("day").between(str(first), str(last)))

    return Replay(spark, str(folder), SHAPE, logs, buckets=4, **how)


def test_steps_equal_a_backfill_and_may_follow_any_version(spark, log, tmp_path, monkeypatch):
    steps = replay(spark, log, tmp_path)
    whole = rows(daily_results(spark, steps.logs(day(0), day(LAST)).where("who is not null"), SHAPE, day(0), day(LAST)))
    at = 0
    for size in (3, 1, 1, 30, 1, 20, 20):
        steps.advance(day(at), day(at + size - 1))
        at += size
    assert at == LAST + 1 and rows(steps.results()) == whole

    # A step that dies before its manifest leaves nothing that counts.
    chain = [v["id"] for v in steps.versions()]
    with monkeypatch.context() as broken:
        broken.setattr(manifests, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            steps.advance(day(35), day(40))
    assert [v["id"] for v in steps.versions()] == chain and rows(steps.results()) == whole
    # A step behind an earlier version takes the later ones out of the chain.
    steps.advance(day(35), day(LAST))
    assert [v["id"] for v in steps.versions()][:4] == chain[:4] and len(steps.versions()) == 5
    assert rows(replay(spark, log, tmp_path).results()) == whole
    for first, last in ((day(LAST + 2), day(LAST + 3)), (day(20), day(21)), (day(LAST + 1), day(LAST))):
        with pytest.raises(ValueError, match="no version"):
            steps.advance(first, last)

    # States of old versions can go; the chain still grows at its end.
    steps.expire(keep=1)
    steps.advance(day(LAST + 1), day(LAST + 40))
    late = rows(steps.results().where(F.col("dt") > F.lit(day(LAST))))
    assert late and {r[3] for r in late} == {0}
    assert not manifests.exists(spark, f"{tmp_path}/state/{chain[0]}")


def test_a_step_reads_its_days_and_deals_nothing_twice(spark, log, tmp_path):
    steps = replay(spark, log, tmp_path)
    steps.advance(day(0), day(9))
    version = steps.versions()[-1]
    now = steps.now(day(10), day(10), version)
    scan = next(line for line in now._jdf.queryExecution().executedPlan().toString().splitlines() if "/log]" in line)
    pruned = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert f">= {day(10)}" in pruned and f"<= {day(10)}" in pruned
    kept = steps._kept(now)
    try:
        plan = still_acting(kept, SHAPE, day(10))._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert "Window" in plan and "Exchange" not in plan
    finally:
        kept.unpersist()


def test_the_state_holds_what_can_still_act(spark):
    old = day(0)
    data = [(1, old, 5, True, "a", "x", None, None), (1, old + timedelta(days=70), 75, True, "a", "x", None, None),
            (2, old, 5, True, "a", "x", None, None), (3, old + timedelta(days=30), 5, False, "a", "x", Decimal(1), None),
            (3, old + timedelta(days=2), 5, False, "a", "x", Decimal(1), None)]
    days = spark.createDataFrame(data, "who long, dt date, day_index int, active boolean, region string, tier string, paid decimal(18,2), sub decimal(18,2)")
    assert rows(still_acting(days, SHAPE, old + timedelta(days=75)), "who", "dt") == [(1, day(70)), (2, day(0)), (3, day(30))]
