"""Lifecycle, rolling actives and revenue day by day, from the day's own logs and a carried state.

A backfill reads the look-back of its range once; a job that runs every day would read it every day.
Here each step reads its own days and what the steps before left behind: of every user the user-days
that can still act. These are the last active day, which the next one is measured against and which
puts its user to sleep or to churn; the last active day in each dims tuple within the longest window,
which keeps its user in the rolling counts; and paying days until they have left both revenue
windows. Rows that act no more drop out, so a user is one row for good and at most some 60 more
while it pays; a step costs its logs and the state, however long the history is.

The state is hash-bucketed by user, so that a step shuffles the new days and never the state. Steps
make a chain of versions: each writes folders of its own and, last of all, a manifest that names its
parent. A step that dies leaves nothing that counts, and a step may follow any earlier version,
which takes those behind it out of the chain.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.actives import rolling_distinct
from tideline.operators.lifecycle import STATES, lifecycle_counts, lifecycle_events
from tideline.operators.revenue import MOVES, SPAN, per_day, revenue_movements
from tideline.sources import manifests

DAY = timedelta(days=1)


@dataclass(frozen=True)
class Shape:
    """What user-days look like: ``dt``, the user, ``day_index``, ``active``, dims and money columns."""

    user: str
    dims: tuple[str, ...]
    streams: Mapping[str, str]
    windows: tuple[int, ...] = (1, 7, 30)

    @property
    def columns(self) -> list[str]:
        return [self.user, "dt", "day_index", "active", *self.dims, *self.streams.values()]


def daily_results(spark: SparkSession, days: DataFrame, shape: Shape, first: date, last: date) -> DataFrame:
    """Rolling distinct actives, lifecycle counts and revenue movements of each axis day and dims.

    ``days`` holds one row for each user and day that matters to the axis; more rows do no harm.
    Columns: ``dt``, dims, ``active_<w>d``, ``traffic_<state>`` and ``<stream>_<move>``; a day and
    dims tuple without any count or amount has no row.
    """
    keys, dims = ["dt", *shape.dims], list(shape.dims)
    active = days.where("active")
    pays = F.lit(False)
    for column in shape.streams.values():
        pays = pays | F.coalesce(F.col(column) > 0, F.lit(False))
    rolling = rolling_distinct(spark, active.select("dt", *dims, shape.user), first, last, dims, shape.user, shape.windows)
    counts = lifecycle_counts(lifecycle_events(active, first, last, dims, shape.user), keys)
    moves = per_day(revenue_movements(days.where(pays), first, last, dims, shape.user, shape.streams), keys, list(shape.streams))
    actives = [f"active_{w}d" for w in shape.windows]
    traffic = [f"traffic_{s}" for s in STATES]
    amounts = [f"{s}_{m}" for s in shape.streams for m in MOVES]
    types = {**dict.fromkeys(actives + traffic, "bigint"), **{c: moves.schema[c].dataType for c in amounts}}

    def wide(df: DataFrame) -> DataFrame:
        return df.select(*keys, *[(F.col(c) if c in df.columns else F.lit(0)).cast(t).alias(c) for c, t in types.items()])

    # Each part has a row for a day and dims tuple at most: a fold sets them side by side, NULL dims too.
    met = wide(rolling).unionByName(wide(counts)).unionByName(wide(moves)).groupBy(*keys).agg(*[F.max(c).alias(c) for c in types])
    some = F.lit(False)
    for c in types:
        some = some | (F.col(c) != 0)
    return met.where(some)


def still_acting(days: DataFrame, shape: Shape, last: date) -> DataFrame:
    """Of user-days up to ``last`` those that a later day can depend on."""
    active_day = F.expr("if(active, dt, null)")
    by_user, by_dims = Window.partitionBy(shape.user), Window.partitionBy(shape.user, *shape.dims)
    pays = F.lit(False)
    for column in shape.streams.values():
        pays = pays | F.coalesce(F.col(column) > 0, F.lit(False))
    seen = days.withColumn("_last", F.max(active_day).over(by_user)).withColumn("_here", F.max(active_day).over(by_dims))
    rolls = (F.col("dt") == F.col("_here")) & (F.col("dt") > F.lit(last - timedelta(days=max(shape.windows) - 1)))
    keep = F.coalesce((F.col("active") & ((F.col("dt") == F.col("_last")) | rolls)), F.lit(False))
    keep = keep | (pays & (F.col("dt") >= F.lit(last - timedelta(days=2 * SPAN - 1))))
    return seen.where(keep).select(*shape.columns)


class Replay:
    """A chain of steps in a folder; ``logs(first, last)`` gives the user-days of a span.

    Days may arrive in one step or many: the results are those of one backfill over all of them.
    Rows that come for a day after its step are not taken up; let a new step follow the version
    before that day.
    """

    def __init__(self, spark: SparkSession, folder: str, shape: Shape, logs: Callable[[date, date], DataFrame], buckets: int = 64):
        self.spark, self.folder, self.shape, self.logs, self.buckets = spark, folder.rstrip("/"), shape, logs, buckets

    def versions(self) -> list[dict]:
        """The chain that ends in the newest step, oldest first."""
        found = {m["id"]: m for m in manifests.published(self.spark, f"{self.folder}/_versions")}
        chain = []
        at = max(found.values(), key=lambda m: m["saved_at"], default=None)
        while at:
            chain.append(at)
            at = found.get(at["parent"])
        return chain[::-1]

    def advance(self, first: date, last: date) -> None:
        """One step over ``first..last``, which must follow the last step or any earlier one."""
        chain = self.versions()
        parent = next((v for v in chain if v["last"] == str(first - DAY)), None)
        if first > last or (chain and parent is None and str(first) != chain[0]["first"]):
            raise ValueError(f"no version ends on the day before {first}")
        version = uuid.uuid4().hex
        now = self._kept(self.now(first, last, parent))
        try:
            daily_results(self.spark, now, self.shape, first, last).write.parquet(f"{self.folder}/results/{version}")
            self._write_state(still_acting(now, self.shape, last), version)
        finally:
            now.unpersist()
        line = {"id": version, "parent": parent and parent["id"], "first": first, "last": last, "buckets": self.buckets, "saved_at": time.time_ns()}
        manifests.publish(self.spark, f"{self.folder}/_versions", f"{last}-{version}", [line])

    def now(self, first: date, last: date, parent: dict | None) -> DataFrame:
        """What a step works on: the days of its span and the state of its parent, both by hash of the user."""
        new = self.logs(first, last).where(F.col("dt").between(F.lit(first), F.lit(last)) & F.col(self.shape.user).isNotNull())
        new = new.select(*self.shape.columns)
        new = new.repartition(self.buckets if parent is None else parent["buckets"], self.shape.user)
        return new if parent is None else self.state(parent).unionByName(new)

    def state(self, version: dict) -> DataFrame:
        """The carried user-days of a version, as a bucketed table."""
        name, path = f"replay_{version['id']}", f"{self.folder}/state/{version['id']}"
        if not self.spark.catalog.tableExists(name):
            columns = self.spark.read.parquet(path).schema
            spelled = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
            by = f"CLUSTERED BY (`{self.shape.user}`) SORTED BY (`{self.shape.user}`) INTO {version['buckets']} BUCKETS"
            self.spark.sql(f"CREATE TABLE {name} ({spelled}) USING parquet {by} LOCATION '{path}'")
        return self.spark.table(name)

    def results(self) -> DataFrame:
        """The daily results of all steps of the chain."""
        chain = self.versions()
        if not chain:
            raise ValueError("no step has been made")
        return self.spark.read.parquet(*[f"{self.folder}/results/{v['id']}" for v in chain])

    def expire(self, keep: int) -> None:
        """Drop the states of all but the newest ``keep`` steps of the chain; their results stay."""
        for version in self.versions()[: -keep or None]:
            self.spark.sql(f"DROP TABLE IF EXISTS replay_{version['id']}")
            manifests.remove(self.spark, f"{self.folder}/state/{version['id']}")

    @staticmethod
    def _kept(now: DataFrame) -> DataFrame:
        """The rows for the length of a step. Once filled, the cache knows that it is dealt by user: nothing deals them again."""
        now.persist().count()
        return now

    def _write_state(self, state: DataFrame, version: str) -> None:
        name, user = f"replay_{version}", self.shape.user
        dealt = state.repartition(self.buckets, user)
        dealt.write.bucketBy(self.buckets, user).sortBy(user).option("path", f"{self.folder}/state/{version}").saveAsTable(name)
