"""Lifecycle and revenue movements of a day in one pass over the user-days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.lifecycle import (
    CHURN_AFTER, SLEEP_AFTER, absent_until, activity_state, prev_next_active,
)
from tideline.operators.revenue import in_money, inline_some, movement_steps, moved_names, revenue_changes, spell_out


def daily_movements(
    days: DataFrame,
    first: date,
    last: date,
    dims: Sequence[str],
    user: str,
    streams: Mapping[str, str],
    axis: int,
    history: int,
    active: str | None = None,
    rows: str | None = None,
) -> DataFrame:
    """One row per axis day and dims with everything the lifecycle reports count.

    ``days`` has one row per user-day (and dims) with ``day_index`` and a money column per
    stream, NULL or zero where nothing was paid. ``active`` marks the rows that are
    activity (all of them by default). ``rows`` counts source rows folded into one:
    those beyond the first follow a row of the same day, so they retain (or are new).

    Every user-day contributes small structs: to its own day, to the days on which its
    user falls asleep or churns, to the days on which its revenue changes windows. User
    partitioning from the activity window carries through to the revenue window, so the
    user-days are read and shuffled by user once; what leaves that stage is folded to
    day and dims.

    Columns: ``traffic_<state>`` counts; ``resurrected`` as an array whose j-th entry is
    the count in the eyes of the run j days later, which knows ``history`` days and cannot
    call back a user it never saw; ``<stream>_<move>`` undivided amounts; ``n_events``;
    ``cover``, the paying user-days within reach; ``last_seen``, the latest user-day.
    """
    dims = list(dims)
    index, gap = F.col("day_index"), F.datediff("dt", "prev_active_dt")
    is_active = F.coalesce(F.col(active), F.lit(False)) if active else F.lit(True)
    on_axis = F.col("dt").between(F.lit(first), F.lit(last))
    state = activity_state(gap, index)
    n = F.col(rows) if rows else F.lit(1)
    pays = F.lit(False)
    for column in streams.values():
        pays = pays | F.coalesce(F.col(column) > 0, F.lit(False))

    # How many runs, counted from the day after, still know the previous active day.
    known_by = F.least(F.lit(history) - gap, F.lit(axis))
    no_money = [F.lit(0).cast("bigint").alias(f"{s}_{w}") for s in streams for w in ("past", "prev", "new")]
    no_run = F.lit(0).alias("known_by")

    def tally(n_events: Column, label: Column, runs: Column = no_run, seen: Column | None = None) -> list[Column]:
        return [
            n_events.cast("int").alias("n_events"),
            label.alias("state"),
            runs.alias("known_by"),
            (F.lit(None).cast("date") if seen is None else seen).alias("last_seen"),
        ]

    nobody = tally(F.lit(0), F.lit(None).cast("string"))
    present = is_active & on_axis
    opening = tally(
        F.when(present, n).otherwise(0),
        F.when(present, state),
        F.when(present & (state == "resurrected"), known_by).otherwise(0),
        F.col("dt"),
    )

    def later(after: int, name: str) -> Column:
        """Absence on a later day: no money, one event."""
        day = F.date_add("dt", after)
        cond = is_active & absent_until(after) & day.between(F.lit(first), F.lit(last))
        fields = tally(F.lit(1), F.lit(name))
        return F.when(cond, F.struct(day.alias("_day"), F.lit(0).alias("cover"), *no_money, *fields))

    parts = [
        *revenue_changes(
            first, last, streams, pays, others=nobody, opening=opening, opens=on_axis | F.col("_last_before")
        ),
        later(SLEEP_AFTER, "sleeping"),
        later(CHURN_AFTER, "churned"),
    ]
    # Before the axis only the latest user-day of a stay in one dims tuple matters.
    by_user = Window.partitionBy(user).orderBy("dt")
    following = F.lead(F.struct("dt", *dims)).over(by_user)
    same = following["dt"] < F.lit(first)
    for dim in dims:
        same = same & following[dim].eqNullSafe(F.col(dim))
    seen = prev_next_active(days, user, active).withColumn(
        "_last_before", ~F.coalesce(same, F.lit(False))
    )
    changes = inline_some(seen, [user, *dims], parts)
    names = list(streams)
    steps = movement_steps(changes, dims, user, names)

    def counted(label: str, events: Column | None = None) -> Column:
        return F.sum(F.when(F.col("state") == label, F.col("n_events") if events is None else events).otherwise(0))

    # Of several rows folded into a user-day the first has the day's state, the others
    # follow it on the same day and retain.
    again = F.when(F.col("state").isin("resurrected", "other_active"), F.col("n_events") - 1).otherwise(0)
    by_run = {f"_run_{j}": F.sum(F.when(F.col("known_by") >= j, 1).otherwise(0)) for j in range(1, axis + 1)}
    daily = spell_out(
        steps, first, last, dims,
        running=["cover", *moved_names(names)],
        once={
            "n_events": F.sum("n_events"),
            "traffic_new": counted("new"),
            "traffic_retaining": counted("retaining") + F.sum(again),
            "traffic_sleeping": counted("sleeping"),
            "traffic_churned": counted("churned"),
            **by_run,
            **{f"{s}_new": F.sum(f"{s}_new") for s in names},
        },
        latest=["last_seen"],
    )
    amounts = [*moved_names(names), *[f"{s}_new" for s in names]]
    return in_money(daily.withColumn("resurrected", F.array(*by_run)).drop(*by_run), amounts)


def seen_by_run(daily: DataFrame) -> DataFrame:
    """``traffic_resurrected`` as the row's run date sees it."""
    return daily.withColumn(
        "traffic_resurrected", F.element_at("resurrected", F.datediff("run_date", "dt"))
    ).drop("resurrected")
