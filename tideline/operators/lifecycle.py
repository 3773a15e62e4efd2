"""User lifecycle: new, retaining, resurrected, sleeping, churned."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, and the days that tell them apart.
STATES = ("new", "retaining", "resurrected", "sleeping", "churned")
RETAIN_WITHIN = 7
SLEEP_AFTER = 8
CHURN_AFTER = 30


def prev_next_active(days: DataFrame, user: str, active: str | None = None) -> DataFrame:
    """Previous and next active day of each user-day.

    With ``active`` (a boolean column) rows of other days stay in place but are looked
    through, so one relation can serve activity and purchases alike.
    """
    day = f"if({active}, dt, null)" if active else "dt"
    over = f"ignore nulls over (partition by `{user}` order by dt)"
    return days.withColumns(
        {
            "prev_active_dt": F.expr(f"lag({day}) {over}"),
            "next_active_dt": F.expr(f"lead({day}) {over}"),
        }
    )


def activity_state(gap: Column, index: Column) -> Column:
    """State of an active day from its distance to the previous one and the account age."""
    return (
        F.when(index == 0, "new")
        .when(gap <= RETAIN_WITHIN, "retaining")
        .when((gap > CHURN_AFTER) & (index >= CHURN_AFTER), "resurrected")
        .otherwise("other_active")
    )


def absent_until(after: int) -> Column:
    """Not back by day + ``after``; a return exactly on that day counts as back."""
    back = F.col("next_active_dt") <= F.date_add("dt", after)
    return ~F.coalesce(back, F.lit(False))


def lifecycle_events(
    days: DataFrame,
    first: date,
    last: date,
    dims: Sequence[str],
    user: str,
    sleep: int = SLEEP_AFTER,
    churn: int = CHURN_AFTER,
) -> DataFrame:
    """State events ``dt, *dims, state, gap, n`` whose day lies on the axis.

    ``days`` has one row per user-day with ``day_index``. Each emits its own activity
    state on its day, ``sleeping`` on day + ``sleep`` and ``churned`` on day + ``churn``
    unless the user was back by then; both carry the dims of the last active day. All
    three come out of one pass over one window.

    ``gap`` is the distance to the previous active day, NULL without one.
    """
    seen = prev_next_active(days, user)
    gap = F.datediff("dt", "prev_active_dt")
    index = F.col("day_index")
    none = F.lit(None).cast("int")

    def event(day: Column, state: Column, gap_days: Column, cond: Column) -> Column:
        due = cond & day.between(F.lit(first), F.lit(last))
        fields = F.struct(day.alias("dt"), state.alias("state"), gap_days.alias("gap"), F.lit(1).cast("bigint").alias("n"))
        return F.when(due, fields)

    events = F.array(
        event(F.col("dt"), activity_state(gap, index), gap, F.lit(True)),
        event(F.date_add("dt", sleep), F.lit("sleeping"), none, absent_until(sleep)),
        event(F.date_add("dt", churn), F.lit("churned"), none, absent_until(churn)),
    )
    # Days that can reach the axis; everything else never gets to build its array.
    reach = F.col("dt").between(F.lit(first), F.lit(last))
    for after in (sleep, churn):
        reach = reach | F.col("dt").between(F.date_sub(F.lit(first), after), F.date_sub(F.lit(last), after))
    named = seen.where(reach).select(*dims, F.inline(events)).where(F.col("dt").isNotNull())
    return named.select("dt", *dims, "state", "gap", "n")


def lifecycle_counts(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Users per key and state; a key with nothing but other activity is a row of zeros."""
    return events.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("state") == s, F.col("n")).otherwise(0)).alias(f"traffic_{s}")
            for s in STATES
        ]
    )
