"""Rolling 30-day revenue and its movements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numbers import MONEY, round_ratio
from tideline.operators.actives import on_days

SPAN = 30
MOVES = ("new", "expansion", "contraction", "churned")


def rolling_revenue(
    paying: DataFrame, first: date, last: date, dims: Sequence[str], user: str,
    streams: Mapping[str, str],
) -> DataFrame:
    """Per axis day, user and dims: today's revenue of young accounts, the past 30 days
    and the 30 days before those.

    ``streams`` maps an output prefix to a money column; ``paying`` has one row per
    user-day and dims. The result has a row for each of the 61 axis days a purchase
    touches, but only its few changes (see ``revenue_changes``) are shuffled and sorted:
    each state between two changes is spelled out to days afterwards, in place.
    """
    keys, names = [user, *dims], list(streams)
    reach = F.col("dt").between(F.lit(first - timedelta(days=2 * SPAN)), F.lit(last))
    changes = inline_some(paying.where(reach), keys, revenue_changes(first, last, streams))
    timeline = Window.partitionBy(*keys).orderBy("_day")
    so_far = timeline.rowsBetween(Window.unboundedPreceding, 0)
    that_day = timeline.rangeBetween(0, 0)
    # Of several changes on one day all but the last span no day and vanish below.
    states = changes.select(
        *keys,
        "_day",
        F.col("_day").alias("_own"),
        F.coalesce(F.lead("_day").over(timeline), F.lit(last + timedelta(days=1))).alias("_until"),
        F.sum("cover").over(so_far).alias("cover"),
        *[F.sum(f"{s}_{w}").over(so_far).alias(f"{s}_{w}") for s in names for w in ("past", "prev")],
        *[F.sum(f"{s}_new").over(that_day).alias(f"{s}_today") for s in names],
    )
    daily = on_days(states, first, last).where(F.col("cover") > 0)
    today = {
        f"{s}_today": F.when(F.col("dt") == F.col("_own"), F.col(f"{s}_today")).otherwise(0) for s in names
    }
    amounts = [f"{s}_{w}" for s in names for w in ("today", "past", "prev")]
    return in_money(daily.withColumns(today), amounts).select("dt", *keys, *amounts)


def _moved(past: Column, prev: Column) -> dict[str, Column]:
    """30 times the daily movement between two adjacent 30-day windows."""
    zero = F.lit(0)
    return {
        "expansion": F.when((past >= prev) & (prev > 0), past - prev).otherwise(zero),
        "contraction": F.when((past < prev) & (past > 0), prev - past).otherwise(zero),
        "churned": F.when((prev > 0) & (past == 0), prev).otherwise(zero),
    }


def mrr_movements(rolling: DataFrame, keys: Sequence[str], streams: Sequence[str]) -> DataFrame:
    """New, expansion, contraction and churned revenue per key from ``rolling_revenue``.

    Amounts add up as exact decimals; the division by 30 and the rounding come last.
    """
    sums = []
    for s in streams:
        sums.append(F.sum(f"{s}_today").alias(f"{s}_new"))
        for move, amount in _moved(F.col(f"{s}_past"), F.col(f"{s}_prev")).items():
            sums.append(F.sum(amount).alias(f"{s}_{move}"))
    return per_day(rolling.groupBy(*keys).agg(*sums), keys, streams)


def per_day(moves: DataFrame, keys: Sequence[str], streams: Sequence[str]) -> DataFrame:
    """Turn summed window differences into daily amounts, two decimals."""
    out = []
    for s in streams:
        for move in MOVES:
            total = F.coalesce(F.col(f"{s}_{move}"), F.lit(0))
            days = F.lit(1 if move == "new" else SPAN)
            out.append(round_ratio(total, days, 2).alias(f"{s}_{move}"))
    return moves.select(*keys, *out)


def revenue_movements(
    paying: DataFrame, first: date, last: date, dims: Sequence[str], user: str,
    streams: Mapping[str, str],
) -> DataFrame:
    """Same result as ``mrr_movements(rolling_revenue(...))`` summed per day and dims,
    without a row per user and day; amounts still undivided (see ``per_day``)."""
    dims = list(dims)
    reach = F.col("dt").between(F.lit(first - timedelta(days=2 * SPAN)), F.lit(last))
    changes = inline_some(paying.where(reach), [user, *dims], revenue_changes(first, last, streams))
    steps = movement_steps(changes, dims, user, list(streams))
    amounts = moved_names(list(streams))
    once = {f"{s}_new": F.sum(f"{s}_new") for s in streams}
    daily = spell_out(steps, first, last, dims, running=["cover", *amounts], once=once)
    return in_money(daily.where(F.col("cover") > 0).drop("cover"), [*amounts, *once])


def inline_some(df: DataFrame, keys: Sequence[str], structs: Sequence[Column]) -> DataFrame:
    """One row per struct that is not NULL; all of them have a ``_day``.

    Filtering the rows instead of the array keeps the expression out of lambda
    functions, which Spark evaluates without code generation.
    """
    return df.select(*keys, F.inline(F.array(*structs))).where(F.col("_day").isNotNull())


def in_money(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whole hundredths back to amounts."""
    return df.withColumns(
        {c: (F.col(c).cast("decimal(19,0)") * F.lit(Decimal("0.01"))).cast("decimal(28,2)") for c in columns}
    )


def moved_names(streams: Sequence[str]) -> list[str]:
    return [f"{s}_{m}" for s in streams for m in MOVES if m != "new"]


def revenue_changes(
    first: date, last: date, streams: Mapping[str, str], pays: Column | None = None,
    others: Sequence[Column] = (), opening: Sequence[Column] | None = None,
    opens: Column | None = None,
) -> list[Column]:
    """What one user-day changes, and when: structs, NULL where nothing changes.

    A purchase enters the past window on the next day, moves to the window before after
    30 days and leaves after 60. The first struct opens the user-day, on its own day or,
    for days before the axis, on the axis' first day with the state reached by then. The
    others follow only where they change that state within the axis, so an old purchase
    costs one or two rows.

    Amounts are whole hundredths as bigint, exact for money and far cheaper to add up
    than wide decimals (see ``in_money``).

    ``others`` adds fields of other measures (zeros), ``opening`` their values in the
    first struct, and ``opens`` says for which user-days it is due beyond paying ones.
    """
    nothing = F.lit(0).cast("bigint")
    opening = others if opening is None else opening
    pays = F.lit(True) if pays is None else pays
    amounts = {
        name: F.coalesce((F.col(source).cast(MONEY) * 100).cast("bigint"), nothing) for name, source in streams.items()
    }
    start = F.greatest(F.col("dt"), F.lit(first))
    age = F.datediff(start, F.col("dt"))
    young = pays & (age == 0) & (F.col("day_index") < SPAN)

    def struct(day: Column, cover: Column, money: Mapping[str, tuple], extra: Sequence[Column]) -> Column:
        fields = [day.alias("_day"), cover.cast("int").alias("cover")]
        for name, (past, prev, new) in money.items():
            parts = {"past": past, "prev": prev, "new": new}
            fields += [v.alias(f"{name}_{k}") for k, v in parts.items()]
        return F.struct(*fields, *extra)

    def held(cond: Column, amount: Column) -> Column:
        return F.when(pays & cond, amount).otherwise(nothing)

    opened = struct(
        start,
        F.when(pays & (age <= 2 * SPAN), 1).otherwise(0),
        {
            name: (
                held(age.between(1, SPAN), a),
                held(age.between(SPAN + 1, 2 * SPAN), a),
                F.when(young, a).otherwise(nothing),
            )
            for name, a in amounts.items()
        },
        opening,
    )
    due = pays if opens is None else pays | opens
    changes = [F.when(due & (start <= F.lit(last)), opened)]
    for after, past, prev, cover in ((1, 1, 0, 0), (SPAN + 1, -1, 1, 0), (2 * SPAN + 1, 0, -1, -1)):
        day = F.date_add("dt", after)
        signs = (past, prev, 0)
        money = {
            name: tuple(a if s == 1 else -a if s == -1 else nothing for s in signs) for name, a in amounts.items()
        }
        changes.append(
            F.when(
                pays & (day > start) & (day <= F.lit(last)), struct(day, F.lit(cover), money, others)
            )
        )
    return changes


def movement_steps(
    changes: DataFrame, dims: Sequence[str], user: str, streams: Sequence[str]
) -> DataFrame:
    """Running windows per user and dims, as the *difference* each change makes.

    Between two changes nothing about a user moves, so summing differences per day and
    then over days gives the daily totals. Several changes on one day need no folding
    first: their differences telescope. One row per change, at most four per purchase,
    in place of one per user and axis day.
    """
    timeline = Window.partitionBy(user, *dims).orderBy("_day")
    so_far = timeline.rowsBetween(Window.unboundedPreceding, 0)
    windows = [f"{s}_{w}" for s in streams for w in ("past", "prev")]
    kept = [c for c in changes.columns if c not in windows]
    state = changes.select(
        *kept, *[F.sum(w).over(so_far).alias(w) for w in windows]
    )
    moved = {
        f"{s}_{move}": amount
        for s in streams
        for move, amount in _moved(F.col(f"{s}_past"), F.col(f"{s}_prev")).items()
    }
    state = state.select(*kept, *[a.alias(n) for n, a in moved.items()])
    return state.select(
        *kept,
        *[(F.col(n) - F.coalesce(F.lag(n).over(timeline), F.lit(0))).alias(n) for n in moved],
    )


def spell_out(
    steps: DataFrame, first: date, last: date, dims: Sequence[str], running: Sequence[str],
    once: Mapping[str, Column], latest: Sequence[str] = (),
) -> DataFrame:
    """Fold steps per day and dims, then one row per axis day and dims.

    ``running`` columns add up over days, ``once`` aggregates count on their own day
    only, ``latest`` columns carry their maximum forward. A dims tuple has a row on every
    day of the axis, zeros before its first step. Only the folded rows, a few per day
    and tuple, are sorted by day.
    """
    folded = steps.groupBy(*dims, "_day").agg(
        *[F.sum(c).alias(c) for c in running],
        *[expr.alias(c) for c, expr in once.items()],
        *[F.max(c).alias(c) for c in latest],
    )
    per_dim = Window.partitionBy(*dims).orderBy("_day")
    so_far = per_dim.rowsBetween(Window.unboundedPreceding, 0)
    end = F.lit(last + timedelta(days=1))
    opening = F.lag("_day").over(per_dim).isNull()
    totals = folded.select(
        *dims,
        F.col("_day").alias("_own"),
        F.when(opening, F.lit(first)).otherwise(F.col("_day")).alias("_day"),
        F.coalesce(F.lead("_day").over(per_dim), end).alias("_until"),
        *[F.sum(c).over(so_far).alias(c) for c in running],
        *once,
        *[F.max(c).over(so_far).alias(c) for c in latest],
    )
    daily = on_days(totals, first, last)

    def zero(c: str) -> Column:
        return F.lit(0).cast(daily.schema[c].dataType)

    begun, own = F.col("dt") >= F.col("_own"), F.col("dt") == F.col("_own")
    return daily.select(
        "dt",
        *dims,
        *[F.when(begun, F.col(c)).otherwise(zero(c)).alias(c) for c in running],
        *[F.when(own, F.col(c)).otherwise(zero(c)).alias(c) for c in once],
        *[F.when(begun, F.col(c)).alias(c) for c in latest],
    )
