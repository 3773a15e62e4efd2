"""Numbers of rows in order, and folds over ordered rows, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def numbered(df: DataFrame, by: Sequence[str], order: Iterable) -> DataFrame:
    """The rows with ``_no``, their number from 1 by ``order`` within ``by``.

    Rows are dealt by ranges of the order and sorted there; what stands before a range is a sum
    over counts, one for each range and group that meet. The dealt rows are cached, so that counts
    and rows speak of the same ranges; see ``release``.
    """
    keys = [F.col(c) for c in by]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).persist()
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        dealt.groupBy(*by, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_range"), "_first", "_before")
    )
    same = F.col("_part") == F.col("_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    placed = dealt.join(counts, same).withColumn("_no", F.col("_at") - F.col("_first") + F.col("_before") + 1)
    placed = placed.drop("_at", "_part", "_range", "_first", "_before", *[f"_of_{c}" for c in by])
    placed.dealt = dealt
    return placed


def release(placed: DataFrame) -> None:
    """Let go of what ``numbered`` cached."""
    placed.dealt.unpersist()


def running_states(events: DataFrame, key: str, effect: str, states: int, start: int) -> DataFrame:
    """``key, _no, before, after``: the state of each key before and after each of its numbered events.

    ``effect`` spells what an event does to each of the states, a character (``A`` for the first) for each;
    done one after the other, effects make an effect again. So a block of events folds to one effect,
    blocks of blocks likewise, as often as the longest history asks for; then the states at which blocks
    start are handed down. No group is larger than a block.
    """
    same = "".join(chr(65 + n) for n in range(states))

    def then(effects: Column, done: Column) -> Column:
        return F.call_function("translate", effects, F.lit(same), done)

    def blocks(rows: DataFrame, place: Column) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("f")))).alias("parts")
        grouped = rows.groupBy(key, F.floor(place / BLOCK).cast("long").alias("b")).agg(parts)
        return grouped.withColumn("f", F.aggregate("parts", F.lit(same), lambda acc, x: then(acc, x["f"])))

    most = events.agg(F.max("_no")).first()[0] or 0
    levels = [blocks(events.select(key, (F.col("_no") - 1).alias("_p"), F.col(effect).alias("f")), F.col("_p"))]
    size = -(-most // BLOCK)
    while size > 1:
        levels.append(blocks(levels[-1].select(key, "b", "f").withColumnRenamed("b", "_p"), F.col("_p")))
        size = -(-size // BLOCK)
    begun = levels[-1].select("*", F.lit(chr(65 + start)).alias("s"))
    for depth in range(len(levels) - 1, -1, -1):
        walked = F.aggregate("parts", F.array("s"), lambda acc, x: F.concat(acc, F.array(then(F.element_at(acc, -1), x["f"]))))
        steps = F.arrays_zip(F.col("parts.p").alias("p"), F.slice(walked, F.lit(1), F.size("parts")).alias("before"), F.slice(walked, F.lit(2), F.size("parts")).alias("after"))
        each = begun.select(key, F.inline(steps))
        if depth == 0:
            return each.select(key, (F.col("p") + 1).alias("_no"), "before", "after")
        starts = each.select(F.col(key).alias("_key"), F.col("p").alias("_b"), F.col("before").alias("s"))
        lower = levels[depth - 1]
        begun = lower.join(starts, (lower[key] == starts["_key"]) & (lower["b"] == starts["_b"])).drop("_key", "_b")
    raise AssertionError("there is a level of events")
