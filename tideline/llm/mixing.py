"""Mixing sources to target weights by entropy balancing.

Of all document rates that give every source its target of words, the balanced ones are
nearest to "each document once" in relative entropy, none above ``MOST`` copies. They are
``min(MOST, exp(lambda * size / mean size))`` with one multiplier a source, the zero of the
derivative of a convex dual. Newton's method finds all multipliers at once: each iteration is
one fold of the histogram (source, size) -> documents, which is all the dual depends on and
holds a hot source in no more rows than it has different sizes. Multipliers stay in a table.

Rates become copies stratum by stratum: a source's documents fall into strata of about
``STRATUM`` by hash, and within one, from the longest on, each gets the whole number of copies
that keeps the words taken nearest to the words due, so that errors shrink with the sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.bytework import buffers, sliced
from tideline.llm.frames import LAST_ID, checkpointed, fresh

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
STRATUM = 4096
ITERATIONS = 60
NEAR = 1e-9
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def word_counts(column) -> np.ndarray:
    """Runs of characters other than ASCII white space in each text."""
    data, off = buffers(column)
    inside = ~WHITE[data]
    first = np.zeros(len(data), bool)
    first[off[:-1][off[:-1] < len(data)]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    total = np.concatenate([[0], np.cumsum(start, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def sized(docs: DataFrame, text: str, carry: list[str], size: str) -> DataFrame:
    """The columns ``carry`` and the word count ``size``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(word_counts(batch.column(0)), pa.int64())], [*batch.schema.names[1:], size])

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes if c in carry), f"`{size}` long"])
    read = F.coalesce(F.col(text).cast("string"), F.lit("")).alias(fresh(docs, "_text")[0])
    return docs.select(read, *(F.col(f"`{c}`") for c in docs.columns if c in carry)).mapInArrow(count, schema)


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (no, src, total, n): one row a source, so one window may order them all.

    Sources weigh ``weights`` in turn, by code point, null last. A source stops at ``most`` times its
    size and leaves the rest to the others: sorted by size for weight, the first source that does
    not stop fixes the words for each unit of weight.
    """
    place = (F.row_number().over(Window.orderBy("no", "src")) - 1) % len(weights)
    w = F.array(*(F.lit(float(x)) for x in weights))[place]
    df = totals.withColumn("w", w).withColumn("cap", F.col("total") * float(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "no", "src")
    df = (
        df.withColumn("goal", F.sum("total").over(Window.partitionBy()) * share)
        .withColumn("taken", F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("rest", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rank", F.row_number().over(by_cap))
    )
    unit = (F.col("goal") - F.coalesce("taken", F.lit(0.0))) / F.col("rest")
    df = df.withColumn("unit", F.when(F.col("cap") > F.col("w") * unit, unit)).withColumn(
        "unit", F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col("rank"))).over(Window.partitionBy())
    )
    return df.select("no", "src", "total", "n", F.least("cap", F.coalesce(F.col("w") * F.col("unit"), F.col("cap"))).alias("target"))


def balanced(histogram: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """Adds ``lambda`` to ``goals``; null where every document is taken ``most`` times."""
    key = ["no", "src"]
    full = F.col("target") >= F.col("total") * float(most) * (1 - 1e-12)
    state = checkpointed(
        goals.withColumns(
            {"mean": F.greatest(F.col("total") / F.col("n"), F.lit(1e-9)), "lambda": F.when(full, None).otherwise(0.0), "low": F.lit(-500.0), "high": F.lit(500.0), "off": F.lit(None).cast("double")}
        )
    )
    same = lambda a, b: [F.col(f"{a}.no") == F.col(f"{b}.no"), F.col(f"{a}.src") == F.col(f"{b}.src")]
    for _ in range(ITERATIONS):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lambda") * x, F.lit(50.0)))
        words = F.col("docs") * F.col("size")
        met = histogram.alias("h").join(state.where("lambda is not null").alias("s"), same("h", "s"))
        folded = met.groupBy(F.col("h.no").alias("no"), F.col("h.src").alias("src")).agg(
            F.sum(words * F.least(rate, F.lit(float(most)))).alias("f"), F.sum(F.when(rate < most, words * x * rate).otherwise(0.0)).alias("d")
        )
        above = F.col("f") > F.col("target")
        low, high = F.when(above, F.col("low")).otherwise(F.col("lambda")), F.when(above, F.col("lambda")).otherwise(F.col("high"))
        # A Newton step for log f, as f is nearly exponential; halving where that leaves the bracket.
        step = F.col("lambda") - (F.ln("f") - F.ln("target")) * F.col("f") / F.nullif("d", F.lit(0.0))
        inside = (step > low) & (step < high)
        off = F.abs(F.col("f") / F.col("target") - 1)
        moved = state.alias("s").join(folded.alias("f_"), same("s", "f_"), "left").select(
            *(F.col(f"s.{c}").alias(c) for c in ("no", "src", "total", "n", "target", "mean")),
            F.when(off < NEAR, F.col("lambda")).when(inside, step).otherwise((low + high) / 2).alias("lambda"),
            low.alias("low"), high.alias("high"), off.alias("off"),
        )
        state = checkpointed(moved)
        worst = state.agg(F.max("off").alias("off")).first()["off"]
        if worst is None or worst < NEAR:
            break
    # Sums of doubles depend on their order in the last places; reruns must not.
    return state.withColumn("lambda", F.round("lambda", 9)).select("no", "src", "total", "n", "target", "mean", "lambda")


def mix(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None, seed: str = "mix"
) -> DataFrame:
    """The columns ``carry`` (all) of every row of ``docs``, then ``_size``, ``_source_size``, ``_target``, ``_rate``, ``_copies``, ``_taken``.

    Sizes are words, 0 for null and blank texts, which get no copies. Rows with a null source form
    one source, the last. Null ids are as good as any; repeated rows count each time, and equal
    ones share their stratum's copies in any order. Input columns of the added names are dropped.
    """
    docs = docs.drop("_size", "_source_size", "_target", "_rate", "_copies", "_taken")
    carry = [c for c in docs.columns if carry is None or c in carry]
    no, src, order, spread, lam, mean, strata, stratum = fresh(docs, "_no", "_src", "_order", "_spread", "_lambda", "_mean", "_strata", "_stratum")
    identity: dict[str, Column] = {
        no: F.col(source).isNull(),
        src: F.coalesce(F.col(source).cast("string"), F.lit("")),
        order: F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)),
        spread: F.xxhash64(F.lit(seed), F.col(id_column), F.xxhash64(F.col(text))),
    }
    rows = sized(docs.withColumns(identity), text, [*carry, no, src, order, spread], "_size")
    slim = sized(docs.withColumns({no: identity[no], src: identity[src]}), text, [no, src], "_size")

    histogram = checkpointed(slim.groupBy(F.col(no).alias("no"), F.col(src).alias("src"), F.col("_size").alias("size")).agg(F.count("*").alias("docs")))
    totals = histogram.groupBy("no", "src").agg(F.sum(F.col("docs") * F.col("size")).alias("total"), F.sum("docs").alias("n"))
    solved = balanced(histogram.where("size > 0"), targets(totals))

    plan = solved.select(
        F.col("no").alias(no), F.col("src").alias(src),
        F.col("total").alias("_source_size"), F.col("target").alias("_target"), F.col("lambda").alias(lam), F.col("mean").alias(mean),
        F.ceil(F.col("n") / STRATUM).alias(strata),
    )
    rate = F.when(F.col(lam).isNull(), float(MOST)).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(F.col(lam) * F.col("_size") / F.col(mean), F.lit(50.0)))))
    joined = rows.join(plan, [no, src]).withColumns({"_rate": rate, stratum: F.expr(f"pmod(`{spread}`, `{strata}`)")})
    dealt = joined.repartition(no, src, stratum).sortWithinPartitions(no, src, stratum, F.desc("_size"), order, spread)
    out = [*carry, "_size", "_source_size", "_target", "_rate"]

    def round_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, due, taken = None, 0.0, 0
        for batch in batches:
            copies = []
            for a, b, c, size, r in zip(*(batch.column(x).to_pylist() for x in (no, src, stratum, "_size", "_rate")), strict=True):
                if (a, b, c) != current:
                    current, due, taken = (a, b, c), 0.0, 0
                due += r * size
                k = min(MOST, max(0, int((due - taken) / size + 0.5))) if size else 0
                taken += k * size
                copies.append(k)
            k = pa.array(copies, pa.int64())
            words = pa.array(np.asarray(copies, np.int64) * batch.column("_size").to_numpy(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), k, words], [*out, "_copies", "_taken"])

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes if c in carry), "_size long, _source_size long, _target double, _rate double, _copies long, _taken long"])
    return dealt.select(*out, no, src, stratum).mapInArrow(round_off, schema)
