"""Distinct counts, user-day grains and exact percentiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numbers import round_ratio


def daily_distinct(
    df: DataFrame,
    keys: Sequence[str],
    user: str,
    flags: Mapping[str, Column],
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Several conditional distinct-user counts (and sums) per key.

    Level one folds rows to one per key and user with map-side combining, so a user
    with a large share of all rows arrives as one row per input task. Level two only
    adds flags up. A flag counts a user once any of its rows satisfies it.
    """
    sums = sums or {}
    per_user = df.groupBy(*keys, user).agg(
        *[F.bool_or(cond).alias(name) for name, cond in flags.items()],
        *[F.sum(expr).alias(name) for name, expr in sums.items()],
    )
    known = F.col(user).isNotNull()
    return per_user.groupBy(*keys).agg(
        *[F.count(F.when(F.col(name) & known, 1)).alias(name) for name in flags],
        *[F.sum(name).alias(name) for name in sums],
    )


def user_day(
    df: DataFrame, day: Column, user: str, measures: Mapping[str, Column], name: str = "dt"
) -> DataFrame:
    """One row per user and day; ``measures`` are aggregate expressions."""
    return df.groupBy(day.alias(name), user).agg(*[e.alias(n) for n, e in measures.items()])


def merge_user_days(
    frames: Sequence[DataFrame], keys: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    """Several user-day logs folded into one row per user-day.

    A union and one aggregation in place of a chain of full outer joins.
    """
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.groupBy(*keys).agg(*[e.alias(n) for n, e in measures.items()])


def hours(seconds: Column) -> Column:
    return round_ratio(seconds, F.lit(3600), 2)


#: Bits that each round of the percentiles adds to a prefix of the 64-bit order of doubles.
ROUNDS = (20, 22, 22)


def order_key(value: Column) -> Column:
    """A long in the order of the doubles, no two of them alike; NaN is the greatest.

    These are the bits of the number, a sign for itself: powers of two are exact, and so are quotients by them.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    power = guess + (size >= F.pow(F.lit(2.0), guess + 1)).cast("int") - (size < F.pow(F.lit(2.0), guess)).cast("int")
    normal = F.shiftleft((power + 1023).cast("bigint"), 52) + ((size / F.pow(F.lit(2.0), power) - 1) * float(1 << 52)).cast("bigint")
    bits = (
        F.when(size.isNull() | (size == 0), F.lit(0))
        .when(F.isnan(size), F.lit((2047 << 52) + 1))
        .when(size == float("inf"), F.lit(2047 << 52))
        .when(size < 2.0**-1022, (size / 2.0**-1074).cast("bigint"))
        .otherwise(normal)
    )
    # Plainly never NULL: no join on it adds a filter, which would tell apart what reads the same rows.
    return F.coalesce(F.when(value < 0, -bits).otherwise(bits), F.lit(0))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]
) -> DataFrame:
    """Continuous percentiles (linear interpolation) as rows ``keys, fraction, percentile``.

    Rows without a key or value do not take part. NaN is greater than any number.

    A radix selection, which never holds a group in one task, wherever its values lie:

    1. equal values fold into (value, count) rows, combined map-side;
    2. counts fold to the first bits of the values' order; running totals over them find under which
       prefixes the wanted ranks lie;
    3. only values under those go on: they fold to the next bits, and in the end to themselves. A
       window holds the bits under one prefix, 2^22 rows at most. As a prefix may have most of the rows,
       what meets it is salted, one salt for each shuffle partition of the session.
    """
    keys = list(keys)
    rows = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low, middle = sum(ROUNDS[1:]), ROUNDS[2]
    rows = rows.withColumn("_p", order_key(F.col("_v"))).withColumns(
        {"_high": F.shiftright("_p", low), "_mid": F.shiftright("_p", middle), "_salt": F.coalesce(F.pmod(F.xxhash64("_v"), F.lit(salts)).cast("int"), F.lit(0))}
    )

    def wanted(ranked: DataFrame) -> DataFrame:
        """Of rows with their ranks those that take a wanted one, with the ranks that they take."""
        inside = F.filter("_wanted", lambda w: (w["_rank"] >= F.col("_start")) & (w["_rank"] < F.col("_end")))
        return ranked.withColumn("_wanted", inside).where(F.size("_wanted") > 0)

    def prefixes(ranked: DataFrame) -> DataFrame:
        return wanted(ranked).select(*keys, F.col("_p").alias("_up"), F.col("_start").alias("_before"), "_wanted")

    def salted(some: DataFrame) -> DataFrame:
        return some.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    # The first bits.
    total = F.sum("_n").over(Window.partitionBy(*keys))
    first = rows.groupBy(*keys, F.col("_high").alias("_p")).agg(F.sum("_n").alias("_n"))
    first = first.withColumns({"_up": F.lit(0).cast("bigint"), "_before": F.lit(0).cast("bigint"), "_total": total})
    place = F.array(*[F.struct(F.lit(float(p)).alias("fraction"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("_pos")) for p in fractions])
    ends = F.flatten(F.transform(place, lambda w: F.transform(
        F.array_distinct(F.array(F.floor(w["_pos"]), F.ceil(w["_pos"]))),
        lambda r: F.struct(w["fraction"].alias("fraction"), w["_pos"].alias("_pos"), r.alias("_rank")),
    )))
    early = prefixes(_with_ranks(first.withColumn("_wanted", ends), keys))
    # The next bits, of values under a wanted prefix.
    near = rows.withColumn("_up", F.col("_high")).join(salted(early.select(*keys, "_up")), [*keys, "_up", "_salt"], "left_semi")
    second = near.groupBy(*keys, "_up", F.col("_mid").alias("_p")).agg(F.sum("_n").alias("_n")).join(early, [*keys, "_up"])
    # The values themselves.
    late = salted(prefixes(_with_ranks(second, keys)))
    near = near.withColumn("_up", F.col("_mid")).join(late, [*keys, "_up", "_salt"])
    found = wanted(_with_ranks(near, keys)).select(*keys, "_v", F.inline("_wanted"))
    below, above = (F.max(F.when(F.col("_rank") == end("_pos"), F.col("_v"))) for end in (F.floor, F.ceil))
    weight = F.col("_pos") - F.floor("_pos")
    same = F.when((F.col("_w") == 0) | (F.col("_low") == F.col("_high")), F.col("_low"))
    return (
        found.groupBy(*keys, "fraction")
        .agg(below.alias("_low"), above.alias("_high"), F.max(weight).alias("_w"))
        .select(*keys, "fraction", same.otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_w")).alias("percentile"))
    )


def _with_ranks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks ``_start`` to ``_end`` (exclusive) that each row takes in its group, ``_before`` those ahead of its prefix."""
    so_far = Window.partitionBy(*keys, "_up").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("_end", F.col("_before") + F.sum("_n").over(so_far))
    return ends.withColumn("_start", F.col("_end") - F.col("_n"))
