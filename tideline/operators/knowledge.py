"""Guidelines and knowledge items: active list, seeding, budgets, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ordered import numbered

from tideline.functions.text import metric_label, trim_space

# The known categories, the one an unknown category falls back to, the
# source of a rule that names none, and the separator of joined labels.
CATEGORIES = ("metric_logic", "formatting", "context", "investigation")
FALLBACK_CATEGORY = "context"
DEFAULT_SOURCE = "manual"
LABEL_SEPARATOR = "、"
SALTS = 16


def active_guidelines(guidelines: DataFrame) -> DataFrame:
    """Active rules by category and id; a rule without source is manual."""
    return (
        guidelines.where(F.col("is_active"))
        .select("id", "category", "rule_text", F.coalesce("source", F.lit(DEFAULT_SOURCE)).alias("source"))
        .orderBy("category", "id")
    )


def seed_if_empty(target: DataFrame, seed: DataFrame) -> DataFrame:
    """The seed rows if ``target`` has no row at all, else nothing.

    The existence test is an uncorrelated subquery that stops at the first row.
    """
    return seed.where(~target.limit(1).exists())


def normalise_rules(drafts: DataFrame) -> DataFrame:
    """Drafted rules with both texts trimmed; empty rules go, unknown categories fall back."""
    category, rule = trim_space(F.col("category")), trim_space(F.col("rule_text"))
    known = F.when(category.isin(*CATEGORIES), category).otherwise(FALLBACK_CATEGORY)
    return drafts.withColumns({"category": known, "rule_text": rule}).where(F.length("rule_text") > 0)


def budgeted_selection(
    items: DataFrame,
    text: str,
    order: Sequence[str],
    group: Sequence[str] = (),
    *,
    max_items: int,
    max_bytes: int,
    max_chars: int,
) -> DataFrame:
    """Every item with its ``status``: ``kept`` for the longest prefix of its group that fits
    both budgets, else why it is left out (``too long``, ``several lines``, ``over items``,
    ``over bytes``); ``position`` and ``bytes_so_far`` for the first ``max_items`` eligible ones.

    Each row is one item, also where ``order`` ties or rows repeat; among ties the order is open.
    Items are numbered by ranges (``ordered.numbered``, whose ``release`` takes the result too), so that
    no task holds a group; byte totals run over the first ``max_items`` of each group.
    """
    several = F.contains(F.col(text), F.lit("\n"))
    why = F.when(F.length(text) > max_chars, "too long").when(several, "several lines")
    placed = numbered(items.withColumn("_why", why).withColumn("_fits", F.col("_why").isNull()), [*group, "_fits"], [F.col(c) for c in order])
    early = F.col("_fits") & (F.col("_no") <= max_items)
    by_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    so_far = by_group.orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
    first = placed.where(early).withColumn("bytes_so_far", F.sum(F.octet_length(text)).over(so_far))
    first = first.select(*items.columns, F.col("_no").cast("int").alias("position"), "bytes_so_far", F.when(F.col("bytes_so_far") > max_bytes, "over bytes").otherwise("kept").alias("status"))
    rest = placed.where(~early).select(
        *items.columns, F.lit(None).cast("int").alias("position"), F.lit(None).cast("bigint").alias("bytes_so_far"), F.coalesce("_why", F.lit("over items")).alias("status")
    )
    judged = first.unionByName(rest)
    judged.dealt = placed.dealt
    return judged


def resolve_labels(catalog: DataFrame) -> DataFrame:
    """``name, label, supports_label`` of ``name, description, supports``.

    Supported names resolve to labels of the catalog, in their own order; a name the
    catalog lacks is shown with spaces for underscores. A name supported by a large
    share of all entries is looked up once, and its label comes back over ``SALTS`` keys.
    """
    labels = catalog.select("name", metric_label(F.col("name"), F.col("description")).alias("label"))
    wanted = catalog.select("name", F.posexplode("supports").alias("pos", "target"))
    known = wanted.select("target").distinct().join(
        labels.select(F.col("name").alias("target"), F.col("label").alias("target_label")),
        "target",
        "left",
    )
    spelled: Column = F.coalesce("target_label", F.replace("target", F.lit("_"), F.lit(" ")))
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = (
        wanted.withColumn("_salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
        .join(salted, ["target", "_salt"])
        .groupBy("name")
        .agg(F.array_sort(F.collect_list(F.struct("pos", spelled.alias("label")))).alias("found"))
        .select("name", F.array_join(F.col("found.label"), LABEL_SEPARATOR).alias("supports_label"))
    )
    return labels.join(joined, "name", "left").select(
        "name", "label", F.coalesce("supports_label", F.lit("")).alias("supports_label")
    )
