"""Merkle manifest of a table by sibling-shift self-joins.

Every row is a leaf; the leaves of a group stand in order of their id. On each level a node finds
its run by arithmetic: the sibling in slot k of a run stands k behind the one in slot zero (for
runs of two, at the index with the last bit flipped). Slot-zero rows meet the others by one equijoin
for each slot on that computed index and emit the parent; the last run may be short. The single
node left is the root of its group, and the roots of the groups, in order of the group's name, make
a second tree of the same kind with the root of all.

On the way down each run meets the path of its parent, so that a run's digests are sent once and not
once for each leaf below. A path holds for each level the siblings to the left and to the right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.frames import stored
from tideline.llm.ordering import numbered

ARITY = 8
PATH = "array<struct<l: string, r: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields; no two different rows give the same bytes."""
    return digest(*map(field, values))


def manifest(rows: DataFrame, arity: int = ARITY) -> DataFrame:
    """Proof of every row of ``rows``, which has ``id``, ``name`` (of its group), ``leaf`` and ``claim``.

    Gives ``id``, ``leaf``, ``subroot`` (of its group), ``root``, ``path`` and ``folded``, the root
    that the digest ``claim`` leads to along the path; a row whose claim is its leaf folds to ``root``.
    A null name is a group in front of all others, the empty name one of its own; names go by their
    bytes. Null ids stand last in their group, rows of one id in order of their leaves, and equal rows
    are leaves of their own. A group of one row has its leaf as subroot; one group alone has its
    subroot as root and adds nothing to the path. An empty table gives no rows.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    # The null name is the empty key, every other one has a mark in front.
    key = F.coalesce(F.concat(F.lit("="), F.col("name").cast("string")), F.lit(""))
    short = stored(rows.select(key.alias("g"), "id", F.col("leaf").alias("h"), "claim"))
    leaves = numbered(short, "g", [F.col("id").asc_nulls_last(), F.col("h"), F.col("claim")])
    levels, roots = _tree(leaves, arity)
    names = numbered(stored(roots.select(F.lit("").alias("g"), F.col("g").alias("group"), "h", "depth")), "g", [F.col("group")])
    upper, root = _tree(names.select("g", "i", "n", "h"), arity)
    summit = root.select("g", "depth", F.array().cast(PATH).alias("path"), F.col("h").alias("root"))
    heads = _paths(names.withColumnRenamed("depth", "_depth"), upper, summit, ["root"], arity)
    heads = stored(heads.select(F.col("group").alias("g"), F.col("_depth").alias("depth"), "path", F.col("h").alias("subroot"), "root"))
    found = _paths(leaves, levels, heads, ["subroot", "root"], arity)
    folded = F.aggregate("path", F.col("claim"), lambda h, s: digest(s["l"], h, s["r"]))
    return found.select("id", F.col("h").alias("leaf"), "subroot", "root", "path", folded.alias("folded"))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def _tree(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level (``g``, ``i`` of the parent, ``n`` parents, ``kids``, ``h``) and the root and depth of each group."""
    nodes = leaves.select("g", "i", "n", "h")
    most = nodes.agg(F.max("n")).first()[0] or 0
    roots = nodes.where("n = 1").select("g", "h", F.lit(0).alias("depth"))
    levels: list[DataFrame] = []
    while most > 1:
        levels.append(stored(_parents(nodes.where("n > 1"), arity)))
        nodes = levels[-1].select("g", "i", "n", "h")
        roots = roots.unionByName(nodes.where("n = 1").select("g", "h", F.lit(len(levels)).alias("depth")))
        most = -(-most // arity)
    return levels, roots


def _parents(nodes: DataFrame, arity: int) -> DataFrame:
    """One level up: slot-zero rows take in their siblings by computed index."""
    slot = F.col("i") % arity
    run = nodes.where(slot == 0).select("g", "i", "n", F.col("h").alias("h0"))
    for k in range(1, arity):
        first = F.col("i").bitwiseXOR(1) if arity == 2 else F.col("i") - k
        run = run.join(nodes.where(slot == k).select("g", first.alias("i"), F.col("h").alias(f"h{k}")), ["g", "i"], "left")
    kids = F.array_compact(F.array(*[f"h{k}" for k in range(arity)]))
    up = run.select("g", F.expr(f"i div {arity}").alias("i"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), kids.alias("kids"))
    return up.withColumn("h", F.sha2(F.array_join("kids", ""), 256))


def _paths(leaves: DataFrame, levels: list[DataFrame], heads: DataFrame, carry: Sequence[str], arity: int) -> DataFrame:
    """The leaves with their ``path`` and what ``heads`` (``g``, ``depth``, ``path``) carry for their group."""
    further = ["path", *carry]
    above = None
    for depth in range(len(levels), 0, -1):
        tops = heads.where(F.col("depth") == depth).select("g", F.lit(0).cast("long").alias("i"), *further)
        met = levels[depth - 1].select("g", "i", "kids").join(tops if above is None else tops.unionByName(above), ["g", "i"])
        if depth > 1:
            each = met.select("*", F.posexplode("kids").alias("slot", "kid"))
            above = each.select("g", (F.col("i") * arity + F.col("slot")).alias("i"), _longer(F.col("slot"), arity).alias("path"), *carry)
    alone = leaves.where("n = 1").join(heads.drop("depth"), "g")
    if not levels:
        return alone
    run = F.expr(f"i div {arity}")
    below = leaves.where("n > 1").join(met.withColumnRenamed("i", "_run").withColumnRenamed("g", "_g"), (F.col("g") == F.col("_g")) & (run == F.col("_run")))
    below = below.withColumn("path", _longer((F.col("i") % arity).cast("int"), arity))
    return below.drop("_g", "_run", "kids").unionByName(alone)


def _longer(slot: Column, arity: int) -> Column:
    """The path of a kid: its siblings left and right, then the path of its run."""
    left = F.array_join(F.slice("kids", F.lit(1), slot), "")
    right = F.array_join(F.slice("kids", slot + 2, F.lit(arity)), "")
    return F.concat(F.array(F.struct(left.alias("l"), right.alias("r"))), F.col("path"))
