"""Operators over the whole corpus, against plain Python."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import pyspark.sql.functions as F  # noqa: E402

from tideline.llm import lsh_forest  # noqa: E402
from tideline.llm.components import components  # noqa: E402
from tideline.llm.decontaminate import contained  # noqa: E402
from tideline.llm.line_windows import dedupe_lines  # noqa: E402
from tideline.llm.lsh_forest import depth_for, near_duplicates  # noqa: E402
from tideline.llm.mixing import mix  # noqa: E402
from tideline.llm.nn_descent import nearest  # noqa: E402
from tideline.llm.prefix_free import phrases, remove_repeats, suffix_ranks  # noqa: E402


def texts(spark, rows, *more):
    return spark.createDataFrame(rows, ", ".join(["doc_id long, text string", *more])).repartition(3)


# --- mixing ---------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.choice([1, 3, 20, 200, 900]), rnd.choice(["a", "a", "a", "é", "b", None])) for i in range(900)]
    rows += [(5, rows[5][1], rows[5][2]), (None, "x y", "a"), (901, None, "b"), (902, " \n", "z")]
    out = mix(texts(spark, rows, "source string").withColumn("_no", F.lit(1)).withColumn("_lambda", F.lit(2))).collect()
    sizes, total, target = brute.sizes_and_targets(rows)
    assert brute.ordered((r.doc_id, r.source, r._size) for r in out) == brute.ordered(sizes)
    taken = {}
    for r in out:
        assert r._source_size == total[r.source] and r._target == pytest.approx(target[r.source])
        assert r._taken == r._copies * r._size <= 2 * r._size
        taken[r.source] = taken.get(r.source, 0) + r._taken
    assert all(abs(taken[s] - t) <= 20 for s, t in target.items())
    again = mix(texts(spark, rows, "source string"))
    assert brute.ordered((r.doc_id, r._taken) for r in again.collect()) == brute.ordered((r.doc_id, r._taken) for r in out)


def test_mix_of_nothing(spark):
    assert mix(texts(spark, [], "source string")).collect() == []
    out = mix(texts(spark, [(1, "", "a"), (2, None, None)], "source string")).collect()
    assert [(r._size, r._target, r._taken) for r in out] == [(0, 0.0, 0)] * 2


# --- repeats --------------------------------------------------------------------------


def repeat_rows():
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcde é") for _ in range(400))
    return [
        (1, base), (2, "x" * 60 + base[100:200] + "y" * 49), (2, base[90:150] + "z" * 70), (None, base), (None, "x" * 55), (3, None), (4, ""),
        (5, "a" * 49), (6, "z" * 200 + base[:51]), (7, "ab" * 60), (8, "ba" * 70), (9, base[:50]), (9, base[:50]), (10, "日本語" * 40),
        (11, "本語日" * 30), (0, "y" * 48), (-4, base[300:360]),
    ]


def test_repeats_equal_brute_force(spark):
    rows = repeat_rows()
    out = remove_repeats(texts(spark, rows).withColumn("b", F.lit("b")))
    assert brute.ordered((r.id, r.n_bytes, r.n_removed, len(r.spans), brute.sha(r.kept)) for r in out.collect()) == brute.repeats(rows)
    assert remove_repeats(texts(spark, [])).collect() == []


def test_repeats_on_random_texts(spark):
    rnd = random.Random(9)
    parts = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(20, 90))) for _ in range(30)]
    rows = [(rnd.randrange(40), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))) for _ in range(60)]
    out = remove_repeats(texts(spark, rows))
    assert brute.ordered((r.id, r.n_bytes, r.n_removed, len(r.spans), brute.sha(r.kept)) for r in out.collect()) == brute.repeats(rows)


def test_suffix_ranks_order_to_fifty_bytes():
    data = np.frombuffer(b"abracadabra" * 20 + b"xyz" * 30, np.uint8)
    rank, raw = suffix_ranks(data), data.tobytes() + bytes(64)
    keys = [raw[i : i + 50] for i in range(len(data))]
    order = {k: n for n, k in enumerate(sorted(set(keys)))}
    dense = np.unique(rank, return_inverse=True)[1]
    assert [order[k] for k in keys] == dense.tolist()


def test_phrases_hold_every_window_once():
    raw = [b"abc" * 40, b"", b"x" * 50, b"y" * 49, bytes(range(200))]
    off = np.cumsum([0, *map(len, raw)])
    _, first, last = phrases(np.frombuffer(b"".join(raw), np.uint8), off)
    covered = [s for a, b in zip(first, last, strict=True) for s in range(a, b + 1)]
    assert covered == [o + s for o, x in zip(off, raw, strict=False) for s in range(len(x) - 49)]


# --- lines ----------------------------------------------------------------------------


def test_line_windows_equal_brute_force(spark):
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (2, "x\na\nb\nc\ny"), (None, "a\nb\nc\nd"), (None, None), (3, ""), (4, "a\nb"),
        (5, "z\nz\nz\nz\nz"), (6, "\n\n\n\n"), (7, "\n \n\n\n"), (8, "a\nb\nc"), (9, "q\nb\nc\nd\ne\n"), (10, "l\n" * 300 + "b\nc\nd"),
    ]
    df = texts(spark, rows).withColumn("_k1", F.lit("mine")).withColumn("at", F.lit(2))
    out = dedupe_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_removed", "_spans"]
    assert brute.ordered((r.doc_id, r.text) for r in out.collect()) == brute.line_windows(rows)
    assert {r._k1 for r in out.collect()} == {"mine"}
    assert dedupe_lines(texts(spark, [])).collect() == []


# --- near duplicates ------------------------------------------------------------------


def near_rows():
    rnd = random.Random(5)
    base = [str(rnd.randrange(99_999)) for _ in range(100)]
    rows = [(i, " ".join(x if rnd.random() > 0.01 else f"q{i}" for x in base)) for i in range(30)]
    rows += [
        (100, "a b c d e f g h i j k l"), (101, "A b c d e f g h i j k l"), (101, "A b c d e f g h i j k l"), (None, "x y"), (None, "x,y"),
        (103, None), (104, ""), (105, "--"), (106, "a b c d e f g h i j k l m"), (107, "q"), (50, "a b c d e f g h i j k l m n o p"),
    ]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lsh_forest, "BLOCK", block)
    rows = near_rows()
    out = near_duplicates(texts(spark, rows).withColumn("node", F.lit(1))).collect()
    assert brute.ordered((r.id, r.class_id, r.n_links) for r in out) == brute.near(rows)
    heads = [r for r in out if r.first]
    assert {(r.id, r.class_id) for r in heads} >= {(0, 0), (100, 100), (103, 103)}


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(texts(spark, [])).collect() == []
    out = near_duplicates(texts(spark, [(1, None), (1, None)])).collect()
    assert [(r.class_id, r.n_links, r.first) for r in out] == [(1, 0, True)] * 2


def test_prefix_is_shortened_to_the_target_recall():
    assert depth_for() == 6 and depth_for(recall=0.9) > depth_for(recall=0.999999)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (300, 299)]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 130)} | {(300, 299)}


# --- benchmark ------------------------------------------------------------------------


def test_contained_windows_equal_brute_force(spark):
    docs = [
        (1, "The quick brown fox"), (1, "The quick brown fox"), (2, None), (None, "a b c d e f g h i j k l m"), (3, "x " + "a " * 12), (4, ""),
        (5, "fox"), (6, "é Ünder FOX-fox"), (1, "other fox quick"), (8, "p " * 3000 + "b c d e f g h i j k"),
    ]
    items = [
        (1, "FOX"), (2, "a b c d e f g h i j k"), (3, None), (None, "a a a a a a a a a a"), (4, "quick brown"), (4, "b c d e f g h i j k l m n"),
        (5, "--"), (6, "Ünder fox FOX"), (10, "b c d e f g h i j k"),
    ]
    d, i = texts(spark, docs).withColumn("h", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    got = lambda a, b: brute.ordered((r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in contained(a, b).collect())
    assert got(d, i) == brute.windows(docs, items)
    assert got(d, i.limit(0)) == brute.windows(docs, [])
    assert got(d.limit(0), i) == []


# --- nearest --------------------------------------------------------------------------


def test_nearest_handles_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (None, [1.0, 1.0]),
        (7, [0.0, 1.0]), (8, [0.5, 0.5, 1.0]), (20, [2.0, 1.0]), (20, [2.0, 1.0]), (40, []), (60, [inf, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest(df, F.col("id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0)]
    assert nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []
    assert nearest(df.limit(1), F.col("id") % 20 == 0).collect() == []


def test_nearest_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[700:900] = x[700]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in nearest(df, F.col("id") % 50 == 0, 10).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    hits = 0
    for q in range(0, 1500, 50):
        s = x.astype(float) @ x[q].astype(float)
        best = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:10]
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 11)) and all(abs(score - s[i]) < 1e-9 for _, i, score in got)
        hits += len({i for _, i, _ in got} & set(best))
    assert hits >= 0.9 * 300
