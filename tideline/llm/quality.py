"""Quality of texts by gradient-boosted trees over document statistics.

The statistics are counts of byte classes, words, lines and repeats, computed for a whole Arrow
batch at once. Trees are grown on histograms of quantile bins, to a fixed depth, and are then
flattened into three arrays (feature, threshold, leaf value) with children at ``2i+1`` and
``2i+2``, so that a batch walks all trees together, one gather a level.

The fit takes at most ``SAMPLE`` labelled rows, those with the least hash of their id; their
statistics alone come to the driver. Scoring reads every row and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.bytework import buffers, runs_of, shingle_hashes, slice_hashes, sliced
from tideline.llm.frames import fresh, keyed

SAMPLE = 20_000
BINS = 64
DEPTH = 4
ROUNDS = 80
RATE = 0.15
RIDGE = 1.0
LEAST_WEIGHT = 1.0

CLASSES = (
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"),
    (b"abcdefghijklmnopqrstuvwxyz", "lower"),
    (b"0123456789", "digit"),
    (b" \t\r\x0b\x0c", "space"),
    (b".,;:?'\"()-", "stop"),
    (b"!", "exclaim"),
    (b"|<>{}[]=_/\\", "frame"),
    (b"#*$%&@~^+`", "sign"),
)
FEATURES = (
    "bytes", "words", "lines", "upper", "lower", "digit", "space", "stop", "exclaim", "frame", "sign", "other",
    "word_length", "short_words", "long_words", "words_a_line", "distinct_words", "distinct_pairs", "distinct_lines",
    "signed_words", "shouted_words", "stops_a_word",
)


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different values each owner has."""
    if not len(h):
        return np.zeros(n)
    order = np.lexsort((h, owner))
    o, v = owner[order], h[order]
    new = np.ones(len(v), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def statistics(column) -> np.ndarray:
    """``FEATURES`` of each text of an Arrow column, as float32."""
    data, off = buffers(column)
    n = len(off) - 1
    per = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    counts = {}
    known = np.zeros(256, bool)
    for members, name in CLASSES:
        inside = np.zeros(256, bool)
        inside[list(members)] = True
        known |= inside
        total = per(inside[data])
        counts[name] = (total[off[1:]] - total[off[:-1]]).astype(float)
        if name in ("upper", "lower", "sign"):
            counts[f"{name}_total"] = total
    size = np.maximum(off[1:] - off[:-1], 1).astype(float)
    counts["other"] = size - sum(counts[name] for _, name in CLASSES)

    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    starts, ends = runs_of(~white[data], off)
    owner = np.searchsorted(off, starts, side="right") - 1
    words = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = ends - starts
    share = lambda mask: np.bincount(owner[mask], minlength=n) / some
    inside = lambda name: counts[f"{name}_total"][ends] - counts[f"{name}_total"][starts]
    h = slice_hashes(data, starts, ends)
    pairs = shingle_hashes(h, 2)
    same = owner[:-1] == owner[1:] if len(owner) > 1 else np.zeros(0, bool)

    line_starts, line_ends = runs_of(data != 10, off)
    line_owner = np.searchsorted(off, line_starts, side="right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(float)
    line_hashes = slice_hashes(data, line_starts, line_ends)

    columns = [
        np.log1p(off[1:] - off[:-1]),
        np.log1p(words),
        np.log1p(lines),
        *(counts[name] / size for name in ("upper", "lower", "digit", "space", "stop", "exclaim", "frame", "sign", "other")),
        np.bincount(owner, weights=length, minlength=n) / some,
        share(length <= 3),
        share(length >= 20),
        words / np.maximum(lines, 1),
        _distinct(owner, h, n) / some,
        _distinct(owner[:-1][same], pairs[same], n) / np.maximum(np.bincount(owner[:-1][same], minlength=n), 1),
        _distinct(line_owner, line_hashes, n) / np.maximum(lines, 1),
        share(inside("sign") > 0),
        share((inside("upper") > 1) & (inside("lower") == 0)),
        counts["stop"] / some,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Trees:
    """Flat trees of one depth: ``feature`` and ``threshold`` have a column a split, ``leaf`` one a leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        n, trees = len(x), len(self.feature)
        if not trees or not n:
            return np.full(n, 1 / (1 + np.exp(-self.base)))
        at = np.zeros((n, trees), np.int64)
        tree = np.arange(trees)
        rows = np.arange(n)[:, None]
        splits = self.feature.shape[1]
        for _ in range(int(np.log2(splits + 1))):
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.threshold[tree, at])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, at - splits].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fits the trees to labels 0 and 1; without both labels every score is the share of ones (a half if there are none)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    splits, leaves = 2**DEPTH - 1, 2**DEPTH
    none = Trees(base, np.zeros((0, splits), np.int64), np.zeros((0, splits), np.float32), np.zeros((0, leaves)))
    if len(np.unique(y)) < 2:
        return none
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), base)
    feature, threshold, leaf = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f_of, t_of = np.zeros(splits, np.int64), np.full(splits, np.inf, np.float32)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            cut = np.zeros(width, np.int64)
            for f, e in enumerate(edges):
                key = (node - first) * BINS + binned[:, f]
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS)
                gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0
                gain[:, len(e) :] = 0
                top = gain.argmax(axis=1)
                won = gain[np.arange(width), top] > best
                best[won], cut[won] = gain[np.arange(width), top][won], top[won]
                f_of[first : first + width][won] = f
                t_of[first : first + width][won] = e[top[won]]
            split = np.isfinite(t_of[node])
            right = split & (x[np.arange(len(y)), f_of[node]] > t_of[node])
            node = 2 * node + 1 + right
        key = node - splits
        value = -RATE * np.bincount(key, g, leaves) / (np.bincount(key, h, leaves) + RIDGE)
        margin += value[key]
        feature.append(f_of)
        threshold.append(t_of)
        leaf.append(value)
    return Trees(base, np.stack(feature), np.stack(threshold), np.stack(leaf))


def held_out(id_column: Column) -> Column:
    """Ids whose labels are never learned."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled ids that aren't held out.

    A label teaches once: of several texts under one id the one with the least ``k2`` is taken.
    Rows without an id or a label teach nothing; an id with several labels takes the least;
    labels without a document and documents without a label are passed over.
    """
    marked = (
        labels.select(F.col(id_column).cast("long").alias("k1"), (F.col(label) > 0).cast("int").alias("y"))
        .where(F.col("k1").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("k1")))
        .groupBy("k1")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("k1"), "k1")
        .limit(sample)
    )
    rows = keyed(docs, id_column, text).where("id is not null")
    picked = rows.join(F.broadcast(marked), "k1").select("k1", "k2", "y", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            x = statistics(batch.column("text")).astype("<f4")
            flat = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "y")), flat], ["k1", "k2", "y", "x"])

    rows = picked.mapInArrow(measured, "k1 long, k2 long, y int, x binary")
    first = rows.groupBy("k1").agg(F.min(F.struct("k2", "y", "x")).alias("r")).select("k1", "r.*")  # folded before the shuffle
    found = sorted(map(tuple, first.collect()))
    x = np.stack([np.frombuffer(r[3], "<f4") for r in found]) if found else np.zeros((0, len(FEATURES)), np.float32)
    return grow(x, np.array([r[2] for r in found], float))


def scored(docs: DataFrame, trees: Trees, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of ``docs`` (``keep``, or all) and ``_score``, the probability of label 1; null texts are judged as empty ones."""
    keep = [c for c in docs.columns if (keep is None or c in keep) and c != "_score"]
    shipped = docs.sparkSession.sparkContext.broadcast((trees.base, trees.feature, trees.threshold, trees.leaf))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(*shipped.value)
        for batch in sliced(batches, 0):
            found = model.scores(statistics(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.float64())], [*batch.schema.names[1:], "_score"])

    schema = ", ".join([f"`{name}` {kind}" for name, kind in docs.dtypes if name in keep] + ["`_score` double"])
    read = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias(fresh(docs, "_text")[0]), *(F.col(f"`{c}`") for c in docs.columns if c in keep))
    return read.mapInArrow(score, schema)
