"""Near-duplicate documents by n-gram Jaccard similarity, found by MinHash LSH in fixed bands.

Each document is the set of its ``SIZE``-word shingles. Equal sets are one class of copies,
and only classes go on. Two documents are candidates if they agree on all MinHash values of any
of ``TREES`` bands; a band has the most values, ``DEPTH`` at most, at which even a pair exactly at
the threshold agrees on some band with probability ``RECALL`` (6). This is plain banding and not
an LSH forest: no tries are built and no prefix is shortened for single documents. As threshold
and recall are fixed, one length serves all documents, and as every candidate is verified, longer
prefixes could only save comparisons. Nodes are kept as hashes of (band, values); members hang on
their node's least member, in the scanning tasks first, so a node shared by a third of all
classes crosses the shuffle once a task.

Candidate components are then verified exactly, every pair in them: small ones are packed
into groups; large ones are cut into blocks whose pairs meet in tasks of their own. A task
counts common shingles by multiplying 0/1 matrices and returns only each class's links and a
spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bytework import buffers, in_bitmap, mix, shingle_hashes, sliced, word_hashes
from tideline.llm.components import components
from tideline.llm.frames import LAST_ID, bitmap, keyed, stored

SIZE = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.9999
BLOCK = 1024
COLUMNS = 4096
FLUSH = 2_000_000


def depth_for(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold shares a node of some tree with probability ``recall``."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


def shingle_sets(batch: pa.RecordBatch, size: int = SIZE) -> list[np.ndarray]:
    """Sorted different shingles of each text; one of all its words if it has fewer than ``size``."""
    data, off = buffers(batch.column("text"))
    _, _, owner, h = word_hashes(data, off)
    first = np.searchsorted(owner, np.arange(len(off)))
    all_ = shingle_hashes(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(all_[a : b - size + 1]) if b - a >= size else shingle_hashes(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), COLUMNS // 4):
        least = np.minimum(least, ((x[at : at + COLUMNS // 4] ^ b) * a).min(axis=0))
    return least


def _scan(rows: DataFrame, size: int, depth: int) -> DataFrame:
    rng = np.random.default_rng(6)
    a = rng.integers(1, 1 << 31, TREES * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, TREES * depth, dtype=np.uint32)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            node, check, keys = [], [], []
            for s in shingle_sets(batch, size):
                if not len(s):
                    node.append(None)
                    check.append(None)
                    keys.append(None)
                    continue
                node.append(int(mix(np.array([s.sum() + np.uint64(len(s))]))[0] >> np.uint64(1)))
                check.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) >> np.uint64(1)))
                prefix = np.arange(TREES, dtype=np.uint64)
                for level in _signature(s, a, b).reshape(TREES, depth).T:
                    prefix = mix(prefix * np.uint64(0x9E3779B97F4A7C15) + level)
                keys.append(prefix.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("k1", "k2")), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(keys, pa.binary())],
                ["k1", "k2", "node", "check", "keys"],
            )

    return rows.select("text", "k1", "k2").mapInArrow(read, "k1 long, k2 long, node long, check long, keys binary")


def _candidates(classes: DataFrame) -> DataFrame:
    """Edges from each class to the least one on a node of the forest."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different keys with their least node, and the edges of all others to it."""
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.r_[True, key[1:] != key[:-1]]
        least = np.repeat(node[new], np.diff(np.r_[np.flatnonzero(new), len(key)]))
        edges = np.unique(np.stack([node[node != least], least[node != least]], axis=1), axis=0)
        return key[new], node[new], edges

    names = ["part", "u", "v", "keys", "nodes"]
    types = "part int, u long, v long, keys binary, nodes binary"

    def batch_of(edges: np.ndarray, packed: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        n, m = len(edges), len(packed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None] * n + [p for p, _, _ in packed], pa.int32()),
                pa.array(edges[:, 0].tolist() + [None] * m, pa.int64()),
                pa.array(edges[:, 1].tolist() + [None] * m, pa.int64()),
                pa.array([None] * n + [k for _, k, _ in packed], pa.binary()),
                pa.array([None] * n + [x for _, _, x in packed], pa.binary()),
            ],
            names,
        )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, node, edges = stars(*map(np.concatenate, zip(*held, strict=True)))
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            found, first = np.unique(part[order], return_index=True)
            packed = [(int(p), key[i].tobytes(), node[i].tobytes()) for p, i in zip(found, np.split(order, first[1:]), strict=True)]
            return batch_of(edges, packed)

        n = 0
        for batch in batches:
            if batch.num_rows:
                key = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint64)
                held.append((key, np.repeat(batch.column("node").to_numpy(), TREES)))
                n += len(key)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        _, _, edges = stars(read("keys", np.uint64), read("nodes", np.int64))
        return pa.table({"u": pa.array(edges[:, 0], pa.int64()), "v": pa.array(edges[:, 1], pa.int64())})

    hung = stored(classes.select("node", "keys").mapInArrow(near, types))
    far = hung.where("part is not null").select("part", "keys", "nodes").groupBy("part").applyInArrow(meet, "u long, v long")
    return hung.where("part is null").select("u", "v").unionByName(far)


def linked(sets: list[np.ndarray], others: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Whether each pair of sets (of one list, or one of each) is at least as similar as ``threshold``."""
    both = sets if others is None else sets + others
    sizes = np.array([len(s) for s in both], float)
    values = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), sizes.astype(int))
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    n = len(sets)
    common = np.zeros((n, n if others is None else len(others)))
    for at in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(both), COLUMNS), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        common += x[:n] @ (x if others is None else x[n:]).T
    left, right = sizes[:n, None], (sizes if others is None else sizes[n:])[None, :]
    return common >= threshold * (left + right - common) - 1e-9


def _verified(members: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links and local root of each class (``task``, ``i``, ``j``, ``part``, ``component``, ``node``, ``copies``, ``text``)."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def roots(nodes: np.ndarray, link: np.ndarray) -> np.ndarray:
        """Least node each one is connected with."""
        root = nodes.copy()
        while True:
            least = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (least == root).all():
                return root
            root = least

    def block(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        table = table.sort_by([("component", "ascending"), ("part", "ascending"), ("node", "ascending")])
        sets = [s for b in sliced(iter(table.combine_chunks().to_batches()), "text") for s in shingle_sets(b, size)]
        component, part = table["component"].to_numpy(), table["part"].to_numpy()
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        out = []
        cuts = np.flatnonzero(np.r_[True, component[1:] != component[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                link = linked(sets[a:b], None, threshold)
                np.fill_diagonal(link, False)
            else:
                m = a + int((part[a:b] == i).sum())
                link = np.zeros((b - a, b - a), bool)
                if a < m < b:
                    link[: m - a, m - a :] = linked(sets[a:m], sets[m:b], threshold)
                    link |= link.T
            out.append((node[a:b], link.astype(np.int64) @ copies[a:b], roots(node[a:b], link)))
        return pa.table([pa.array(x, pa.int64()) for x in map(np.concatenate, zip(*out, strict=True))], schema=schema)

    return members.groupBy("task", "i", "j").applyInArrow(block, "node long, links long, root long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each row of ``docs``: ``id``, ``k1``, ``k2``, ``class_id``, ``first``, ``n_links``.

    ``n_links`` counts the other rows whose shingle sets have a Jaccard similarity of at least
    ``threshold``, copies included. ``class_id`` is the least id among all rows connected by links,
    and ``first`` marks the class's first row, by id and then a hash of the text (equal rows share the
    mark). Null and wordless texts have no shingles, no links and a class of their own; null ids come
    last, and a class of such has a null id. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    rows = keyed(docs, id_column, text)
    scanned = stored(_scan(rows, size, depth_for(threshold, recall)))
    key = F.struct("k1", "k2")
    classes = stored(
        scanned.where("node is not null").groupBy("node", "check").agg(F.min(key).alias("head"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    )
    found = components(_candidates(classes))
    inside = stored(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()))
    heads = classes.select("node", "head.k1", "head.k2", "copies").join(inside, "node")
    sizes = inside.groupBy("root").agg(F.count("*").alias("m"))
    heads = stored(heads.join(sizes, "root"))
    wanted = context.broadcast(bitmap(heads.select(F.col("k2").alias("h"))))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(wanted.value, batch.column("k2").to_numpy().view(np.uint64))))

    texts = rows.select("k1", "k2", "text").mapInArrow(needed, "k1 long, k2 long, text string")
    groups = max(1, heads.count() // BLOCK)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("node"), blocks).cast("int")
    members = (
        texts.join(heads, ["k1", "k2"])
        .dropDuplicates(["k1", "k2"])
        .withColumns({"component": F.col("root"), "blocks": blocks})
        .withColumn("part", F.when(F.col("blocks") > 1, part).otherwise(0))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumns(
            {
                # Small components share tasks by hash; the negative number is none of a component.
                "task": F.when(F.col("blocks") > 1, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(groups))),
                "i": F.least("part", "other"),
                "j": F.greatest("part", "other"),
            }
        )
        .select("task", "i", "j", "part", "component", "node", "copies", "text")
    )
    verified = stored(_verified(members, size, threshold))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")))
    classed = (
        classes.select("node", "check", "head", "copies")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .select("node", "check", "head", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    least = classed.groupBy("root").agg(F.min("head").alias("least"))
    known = classed.join(least, "root").select("node", "check", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "least")
    met = scanned.select("k1", "k2", "node", "check").join(known, ["node", "check"], "left")
    first = F.coalesce("least", key)
    number = lambda c: F.nullif(c, F.lit(LAST_ID))
    return met.select(
        number(F.col("k1")).alias("id"), "k1", "k2", number(first["k1"]).alias("class_id"), (first == key).alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
