"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors are one node of the graph, so copies neither crowd a node's list nor make a hot
key. The graph starts from ``TREES`` random-hyperplane orders of all nodes, cut into chunks of
``CHUNK`` whose members are compared with each other. Each round of NN-descent then joins, at
every node, its neighbours and a sample of the nodes that list it with one another, where at
least one of the two is new, and offers each the other. Lists hold ``DEGREE`` neighbours.
Nodes travel as bytes (one a dimension and a scale); results are scored on the vectors given.

A query starts at its own node and expands the best nodes seen until its ``BEAM`` best are all
expanded. Expansion, scoring and merging are three joins a round, by bucket of the node, of
the neighbours and of the query; a query's vector travels with what it asks of a bucket.

Every row is indexed and every list is built from all rows; only which pairs are compared is
a choice. Reverse lists are thinned to about ``DEGREE`` by hash, as NN-descent prescribes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.frames import stored

DEGREE = 48
TREES = 6
PLANES = 12
CHUNK = 2048
SETTLED = 0.05
BEAM = 96
NODES_A_BUCKET = 2048
SALTS = 16

I8, F4 = np.dtype("<i8"), np.dtype("<f4")
LISTS = "id long, ids binary, scores binary, fresh binary"
OFFER_SCHEMA = pa.schema([("b", pa.int32()), ("owners", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary())])
LIST_SCHEMA = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary()), ("fresh", pa.binary())])


def vectors(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part, one for each id.

    Rows without an id or a vector, with null or non-finite components, only zeros, or another
    length than most rows have (of two such lengths the greater) take no part. An id in several
    rows stands for the least of its vectors.
    """
    v = F.col(vector).cast("array<double>")
    clean = table.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(
        "id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x != 0)"
    )
    length = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = length[0]["d"] if length else 1
    return clean.where(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"))


def _bucket(column: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _quantised(x: np.ndarray) -> list[bytes]:
    scale = (np.abs(x).max(axis=1) / 127).astype(F4)
    whole = np.rint(x / scale[:, None]).astype(np.int8)
    return [s.tobytes() + w.tobytes() for s, w in zip(scale, whole, strict=True)]


def _matrix(column) -> np.ndarray:
    """Vectors from their bytes."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return raw[:, 4:].copy().view(np.int8).astype(np.float32) * raw[:, :4].copy().view(F4)


def _lists(owner: np.ndarray, near: np.ndarray, score: np.ndarray, fresh: np.ndarray | None, most: int) -> pa.RecordBatch:
    """The best ``most`` different neighbours of each owner; one that was known stays so. All are fresh if not told."""
    fresh = np.ones(len(owner), np.uint8) if fresh is None else fresh
    order = np.lexsort((fresh, near, owner))
    owner, near, score, fresh = owner[order], near[order], score[order], fresh[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (near[1:] != near[:-1])
    owner, near, score, fresh = owner[keep], near[keep], score[keep], fresh[keep]
    order = np.lexsort((near, -score, owner))
    owner, near, score, fresh = owner[order], near[order], score[order], fresh[order]
    ids, first = np.unique(owner, return_index=True)
    rank = np.arange(len(owner)) - np.repeat(first, np.diff([*first, len(owner)]))
    keep = rank < most
    owner, near, score, fresh = owner[keep], near[keep], score[keep].astype(F4), fresh[keep].astype(np.uint8)
    cuts = np.searchsorted(owner, ids)[1:]
    cut = lambda a: [x.tobytes() for x in np.split(a, cuts)] if len(ids) else []
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(cut(a), pa.binary()) for a in (near, score, fresh))], schema=LIST_SCHEMA)


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners, neighbours, scores and marks of packed lists, one by one."""
    near = np.frombuffer(b"".join(table["ids"].to_pylist()), I8)
    score = np.frombuffer(b"".join(table["scores"].to_pylist()), F4)
    fresh = np.frombuffer(b"".join(table["fresh"].to_pylist()), np.uint8)
    sizes = [len(x) // 8 for x in table["ids"].to_pylist()]
    return np.repeat(table["id"].to_numpy(), sizes), near, score, fresh


def _forest(nodes: DataFrame, count: int, degree: int) -> DataFrame:
    """Neighbours within chunks of similar nodes."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("q"))
            for t in range(TREES):
                planes = np.random.default_rng(t).standard_normal((x.shape[1], PLANES)).astype(np.float32)
                code = (x @ planes > 0) @ (1 << np.arange(PLANES)[::-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(x), pa.int32()), pa.array(code, pa.int64()), batch.column("id"), batch.column("q")], ["t", "code", "id", "q"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ids, x = table["id"].to_numpy(), _matrix(table["q"])
            n, most = len(ids), min(degree, len(ids) - 1)
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            top = np.argpartition(-s, most - 1, axis=1)[:, :most] if most else np.zeros((n, 0), np.int64)
            return _lists(np.repeat(ids, most), ids[top.ravel()], np.take_along_axis(s, top, 1).ravel(), np.ones(n * most, np.uint8), degree)

        rows, tree = 0, None
        for batch in batches:
            trees = batch.column("t").to_numpy()
            at = 0
            while at < batch.num_rows:
                if trees[at] != tree or rows == CHUNK:
                    if rows:
                        yield chunk()
                    held, rows, tree = [], 0, trees[at]
                end = min(int(np.searchsorted(trees, tree, side="right")), at + CHUNK - rows)
                held.append(batch.slice(at, end - at))
                rows += end - at
                at = end
        if rows:
            yield chunk()

    parts = max(1, count * TREES // (2 * CHUNK))
    # Ties go by a hash of their own in each tree: nodes that share their codes meet others in each.
    coded = nodes.mapInArrow(codes, "t int, code long, id long, q binary").withColumn("tie", F.xxhash64("t", "id"))
    by = ["t", "code", "tie", "id"]
    ordered = coded.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("tie")
    return ordered.mapInArrow(compare, LISTS)


def _edges(graph: DataFrame) -> DataFrame:
    """A row for each entry of the lists: ``u`` lists ``v``."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, near, _, fresh = _flat(pa.Table.from_batches([batch]))
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(near, pa.int64()), pa.array(fresh.astype(np.int32))], ["u", "v", "fresh"])

    return graph.mapInArrow(flat, "u long, v long, fresh int")


def _both_ways(graph: DataFrame, degree: int, seed: int) -> DataFrame:
    """The edges, and back edges thinned to about ``degree`` a node."""
    edges = _edges(graph)
    listed = edges.groupBy("v").agg(F.count("*").alias("n"))
    chance = F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    back = edges.join(listed, "v").where(chance * F.col("n") < degree).select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    return edges.unionByName(back)


def _descend(graph: DataFrame, nodes: DataFrame, degree: int, buckets: int, seed: int) -> DataFrame:
    """One round of NN-descent."""
    worst = F.when(F.length("scores") >= 4 * degree, F.expr("substring(scores, length(scores) - 3, 4)"))
    known = nodes.join(graph.select("id", worst.alias("worst")), "id").select(F.col("id").alias("v"), "q", "worst")
    met = _both_ways(graph, degree, seed).join(known, "v").withColumn("b", _bucket("u", buckets))

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by("u")
        u, v = table["u"].to_numpy(), table["v"].to_numpy()
        fresh = table["fresh"].to_numpy().astype(bool)
        x = _matrix(table["q"])
        worst = np.array([np.frombuffer(w, F4)[0] if w else -np.inf for w in table["worst"].to_pylist()], np.float32)
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        out = []
        for a, b in zip(first, np.r_[first[1:], len(u)], strict=True):
            if not fresh[a:b].any():
                continue
            s = x[a:b] @ x[a:b].T
            ok = (s > worst[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]) & (v[a:b, None] != v[None, a:b])
            i, j = np.nonzero(ok)
            out.append((v[a + i], v[a + j], s[i, j]))
        if not out:
            return pa.Table.from_batches([], OFFER_SCHEMA)
        best = pa.Table.from_batches([_lists(*map(np.concatenate, zip(*out, strict=True)), None, degree)])
        owner, near, score, _ = _flat(best)
        to = _spread(owner, buckets)
        order = np.argsort(to, kind="stable")
        found, begin = np.unique(to[order], return_index=True)
        cut = lambda a: pa.array([part.tobytes() for part in np.split(a[order], begin[1:])], pa.binary())
        return pa.table([pa.array(found, pa.int32()), cut(owner), cut(near), cut(score)], schema=OFFER_SCHEMA)

    # One row for each pair of buckets holds all that the nodes of one offer those of the other.
    offers = met.groupBy("b").applyInArrow(local, "b int, owners binary, ids binary, scores binary")

    def merge(now: pa.Table, offered: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(offered[c].to_pylist()), kind)
        known, more = _flat(now), (read("owners", I8), read("ids", I8), read("scores", F4))
        owner, near, score = (np.concatenate(p) for p in zip(known[:3], more, strict=True))
        fresh = np.r_[np.zeros(len(known[0]), np.uint8), np.ones(len(more[0]), np.uint8)]
        return pa.Table.from_batches([_lists(owner, near, score, fresh, degree)])

    return _by_spread(graph, buckets).groupBy("b").cogroup(offers.groupBy("b")).applyInArrow(merge, LISTS)


def _packed(df: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_quantised(x) if len(x) else [], pa.binary())], ["id", "q"])

    return df.select("id", "v").mapInArrow(pack, "id long, q binary")


def build(nodes: DataFrame, degree: int = DEGREE, settled: float = SETTLED) -> DataFrame:
    """Neighbour lists of the nodes (``id``, ``q``), improved until a round renews less than the share ``settled`` of their entries."""
    count = nodes.count()
    buckets = max(1, count // NODES_A_BUCKET)

    def best(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_lists(*_flat(table), degree)])

    graph = stored(_forest(nodes, count, degree).withColumn("b", _bucket("id", buckets)).groupBy("b").applyInArrow(best, LISTS))
    marks = F.length("fresh")
    new = F.length(F.replace(F.hex("fresh"), F.lit("00"), F.lit(""))) / 2
    seed = 0
    while True:
        graph = stored(_descend(graph, nodes, degree, buckets, seed))
        share = graph.agg((F.sum(new) / F.sum(marks)).alias("share")).first()["share"]
        if share is None or share < settled:
            return graph
        seed += 1


STATE = "id long, q binary, ids binary, scores binary, fresh binary"
STATE_SCHEMA = pa.schema([("id", pa.int64()), ("q", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary()), ("fresh", pa.binary())])
#: One row for each pair of buckets: query ids, their vectors and worst scores, and of each query so many nodes.
ASKED = pa.schema([("b", pa.int32()), ("owners", pa.binary()), ("q", pa.binary()), ("worst", pa.binary()), ("sizes", pa.binary()), ("nodes", pa.binary())])
I4 = np.dtype("<i4")


def _spread(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of nodes, as they are stored for the search."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _by_spread(df: DataFrame, buckets: int) -> DataFrame:
    names, schema = df.columns, ", ".join(f"{c} {kind}" for c, kind in df.dtypes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _spread(batch.column("id").to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b, pa.int32())], [*names, "b"])

    return df.mapInArrow(add, schema + ", b int")


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM, degree: int = DEGREE) -> DataFrame:
    """The best nodes found for each query node (``id``, ``q``), itself among them, as packed lists."""
    count = nodes.count()
    buckets = max(1, count // NODES_A_BUCKET)

    def whole(table: pa.Table) -> pa.Table:
        owner, near = table["u"].to_numpy(), table["v"].to_numpy()
        zero = np.zeros(len(owner))
        return pa.Table.from_batches([_lists(owner, near, zero, zero.astype(np.uint8), 1 << 40)]).select(["id", "ids"])

    ways = _both_ways(graph, degree, -1).withColumn("b", _bucket("u", buckets)).groupBy("b").applyInArrow(whole, "id long, ids binary")
    ways = stored(_by_spread(ways, buckets))
    placed = stored(_by_spread(nodes, buckets))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("q")) if batch.num_rows else np.zeros((0, 1), np.float32)
            own = [np.array([i], I8).tobytes() for i in batch.column("id").to_pylist()]
            score = [np.array([s], F4).tobytes() for s in (x * x).sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("q"), pa.array(own, pa.binary()), pa.array(score, pa.binary()), pa.array([b"\1"] * len(own), pa.binary())], schema=STATE_SCHEMA
            )

    state = stored(queries.mapInArrow(start, STATE))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each query wants expanded, and behind it what its beam holds already, by bucket of the node."""
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [np.frombuffer(x, I8) for x in batch.column("ids").to_pylist()]
            fresh = [np.frombuffer(x, np.uint8) > 0 for x in batch.column("fresh").to_pylist()]
            worst = [np.frombuffer(s, F4)[-1] if len(x) >= beam else -np.inf for s, x in zip(batch.column("scores").to_pylist(), lists, strict=True)]
            of = np.repeat(np.arange(len(lists)), [int(f.sum()) for f in fresh])
            nodes = np.concatenate([x[f] for x, f in zip(lists, fresh, strict=True)])
            for b, rows, sizes, part in _pairs_of(of, nodes, buckets):
                held = np.array([len(lists[i]) for i in rows], I4)
                beams = np.concatenate([lists[i] for i in rows])
                packed = _asked(batch.column("id").to_numpy()[rows], _bytes_of(batch.column("q"))[rows], np.array(worst, F4)[rows], np.r_[sizes, held], np.r_[part, beams])
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((b, *packed), ASKED, strict=True)], schema=ASKED)

    def expand(asked: pa.Table, adjacent: pa.Table) -> pa.Table:
        """The neighbours of the wanted nodes that no beam holds, by their own buckets."""
        by = dict(zip(adjacent["id"].to_pylist(), adjacent["ids"].to_pylist(), strict=True))
        owners, vectors, worst, found = [], [], [], []
        for row in asked.to_pylist():
            own, q, bad = _said(row)
            sizes = np.frombuffer(row["sizes"], I4)
            lists = np.split(np.frombuffer(row["nodes"], I8), np.cumsum(sizes)[:-1])
            for want, beams in zip(lists[: len(own)], lists[len(own) :], strict=True):
                near = np.frombuffer(b"".join([by.get(i, b"") for i in want.tolist()]), I8)
                found.append(np.setdiff1d(near, beams))
            owners.append(own)
            vectors.append(q)
            worst.append(bad)
        if not owners:
            return pa.Table.from_batches([], ASKED)
        own, q, bad = np.concatenate(owners), np.concatenate(vectors), np.concatenate(worst)
        of = np.repeat(np.arange(len(own)), [len(f) for f in found])
        rows = [(b, *_asked(own[k], q[k], bad[k], sizes, part)) for b, k, sizes, part in _pairs_of(of, np.concatenate(found), buckets)]
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ASKED)], schema=ASKED)

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        """Scores of the nodes that may still enter a query's beam."""
        said = [_said(row) for row in asked.to_pylist()]
        if not said:
            return pa.Table.from_batches([], LIST_SCHEMA)
        ids, x = held["id"].to_numpy(), _matrix(held["q"])
        order = np.argsort(ids)
        own, q, worst = (np.concatenate(p) for p in zip(*said, strict=True))
        sizes = np.concatenate([np.frombuffer(r, I4) for r in asked["sizes"].to_pylist()])
        nodes = np.concatenate([np.frombuffer(r, I8) for r in asked["nodes"].to_pylist()])
        at = order[np.searchsorted(ids, nodes, sorter=order)]
        by_query = np.lexsort((at, np.repeat(own, sizes)))
        owner, at = np.repeat(own, sizes)[by_query], at[by_query]
        once = np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])] if len(owner) else np.zeros(0, bool)
        owner, at = owner[once], at[once]
        queries, first = np.unique(own, return_index=True)
        vector, least = _matrix(pa.array([v.tobytes() for v in q[first]], pa.binary())), worst[first]
        begin = np.searchsorted(owner, queries)
        made = []
        for k, (a, b) in enumerate(zip(begin, np.r_[begin[1:], len(owner)], strict=True)):
            s = x[at[a:b]] @ vector[k]
            ok = s > least[k]
            made.append((owner[a:b][ok], ids[at[a:b][ok]], s[ok]))
        owner, near, s = map(np.concatenate, zip(*made, strict=True))
        return pa.Table.from_batches([_lists(owner, near, s, np.ones(len(owner), np.uint8), beam)])

    def merge(now: pa.Table, more: pa.Table) -> pa.Table:
        """The beam after a round: what was in it has been expanded."""
        known, seen = _flat(now), _flat(more)
        owner, near, s, fresh = (np.concatenate(p) for p in zip((*known[:3], np.zeros(len(known[3]), np.uint8)), seen, strict=True))
        lists = pa.Table.from_batches([_lists(owner, near, s, fresh, beam)])
        vector = dict(zip(now["id"].to_pylist(), now["q"].to_pylist(), strict=True))
        return lists.append_column("q", pa.array([vector[i] for i in lists["id"].to_pylist()], pa.binary())).select(STATE_SCHEMA.names)

    asked_type = "b int, owners binary, q binary, worst binary, sizes binary, nodes binary"
    q_buckets = max(1, buckets // 4)
    by_query = lambda df: df.withColumn("b", _bucket("id", q_buckets)).groupBy("b")
    while True:
        wanted = state.mapInArrow(ask, asked_type)
        spread = wanted.groupBy("b").cogroup(ways.groupBy("b")).applyInArrow(expand, asked_type)
        scored = spread.groupBy("b").cogroup(placed.groupBy("b")).applyInArrow(score, LISTS)
        state = stored(by_query(state).cogroup(by_query(scored)).applyInArrow(merge, STATE))
        if state.where(F.instr(F.hex("fresh"), "01") > 0).isEmpty():
            return state.select("id", "ids", "scores", "fresh")


def _pairs_of(of: np.ndarray, nodes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bucket of the nodes: whose they are, how many of each owner, and the nodes in that order."""
    if not len(nodes):
        return
    b = _spread(nodes, buckets)
    order = np.lexsort((of, b))
    b, of, nodes = b[order], of[order], nodes[order]
    found, first = np.unique(b, return_index=True)
    for k, start, stop in zip(found.tolist(), first, np.r_[first[1:], len(b)], strict=True):
        rows, sizes = np.unique(of[start:stop], return_counts=True)
        yield k, rows, sizes.astype(I4), nodes[start:stop]


def _bytes_of(column) -> np.ndarray:
    """Packed vectors as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _asked(own: np.ndarray, q: np.ndarray, worst: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> tuple[bytes, ...]:
    return own.astype(I8).tobytes(), q.tobytes(), worst.astype(F4).tobytes(), sizes.astype(I4).tobytes(), nodes.astype(I8).tobytes()


def _said(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids of a row, their packed vectors and worst scores."""
    own = np.frombuffer(row["owners"], I8)
    return own, np.frombuffer(row["q"], np.uint8).reshape(len(own), -1), np.frombuffer(row["worst"], F4)


def nearest(
    table: DataFrame, is_query: Column, top: int = 20, id_column: str = "vec_id", vector: str = "embedding", degree: int = DEGREE, beam: int = BEAM
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id``, ``score`` of the ``top`` nearest rows found for each query.

    ``is_query`` is a condition on ``id``. Which rows take part: see ``vectors``. Ties go to the
    smaller id; a query without other rows gets none. Columns but the two named ones are not read.
    """
    rows = stored(vectors(table, id_column, vector))
    # Of each vector its least ids: more than `top` and the query's own never count.
    salted = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, top + 1).alias("ids"))
    members = stored(
        salted.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, top + 1).alias("ids")).select(F.col("ids")[0].alias("id"), "v", "ids")
    )
    nodes = stored(_packed(members))
    graph = build(nodes, degree)
    asked = rows.where(is_query).select(F.col("id").alias("query_id"), "v").join(members.select("v", "id"), "v")
    found = search(nodes.join(asked.select("id").distinct(), "id", "left_semi"), nodes, graph, max(beam, top + 1), degree)
    pairs = _edges(found).select(F.col("u").alias("node"), F.col("v").alias("id"))
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    candidates = (
        asked.select("query_id", F.col("id").alias("node"), F.col("v").alias("qv"))
        .join(pairs, "node")
        .join(members, "id")
        .select("query_id", product.alias("score"), F.explode("ids").alias("id"))
        .where("id != query_id")
    )
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("key"), "id", "score")))
    listed = candidates.groupBy("query_id").agg(F.slice(best, 1, top).alias("best"))
    return listed.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.id", "x.score")
