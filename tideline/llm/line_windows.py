"""Repeated passages of lines, by overlapping windows of three lines.

Every window of ``SIZE`` consecutive lines gets a 128-bit hash. Of all windows with one hash,
in order of document and line, the first stays and each later one is removed; the lines under
removed windows merge into spans. A document's own repeats are settled where it is scanned, so
it sends one row for each different window. Counts and first documents are folded before the
shuffle, and repeated windows meet their rows again in a plain equi-join, whose large keys
Spark's adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.frames import checkpointed, fresh, keyed, keys

SIZE = 3
BLANK = " \t\n\f\r"


def split_lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def window_hashes(lines: list[str], size: int = SIZE) -> list[bytes | None]:
    """A hash for each window; None for one of blank lines only, which is never removed."""
    digest = lambda b: blake2b(b, digest_size=16).digest()
    each = [digest(x.encode()) for x in lines]
    blank = [not x.strip(BLANK) for x in lines]
    return [None if all(blank[p : p + size]) else digest(b"".join(each[p : p + size])) for p in range(len(lines) - size + 1)]


def removed_spans(hashes: list[bytes | None], repeated: set[int], size: int = SIZE) -> list[tuple[int, int]]:
    """Merged (start, end) of the lines to remove. ``repeated``: first positions of windows that stand in an earlier document."""
    seen: dict[bytes, bool] = {}
    spans: list[tuple[int, int]] = []
    for p, h in enumerate(hashes):
        if h is None:
            continue
        if h in seen or p in repeated:
            if spans and p <= spans[-1][1]:
                spans[-1] = (spans[-1][0], p + size)
            else:
                spans.append((p, p + size))
        seen[h] = True
    return spans


def dedupe_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Every row and column of ``docs`` with the text that is left, then ``_n_lines``, ``_n_removed`` and ``_spans``.

    Documents come in order of id, null ids last, and then of a hash of their text; rows with the
    same id and text are one document and get the same result. Input columns of the three added names are dropped. Lines end with a line feed and are
    compared exactly. Texts of fewer than ``size`` lines, empty and null ones stay as they are.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, high, low = [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                mine = set()
                for p, h in enumerate(window_hashes(split_lines(t), size)):
                    if h is not None and h not in mine:
                        mine.add(h)
                        row.append(i)
                        at.append(p)
                        high.append(int.from_bytes(h[:8], "little", signed=True))
                        low.append(int.from_bytes(h[8:], "little", signed=True))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1").take(take), batch.column("k2").take(take), pa.array(at, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                ["k1", "k2", "at", "h1", "h2"],
            )

    rows = checkpointed(keyed(docs, id_column, text).select("text", "k1", "k2").mapInArrow(windows, "k1 long, k2 long, at int, h1 long, h2 long"))
    key = F.struct("k1", "k2")
    repeated = rows.groupBy("h1", "h2").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first != last")
    later = (
        rows.join(repeated.select("h1", "h2", "first"), ["h1", "h2"])
        .where(key != F.col("first"))
        .groupBy("k1", "k2")
        .agg(F.collect_set("at").alias("at"))  # at most one for each of the document's own lines
    )

    docs = docs.drop("_n_lines", "_n_removed", "_spans")
    names = docs.columns
    one, two, where = fresh(docs, "_k1", "_k2", "_at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed, all_spans = [], [], [], []
            for t, at in zip(batch.column(text).to_pylist(), batch.column(where).to_pylist(), strict=True):
                lines = split_lines(t)
                spans = removed_spans(window_hashes(lines, size), set(at or ()), size)
                if spans:
                    ends = [0, *(e for _, e in spans)]
                    starts = [*(s for s, _ in spans), len(lines)]
                    t = "\n".join(x for a, b in zip(ends, starts, strict=True) for x in lines[a:b])
                texts.append(t)
                n_lines.append(len(lines))
                n_removed.append(sum(e - s for s, e in spans))
                all_spans.append([{"start": s, "end": e} for s, e in spans])
            kept = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(all_spans, span)],
                [*names, "_n_lines", "_n_removed", "_spans"],
            )

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes), "`_n_lines` long, `_n_removed` long, `_spans` array<struct<start:int,end:int>>"])
    marked = docs.withColumns(dict(zip((one, two), keys(id_column, text), strict=True)))
    met = marked.join(later.select(F.col("k1").alias(one), F.col("k2").alias(two), F.col("at").alias(where)), [one, two], "left")
    return met.select(*(F.col(f"`{c}`") for c in names), where).mapInArrow(cut, schema)
