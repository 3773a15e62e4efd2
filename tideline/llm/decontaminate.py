"""Benchmark passages in documents, as a prefix-filtered set join on word shingles.

An item is cut into windows of ``window`` consecutive words (one shorter window if it has
fewer). A document contains a window only if it has all of the window's shingles, so the join
needs a prefix of one: each window is filed under its rarest shingle of the corpus, and is
dropped if any of its shingles occurs nowhere. Document positions with a filed shingle meet
those windows; the shingle's offset and the window's length must fit between the document's
ends (positional and length bounds), and the words are then compared one by one.

Which shingles matter is told to the scanning tasks by a bitmap of fixed size (``BITS`` of them),
whatever the size of the benchmark; its false hits die in the join. Windows are salted, so a
passage that a third of all documents share is not one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.bytework import buffers, in_bitmap, shingle_hashes, sliced, word_hashes
from tideline.llm.frames import bitmap, checkpointed, keyed

WINDOW = 10
SHINGLE = 3
SALTS = 16


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    return [data[s:e].tobytes().lower().decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _windows(items: DataFrame, item_column: str, text: str, window: int) -> DataFrame:
    """``item``, ``words``, ``size`` of every window, and hash, offset and length of its shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            starts, ends, owner, h = word_hashes(data, off)
            first = np.searchsorted(owner, np.arange(len(off)))
            names = batch.column("item").to_pylist()
            rows = []
            for i, name in enumerate(names):
                a, b = int(first[i]), int(first[i + 1])
                if a == b:
                    continue
                size = min(window, b - a)
                length = min(SHINGLE, size)
                words = _words(data, starts[a:b], ends[a:b])
                of = shingle_hashes(h[a:b], length).view(np.int64).tolist()
                for p in range(b - a - size + 1):
                    marks = [{"h": of[p + o], "o": o, "n": length} for o in range(size - length + 1)]
                    rows.append({"item": name, "words": " ".join(words[p : p + size]), "size": size, "marks": marks})
            kind = pa.struct([("h", pa.int64()), ("o", pa.int32()), ("n", pa.int32())])
            yield pa.RecordBatch.from_pylist(
                rows, pa.schema([("item", pa.string()), ("words", pa.string()), ("size", pa.int32()), ("marks", pa.list_(kind))])
            )

    named = F.coalesce(F.col(item_column).cast("string"), F.lit("null")).alias("item")
    return items.select(named, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(
        cut, "item string, words string, size int, marks array<struct<h:long,o:int,n:int>>"
    )


def _covered(spans: Column) -> Column:
    """Words under sorted spans of (start, end)."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["to"], s["end"]).alias("to"),
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n"),
    )
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contained(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """A row for each row of ``docs``: ``id``, ``k1``, ``k2``, ``n_words``, ``n_hit``, ``spans``, ``items``.

    Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. ``spans`` are the
    occurrences of item windows as (start, end) in words, sorted; ``n_hit`` counts the words under
    them once; ``items`` has the ids of the items concerned, sorted as strings (a null id is
    ``null``; an id in several rows is one item). Null or wordless texts have no words; items
    without words match nothing; repeated documents each get their row; other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    windows = checkpointed(_windows(items, item_column, item_text, window))
    marks = windows.select(F.explode("marks").alias("m")).select("m.h", "m.n").distinct()
    lengths = sorted(r["n"] for r in marks.select("n").distinct().collect())  # SHINGLE values at most
    asked = context.broadcast(bitmap(marks))
    rows = keyed(docs, id_column, text)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            _, _, owner, h = word_hashes(*buffers(batch.column("text")))
            for n in lengths:
                s = shingle_hashes(h, n)
                s = s[(owner[: len(s)] == owner[n - 1 :]) & in_bitmap(asked.value, s)]
                values, times = np.unique(s, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], ["h", "times"])

    times = rows.select("text").mapInArrow(tally, "h long, times long").groupBy("h").agg(F.sum("times").alias("times"))

    # Of each different window the rarest shingle; windows with a shingle that no document has are gone.
    shingles = windows.select("words", "size", "marks").distinct().select("words", "size", F.explode("marks").alias("m"))
    ranked = shingles.select("words", "size", F.col("m.h").alias("h"), F.col("m.o").alias("o"), F.col("m.n").alias("n")).join(times, "h", "left")
    rarest = ranked.groupBy("words", "size").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "h", "o", "n")).alias("m")
    )
    filed = checkpointed(
        rarest.where("m.times > 0")
        .select("words", "size", F.col("m.h").alias("h"), F.col("m.o").alias("o"), F.col("m.n").alias("n"))
        .join(windows.select("words", "item").distinct(), "words")
    )
    kept = context.broadcast(bitmap(filed.select("h").distinct()))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            data, off = buffers(batch.column("text"))
            starts, ends, owner, h = word_hashes(data, off)
            first = np.searchsorted(owner, np.arange(len(off)))
            doc, at, mark, lead, near = [], [], [], [], []
            for n in lengths:
                s = shingle_hashes(h, n)
                for p in np.flatnonzero((owner[: len(s)] == owner[n - 1 :]) & in_bitmap(kept.value, s)).tolist():
                    d = int(owner[p])
                    a, b = max(int(first[d]), p - window + 1), min(int(first[d + 1]), p + window)
                    doc.append(d)
                    at.append(p - int(first[d]))
                    mark.append(int(s[p : p + 1].view(np.int64)[0]))
                    lead.append(p - a)
                    near.append(_words(data, starts[a:b], ends[a:b]))
            n_docs, n_found = batch.num_rows, len(doc)
            takes = pa.array(list(range(n_docs)) + doc, pa.int64())
            key = [batch.column(c).take(takes) for c in ("id", "k1", "k2")]
            plain = pa.array([True] * n_docs + [False] * n_found)
            n_words = pa.array(np.diff(first).tolist() + [0] * n_found, pa.int64())
            marks_ = pa.array(batch.column("k2").to_pylist() + mark, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *key, plain, n_words, marks_,
                    pa.array([0] * n_docs + at, pa.int32()),
                    pa.array([0] * n_docs + lead, pa.int32()),
                    pa.array([None] * n_docs + near, pa.list_(pa.string())),
                ],
                ["id", "k1", "k2", "plain", "n_words", "h", "at", "lead", "near"],
            )

    found = rows.mapInArrow(
        candidates, "id long, k1 long, k2 long, plain boolean, n_words long, h long, at int, lead int, near array<string>"
    ).withColumn("salt", F.expr(f"cast(pmod(k2, {SALTS}) as int)"))
    salted = filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fits = (F.col("lead") >= F.col("o")) & (F.size("near") - F.col("lead") + F.col("o") >= F.col("size"))
    same = F.array_join(F.expr("slice(near, lead - o + 1, size)"), " ") == F.col("words")
    met = found.join(salted, ["h", "salt"], "left")
    hit = ~F.col("plain") & F.coalesce(F.when(fits, same), F.lit(False))
    start = F.col("at") - F.col("o")
    # Null where a row is no hit: sets leave nulls out.
    return (
        met.select(
            "id", "k1", "k2", "plain", "n_words",
            F.when(hit, F.struct(start.alias("start"), (start + F.col("size")).alias("end"))).alias("span"),
            F.when(hit, F.col("item")).alias("item"),
        )
        .groupBy("k1", "k2")
        .agg(
            F.max("id").alias("id"),
            F.max("n_words").alias("n_words"),
            F.count_if("plain").alias("rows"),
            F.array_sort(F.collect_set("span")).alias("spans"),
            F.array_sort(F.collect_set("item")).alias("items"),
        )
        .select("id", "k1", "k2", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", "items", F.explode(F.expr("sequence(1L, rows)")).alias("row"))
        .drop("row")
    )
