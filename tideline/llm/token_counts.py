"""Token counts by distinct pre-token.

A piece of the vocabulary never holds a space mark behind another character and never a line
feed next to one (checked when the model is loaded), so no merge crosses the edges of runs
``spaces + other characters``. The pieces of such a pre-token are the same in every text:
they are counted once for each distinct pre-token and summed over each document's
pre-token frequencies; ids are never built.

The most frequent pre-tokens (at most ``HEAD``, each of at most ``HEAD_CHARS`` characters)
reach the scanning tasks as a table, so that common ones are neither shuffled nor make a hot
key; all others are joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.frames import keyed, stored

HEAD = 1 << 19
HEAD_CHARS = 64
SPREAD = 9973
SPACE = "▁"
PRE_TOKEN = re.compile(f"\n|[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+")


def load(model: str | bytes):
    """The tokenizer; refuses a vocabulary whose pieces can cross pre-tokens."""
    import sentencepiece

    at = {"model_proto": model} if isinstance(model, bytes) else {"model_file": model}
    processor = sentencepiece.SentencePieceProcessor(**at)
    crossing = re.compile(f"[^{SPACE}]{SPACE}|.\n|\n.", re.S)
    for i in range(processor.vocab_size()):
        if crossing.search(processor.id_to_piece(i)):
            raise ValueError(f"piece {i} crosses the edge of a pre-token")
    return processor


def pre_tokens(text: str) -> list[str]:
    """The text cut where no merge can cross; a space opens every text that isn't empty."""
    return PRE_TOKEN.findall(" " + text) if text else []


def count_pieces(processor, found: list[str]) -> list[int]:
    """Pieces of each pre-token: behind a line feed, which stands for itself, no space is added."""
    lead = len(processor.encode("\n"))
    return [len(ids) - lead for ids in processor.encode(["\n" + x for x in found], num_threads=1)]


def token_counts(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``id``, ``n_bytes``, ``n_tokens``.

    Null texts count as empty: no bytes, no tokens. Repeated rows and null ids are counted
    like any other; further columns are not read. ``model`` is read on the driver and sent along.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    with open(model, "rb") as f:
        proto = f.read()
    load(proto)
    shipped = context.broadcast(proto)
    rows = keyed(docs, id_column, text)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column(0).to_pylist():
                seen.update(pre_tokens(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pre", "n"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(shipped.value)
        for batch in batches:
            counted = count_pieces(processor, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counted, pa.int64())], ["pre", "n", "pieces"])

    distinct = rows.select("text").mapInArrow(frequencies, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    counted = stored(distinct.mapInArrow(pieces, "pre string, n long, pieces long"))

    head = context.broadcast(_head(counted))

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            owner: list[int] = []
            pre: list[str] = []
            times: list[int] = []
            base: list[int] = []
            for row, t in enumerate(batch.column("text").to_pylist()):
                total = 0
                for x, n in Counter(pre_tokens(t)).items():
                    if (p := known.get(x)) is None:
                        owner.append(row)
                        pre.append(x)
                        times.append(n)
                    else:
                        total += p * n
                base.append(total)
            n_rows, rest = batch.num_rows, len(owner)
            takes = pa.array(list(range(n_rows)) + owner, pa.int64())
            plain = pa.array([True] * n_rows + [False] * rest)
            # No pre-token goes on behind a line feed: the rows of whole documents meet no pieces and spread evenly.
            words = pa.array([f"\n{k % SPREAD}" for k in batch.column("k2").to_pylist()] + pre, pa.string())
            keys = [batch.column(c).take(takes) for c in ("k1", "k2")]
            once = [pa.chunked_array([batch.column(c), pa.nulls(rest, pa.int64())]).combine_chunks() for c in ("id", "n_bytes")]
            yield pa.RecordBatch.from_arrays(
                [*once, *keys, plain, words, pa.array(base + times, pa.int64())], ["id", "n_bytes", "k1", "k2", "plain", "pre", "n"]
            )

    scanned = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        by_document, "id long, n_bytes long, k1 long, k2 long, plain boolean, pre string, n long"
    )
    summed = (
        scanned.join(counted.select("pre", "pieces"), "pre", "left")
        .groupBy("k1", "k2")
        .agg(
            F.max("id").alias("id"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("tokens"),
            F.count_if("plain").alias("rows"),
        )
    )
    # Rows with the same id and text add to one sum, and each gets its share back.
    return summed.select(
        "id", "n_bytes", F.expr("tokens div rows").alias("n_tokens"), F.explode(F.expr("sequence(1L, rows)")).alias("row")
    ).drop("row")


def _head(counted: DataFrame) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, ``HEAD`` at most."""
    short = counted.where(F.length("pre") <= HEAD_CHARS)
    steps = F.floor(F.log2("n") * 4).cast("int")
    sizes = short.groupBy(steps.alias("step")).count().orderBy(F.desc("step")).collect()
    room, least = HEAD, None
    for row in sizes:
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    if least is None:
        return {}
    return {r["pre"]: r["pieces"] for r in short.where(steps >= least).select("pre", "pieces").collect()}
