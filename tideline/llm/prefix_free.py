"""Repeated byte strings across documents, by prefix-free parsing and suffix ranks.

Parsing. Every byte position has the rolling hash of its next ``TRIGGER`` bytes. The triggers
are the positions whose hash is least among those in some window of ``length`` bytes, so every
window holds one and equal windows hold the same. A run of windows with one trigger is a
phrase, which overlaps the next by ``length - 1`` bytes: the phrases of a document are its
parse, and no phrase needs its neighbours to order the windows that start in it.

Dictionary. A window can only repeat if its trigger does. Triggers are counted first, packed
into arrays of a few bytes each; then only phrases whose trigger stands in two documents are
sent, each different one once from a bucket of documents. Those with one trigger meet in one
bucket of triggers. There the different phrases form the dictionary, whose suffixes are
ranked to ``length`` bytes by prefix doubling (8, 16, 32, then the rest). Equal rank is equal
bytes, so the least document of a rank is the first of all occurrences in the corpus.

Corpus order. The parse brings the ranks back: a bucket of documents gets, for each of its
phrases, the first document that has it and which of its windows some earlier document has
in another phrase.

A passage that very many documents share crosses the shuffle once for each bucket of
documents, not once for each of them; buckets hold about ``PART`` bytes of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bytework import BYTE, PRIME, buffers, mix, runs_of, slice_hashes, sliced
from tideline.llm.frames import MB, keyed, parts_for, text_bytes

LENGTH = 50
TRIGGER = 24
PART = 16 * MB
SLICE = MB // 2
FLUSH = 4_000_000


def _trigger_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``TRIGGER`` (24) bytes from each position on."""
    step = lambda n: np.uint64(pow(PRIME, n, 1 << 64))
    h = BYTE[data]
    for n in (1, 2, 4):
        h = h[:-n] * step(n) + h[n:]
    eight = h
    h = eight[:-8] * step(8) + eight[8:]
    return mix(h[:-8] * step(8) + eight[16:])


def phrases(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger, first and last window of each phrase of all texts."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), none, none
    h = _trigger_hashes(data)
    width = length - TRIGGER + 1
    least, n = h, 1
    while 2 * n <= width:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    if n < width:
        least = np.minimum(least[: len(least) - (width - n)], least[width - n :])
    windows = len(data) - length + 1
    least = least[:windows]
    change = np.zeros(windows + 1, np.int32)
    begin, end = off[:-1], off[1:] - length + 1
    some = end > begin
    change[begin[some]] += 1
    np.subtract.at(change, end[some], 1)
    valid = np.cumsum(change[:-1]) > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    starts = np.flatnonzero(first)
    return mix(least[starts]), starts, np.flatnonzero(last)


def _shared_trigger(data: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Whether another phrase of the dictionary has the same trigger."""
    if not len(sizes):
        return np.zeros(0, bool)
    h = np.r_[_trigger_hashes(data), np.zeros(TRIGGER, np.uint64)]
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    trigger = np.minimum.reduceat(h, np.stack([begin, begin + length - TRIGGER + 1], axis=1).ravel())[::2]
    _, place, times = np.unique(trigger, return_inverse=True, return_counts=True)
    return times[place] > 1


def suffix_ranks(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of each suffix by its first ``length`` (33 to 64) bytes; zeros follow the end."""
    padded = np.zeros(len(data) + 128, np.uint64)
    padded[: len(data)] = data
    n = len(data) + 64
    code = padded[:n].copy()
    for j in range(1, 8):
        code = (code << np.uint64(8)) | padded[j : j + n]
    rank = np.unique(code, return_inverse=True)[1].astype(np.uint64)
    for step in (8, 16, length - 32):
        n -= step
        rank = np.unique((rank[:n] << np.uint64(32)) | rank[step : step + n], return_inverse=True)[1].astype(np.uint64)
    return rank[: len(data)].astype(np.int64) if len(rank) >= len(data) else np.concatenate([rank, np.zeros(len(data) - len(rank), np.uint64)]).astype(np.int64)


def _raw(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _groups(key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each different key and the places where it stands."""
    if not len(key):
        return []
    order = np.argsort(key, kind="stable")
    found, first = np.unique(key[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, first[1:]), strict=True))


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of slices, one behind the other."""
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum())) if len(sizes) else np.zeros(0, np.int64)
    return data[at]


COUNTED = "a int, marks binary, buckets binary, more binary"
REPEATED = "b int, a int, marks binary"
SENT = "a int, b int, ids binary, low binary, high binary, sizes binary, bytes binary"
KNOWN = "b int, ids binary, first binary, windows binary, flags binary"


def _table(rows: list[tuple], types: str) -> pa.Table:
    names = [x.split() for x in types.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], pa.int32() if k == "int" else pa.binary()) for i, (n, k) in enumerate(names)})


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """A row for each row of ``docs``: ``id``, ``n_bytes``, ``n_removed``, ``spans``, ``kept``.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller
    id; both are judged on the input. ``spans`` are the maximal removed runs as (start, end) in
    bytes, ``kept`` the remaining bytes (a cut may fall inside a character). Null texts count as
    empty; null ids come last and, like rows that share an id, take nothing from each other.
    Shorter texts stay whole. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_column, text)
    parts = parts_for(spark, text_bytes(rows), PART)
    rows = rows.withColumn("b", F.pmod(F.xxhash64("k1", "k2"), F.lit(parts)).cast("int"))

    def split(trigger: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (trigger % np.uint64(parts)).astype(np.int64), (trigger >> np.uint64(32)).astype(np.uint32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            trigger, bucket = map(np.concatenate, zip(*held, strict=True))
            order = np.lexsort((bucket, trigger))
            trigger, bucket = trigger[order], bucket[order]
            new = np.r_[True, (trigger[1:] != trigger[:-1]) | (bucket[1:] != bucket[:-1])]
            at = np.flatnonzero(new)
            more = np.diff(np.r_[at, len(trigger)]) > 1
            a, marks = split(trigger[at])
            made = [(k, _raw(marks[p]), _raw(bucket[at][p]), _raw(more[p])) for k, p in _groups(a)]
            return _table(made, COUNTED).combine_chunks().to_batches()[0]

        for batch in sliced(batches, "text", SLICE):
            data, off = buffers(batch.column("text"))
            trigger, start, _ = phrases(data, off, length)
            owner = np.searchsorted(off, start, side="right") - 1
            order = np.lexsort((trigger, owner))
            owner, trigger = owner[order], trigger[order]
            once = np.r_[True, (owner[1:] != owner[:-1]) | (trigger[1:] != trigger[:-1])] if len(owner) else np.zeros(0, bool)
            held.append((trigger[once], batch.column("b").to_numpy().astype(np.int32)[owner[once]]))
            n += int(once.sum())
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def repeated(table: pa.Table) -> pa.Table:
        """For each bucket of documents its triggers that stand in two documents of the corpus."""
        a = table["a"][0].as_py()
        read = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        marks, bucket, times = read("marks", np.uint32), read("buckets", np.int32), read("more", np.uint8).astype(np.int64) + 1
        values, place = np.unique(marks, return_inverse=True)
        often = np.bincount(place, times, len(values)) > 1
        keep = often[place]
        made = [(b, a, _raw(np.unique(marks[keep][p]))) for b, p in _groups(bucket[keep])]
        return _table(made, REPEATED)

    def scan(batch: pa.RecordBatch) -> tuple:
        """Bytes, offsets, first and last windows, ids and split triggers of the phrases of a slice."""
        data, off = buffers(batch.column("text"))
        trigger, first, last = phrases(data, off, length)
        ids = mix(trigger ^ slice_hashes(data, first, last + length)) if len(first) else trigger
        return data, off, first, last, ids, trigger

    def send(texts: pa.Table, known: pa.Table) -> pa.Table:
        """The different phrases with a repeated trigger, by bucket of triggers."""
        if not known.num_rows or not texts.num_rows:
            return _table([], SENT)
        want = np.concatenate(
            [(np.uint64(a) << np.uint64(32)) | np.frombuffer(m, np.uint32).astype(np.uint64) for a, m in zip(known["a"].to_pylist(), known["marks"].to_pylist(), strict=True)]
        )
        want.sort()
        out = []
        for batch in sliced(iter(texts.to_batches()), "text", SLICE):
            data, off, first, last, ids, trigger = scan(batch)
            a, marks = split(trigger)
            key = (a.astype(np.uint64) << np.uint64(32)) | marks.astype(np.uint64)
            hit = want[np.minimum(np.searchsorted(want, key), len(want) - 1)] == key
            owner = np.searchsorted(off, first[hit], side="right") - 1
            k1 = batch.column("k1").to_numpy()[owner]
            sizes = last[hit] - first[hit] + length
            one, low, high, at = _folded(ids[hit], k1, k1)
            out.append((one, low, high, a[hit][at], sizes[at], _gather(data, first[hit][at], sizes[at])))
        ids, low, high, a, sizes, content = map(np.concatenate, zip(*out, strict=True))
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ids, low, high, at = _folded(ids, low, high)
        b = texts["b"][0].as_py()
        made = []
        for k, p in _groups(a[at]):
            n = sizes[at][p]
            made.append((k, b, _raw(ids[p]), _raw(low[p]), _raw(high[p]), _raw(n.astype(np.uint32)), pa.compress(_raw(_gather(content, begin[at][p], n)), codec="zstd", asbytes=True)))
        return _table(made, SENT)

    def order(table: pa.Table) -> pa.Table:
        """First documents of phrases and of their windows, back to the buckets of documents."""
        read = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        ids, low, high, sizes = read("ids", np.uint64), read("low", np.int64), read("high", np.int64), read("sizes", np.uint32).astype(np.int64)
        bucket = np.repeat(table["b"].to_numpy(), [len(x) // 8 for x in table["ids"].to_pylist()])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        own, least, _, at = _folded(ids, low, high)
        n = sizes[at]
        whole = [int(np.frombuffer(x, np.uint32).sum()) for x in table["sizes"].to_pylist()]
        packed = table["bytes"].to_pylist()
        content = np.frombuffer(b"".join(pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip(packed, whole, strict=True)), np.uint8)
        windows = n - length + 1
        at_window = np.concatenate([[0], np.cumsum(windows)[:-1]])
        flag = np.zeros(int(windows.sum()), bool)
        # The only phrase with its trigger shares no window with another.
        several = np.flatnonzero(_shared_trigger(_gather(content, begin[at], n), n, length))
        if len(several):
            some = n[several]
            dictionary = _gather(content, begin[at][several], some)
            starts = _gather(np.arange(len(dictionary)), np.concatenate([[0], np.cumsum(some)[:-1]]), windows[several])
            rank = suffix_ranks(dictionary, length)[starts]
            mine = np.repeat(least[several], windows[several])
            place = np.argsort(rank, kind="stable")
            new = np.flatnonzero(np.r_[True, rank[place][1:] != rank[place][:-1]])
            first = np.empty(len(rank), np.int64)
            first[place] = np.repeat(np.minimum.reduceat(mine[place], new), np.diff(np.r_[new, len(rank)]))
            flag[_gather(np.arange(len(flag)), at_window[several], windows[several])] = first < mine
        phrase = np.repeat(np.arange(len(own)), windows)
        flagged = np.bincount(phrase, flag, len(own)) > 0
        to = np.searchsorted(own, ids)
        useful = flagged[to] | (high > least[to])
        made = []
        for b, p in _groups(bucket[useful]):
            q = to[useful][p]
            made.append((b, _raw(own[q]), _raw(least[q]), _raw(windows[q].astype(np.uint32)), _raw(np.packbits(_gather(flag, at_window[q], windows[q])))))
        return _table(made, KNOWN)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    result = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())])

    def remove(texts: pa.Table, known: pa.Table) -> pa.Table:
        ids, least, windows, flags = [], [], [], []
        for i, f, w, bits in zip(*(known[c].to_pylist() for c in ("ids", "first", "windows", "flags")), strict=True):
            ids.append(np.frombuffer(i, np.uint64))
            least.append(np.frombuffer(f, np.int64))
            windows.append(np.frombuffer(w, np.uint32).astype(np.int64))
            flags.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=int(windows[-1].sum())))
        if ids:
            ids, least, windows, flags = map(np.concatenate, (ids, least, windows, flags))
            at_flag = np.concatenate([[0], np.cumsum(windows)[:-1]])
            place = np.argsort(ids)
            ids, least, at_flag = ids[place], least[place], at_flag[place]
        made = []
        for batch in sliced(iter(texts.to_batches()), "text", SLICE):
            data, off = buffers(batch.column("text"))
            gone = np.zeros(len(data), bool)
            if len(ids):
                _, _, first, last, mine, _ = scan(batch)
                to = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
                hit = ids[to] == mine
                to, first, last = to[hit], first[hit], last[hit]
                k1 = batch.column("k1").to_numpy()[np.searchsorted(off, first, side="right") - 1]
                n = last - first + 1
                at = _gather(np.arange(len(data)), first, n)
                removed = np.zeros(len(data) + 1, np.int64)
                removed[at] = np.repeat(k1 > least[to], n) | (_gather(flags, at_flag[to], n) > 0)
                total = np.cumsum(removed[:-1])
                gone = total > 0
                gone[length:] = total[length:] > total[:-length]
            starts, ends = runs_of(gone, off)
            owner = np.searchsorted(off, starts, side="right") - 1
            cut = np.searchsorted(owner, np.arange(len(off)))
            for d, i in enumerate(batch.column("id").to_pylist()):
                a, e = int(off[d]), int(off[d + 1])
                s = slice(cut[d], cut[d + 1])
                found = [{"start": x - a, "end": y - a} for x, y in zip(starts[s].tolist(), ends[s].tolist(), strict=True)]
                kept = data[a:e][~gone[a:e]] if found else data[a:e]
                made.append({"id": i, "n_bytes": e - a, "n_removed": e - a - len(kept), "spans": found, "kept": kept.tobytes()})
        return pa.Table.from_pylist(made, result)

    texts = rows.select("b", "id", "k1", "text").groupBy("b")
    counted = rows.select("b", "text").mapInArrow(count, COUNTED)
    twice = counted.groupBy("a").applyInArrow(repeated, REPEATED)
    sent = texts.cogroup(twice.groupBy("b")).applyInArrow(send, SENT)
    known = sent.groupBy("a").applyInArrow(order, KNOWN)
    return texts.cogroup(known.groupBy("b")).applyInArrow(remove, "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def _folded(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each different id, the least ``low`` and greatest ``high`` it has, and where it stands first."""
    if not len(ids):
        return ids, low, high, np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    new = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    return ids[order][new], np.minimum.reduceat(low[order], new), np.maximum.reduceat(high[order], new), order[new]
