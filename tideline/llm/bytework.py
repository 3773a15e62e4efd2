"""Array helpers over the UTF-8 bytes of an Arrow batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPAN = 1 << 20
BITS = 1 << 26
_RNG = np.random.default_rng(20_240_101)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)

#: ASCII letters and digits and all bytes of other characters.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = True
WORD_BYTES[128:] = True


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins; one more offset closes the last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def sliced(batches: Iterator[pa.RecordBatch], text: int | str, limit: int = 2 * SPAN) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that none has more than ``limit`` bytes of text, but for single long texts."""
    for batch in batches:
        _, off = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs_of(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends with its text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(mask), bool)
    first[off[:-1][off[:-1] < len(mask)]] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | first[1:]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | first[1:]
    return np.flatnonzero(start), np.flatnonzero(last) + 1


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SPAN + 1024), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``; slices are in order of their starts."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = starts[a]
        b = max(a + 1, int(np.searchsorted(starts, base + SPAN)))
        top = int(ends[a:b].max()) if b > a + 1 else int(ends[a])
        part = values[data[base:top]]
        part *= _powers(PRIME, len(part))
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part, out=total[1:])
        s, e = starts[a:b] - base, ends[a:b] - base
        h = (total[e] - total[s]) * _powers(INVERSE, int(s.max()) + 1)[s]
        out[a:b] = mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        a = b
    return out


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, text numbers and hashes (A-Z as a-z) of the words of all texts."""
    starts, ends = runs_of(WORD_BYTES[data], off)
    owner = np.searchsorted(off, starts, side="right") - 1
    return starts, ends, owner, slice_hashes(data, starts, ends, BYTE_LOWER)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` words in a row, whatever text they stand in."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, size):
        h = h * np.uint64(PRIME) + words[j : j + n]
    return mix(h + np.uint64(size))


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the bitmap."""
    low = h & np.uint64(BITS - 1)
    return (bits.view(np.uint64)[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1
