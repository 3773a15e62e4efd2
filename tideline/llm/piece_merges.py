"""Encoding and decoding with merge-type piece vocabularies.

A text's characters are symbols; an agenda holds the adjacent pairs whose joint string is a piece,
best score first and, of equal ones, leftmost first. The best pair becomes one symbol, the pairs with
its new neighbours join the agenda, and what has been overtaken falls out when its turn comes. Symbols
that are no piece fall back to their bytes.

No symbol ever grows over two characters that no piece holds side by side. Such are, in the
vocabularies taken here, the end of a word with the space before the next, and a line feed with anything.
So a text is cut into words, and long words further, agendas stay short however long a text is, and
words are remembered within a task, up to a fixed number. The words that are new in an Arrow batch
are held against the sentencepiece library, all in one call: ``agrees``.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bytework import sliced
from tideline.llm.frames import text_column

SPACE = "▁"
WORDS = 1 << 18
LONG_WORD = 64
WORD = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2
SCHEMA = "id long, n_bytes long, ids array<int>, decoded string, agrees boolean"


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and raw values of the fields of a serialised message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, message[at : at + size]
        at += size


def _by_library(library, words: list[str]) -> list[bytes]:
    """The library's ids of each word; behind a line feed, which stands for itself, no space is added."""
    lead = len(library.encode("\n"))
    return [array("i", ids[lead:]).tobytes() for ids in library.encode(["\n" + w for w in words], num_threads=1)] if words else []


class Vocabulary:
    """What encoding needs of a model file; refuses files of which it could not give the library's result."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        settings = {2: {}, 3: {}}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number in settings:
                settings[number] = dict(_fields(value))
        training, normalizer = settings[2], settings[3]
        if training.get(3) != MERGES or not training.get(35):
            raise ValueError("the vocabulary isn't one of merges with byte fallback")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1) or training.get(24):
            raise ValueError("the model changes texts before it cuts them")
        if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in self.pieces):
            raise ValueError("the vocabulary has unused or user-defined pieces")
        self.end = training.get(42, 2)
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.byte_ids = [0] * 256
        for i, (piece, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
        # Equal scores share a rank: between them the place in the text decides.
        ranks = {score: rank for rank, score in enumerate(sorted({s for _, s, kind in self.pieces if kind == NORMAL}, reverse=True))}
        self.rank = {piece: ranks[self.pieces[i][1]] for piece, i in self.ids.items()}
        self._pair_tables()
        self.neighbours = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        self.silent = {i for i, (_, _, kind) in enumerate(self.pieces) if kind == CONTROL}
        self.surface = [self._surface(piece, kind) for piece, _, kind in self.pieces]
        if any("\n" in pair or (pair[0] != SPACE and pair[1] == SPACE) for pair in self.neighbours):
            raise ValueError("a piece goes on behind a line feed or into the next word")
        # Two generations of words: those asked for again move to the younger one.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, piece.replace(SPACE, " ").encode())

    def encode(self, texts: list[str], library=None) -> tuple[list[bytes], list[bool | None]]:
        """Ids of each text as 32-bit numbers in a row, without an end, and whether the library agrees on all its words."""
        found = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = set().union(*found)
        here = {w: ids for w in words if (ids := self.known.get(w) or self.older.get(w))}
        news = [w for w in words if w not in here]
        here.update(zip(news, self.merged(news), strict=True))
        wrong = {w for w, ids in zip(news, _by_library(library, news), strict=True) if ids != here[w]} if library else set()
        if len(self.known) >= WORDS:
            self.older, self.known = self.known, {}
        self.known.update((w, ids) for w, ids in here.items() if len(w) <= LONG_WORD and w not in wrong)
        agrees = [wrong.isdisjoint(f) if wrong else True for f in found] if library else [None] * len(found)
        return [b"".join(map(here.__getitem__, f)) for f in found], agrees

    def _pair_tables(self) -> None:
        """Pairs of symbols whose joint string is a piece: sorted keys, ranks and what they become; the last row stands for no pair."""
        size = self.unknown = len(self.pieces)
        met = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                if (a := self.ids.get(piece[:k])) is not None and (b := self.ids.get(piece[k:])) is not None:
                    met[a * (size + 1) + b] = (self.rank[piece], i)
        self.keys = np.array([*sorted(met), 1 << 62], np.int64)
        self.ranks = np.array([*[met[k][0] for k in sorted(met)], size], np.int64)
        self.joint = np.array([*[met[k][1] for k in sorted(met)], size], np.int32)
        self.letters = np.full(0x110000, size, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = i

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rows of the pair tables."""
        key = left.astype(np.int64) * (self.unknown + 1) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of each word as 32-bit numbers in a row.

        The agendas of all short words run side by side: in each round every word merges the pair that
        its agenda has on top. Long ones are cut and have an agenda of their own.
        """
        out: list[bytes] = [b""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
        for k, ids in zip(short, self._side_by_side([words[k] for k in short]), strict=True):
            out[k] = ids
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                edges = [0, *[j for j in range(1, len(w)) if w[j - 1 : j + 1] not in self.neighbours], len(w)]
                out[k] = b"".join([self._agenda(w[a:b]) for a, b in pairwise(edges)])
        return out

    def _side_by_side(self, words: list[str]) -> Iterator[bytes]:
        if not words:
            return
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol, place = self.letters[chars], np.arange(len(chars))
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.arange(len(words))
        none = len(self.keys) - 1
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pair = np.full(len(chars), none)
        pair[:-1] = self._pairs(symbol[:-1], symbol[1:])
        pair[np.cumsum(size) - 1] = none
        while len(word):
            start = np.cumsum(size) - size
            n = len(symbol)
            # The best rank and, of equal ones, the leftmost place.
            top = np.minimum.reduceat(self.ranks[pair] * n + np.arange(n), start)
            goes = top < self.ranks[none] * n
            if not goes.all():
                left = np.repeat(~goes, size)
                done.append((np.repeat(word[~goes], size[~goes]), symbol[left], place[left]))
            stays = np.repeat(goes, size)
            at = top[goes] % n
            symbol[at] = self.joint[pair[at]]
            stays[at + 1] = False
            # The pair that began with the absorbed symbol is now the merged one's with its right neighbour.
            pair[at] = pair[at + 1]
            now = np.cumsum(stays) - 1
            symbol, place, pair = symbol[stays], place[stays], pair[stays]
            word, size = word[goes], size[goes] - 1
            at = now[at]
            first = np.cumsum(size) - size
            ends = first + size - 1
            right = at[at < ends]
            pair[right] = self._pairs(symbol[right], symbol[right + 1])
            pair[at[at == ends]] = none
            before = at[at > first] - 1
            pair[before] = self._pairs(symbol[before], symbol[before + 1])
        owner, symbol, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        owner, symbol, place = owner[order], symbol[order], place[order]
        # Characters that are no piece fall back to their bytes.
        lost = np.flatnonzero(symbol == self.unknown)
        if len(lost):
            spelt = [[self.byte_ids[b] for b in chr(c).encode()] for c in chars[place[lost]].tolist()]
            times = np.ones(len(symbol), np.int64)
            times[lost] = [len(x) for x in spelt]
            first = np.cumsum(times) - times
            owner, symbol = np.repeat(owner, times), np.repeat(symbol, times)
            for f, ids in zip(first[lost].tolist(), spelt, strict=True):
                symbol[f : f + len(ids)] = ids
        whole = symbol.astype("<i4").tobytes()
        edges = (np.searchsorted(owner, np.arange(len(words) + 1)) * 4).tolist()
        for a, b in pairwise(edges):
            yield whole[a:b]

    def _agenda(self, word: str) -> bytes:
        """The agenda over one stretch. A symbol is known by where it starts, and ``end`` says where it stops;
        an entry packs rank, start and stop of a pair into a number that sorts like them."""
        n, rank = len(word), self.rank.get
        bits = n.bit_length()
        mask, shift = (1 << bits) - 1, 2 * bits
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r << shift) | (k << bits) | (k + 2) for k in range(n - 1) if (r := rank(word[k : k + 2])) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left, stop = (entry >> bits) & mask, entry & mask
            right = end[left]
            if right < 0 or right >= stop or end[right] != stop:
                continue
            end[left], end[right] = stop, -1
            if stop < n:
                before[stop] = left
                after = end[stop]
                if (r := rank(word[left:after])) is not None:
                    heappush(agenda, (r << shift) | (left << bits) | after)
            if left:
                start = before[left]
                if (r := rank(word[start:stop])) is not None:
                    heappush(agenda, (r << shift) | (start << bits) | stop)
        ids, at = array("i"), 0
        while at < n:
            symbol = word[at : end[at]]
            at = end[at]
            if (i := self.ids.get(symbol)) is None:
                ids.extend([self.byte_ids[b] for b in symbol.encode()])
            else:
                ids.append(i)
        return ids.tobytes()

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: the space that opens it goes, control ids are silent, broken bytes show as such."""
        start, opens, out = 0, True, []
        for at in [k for k, i in enumerate(ids) if i in self.silent] + [len(ids)]:
            if start < at:
                out.append(self._spell(ids[start:at], opens))
                opens = False
            start = at + 1
        return "".join(out)

    def _spell(self, ids: list[int], opens: bool) -> str:
        """Text of ids without a silent one; such a one would part bytes that together are a character."""
        surface = self.surface
        whole = b"".join([surface[i] for i in ids])
        if opens and ids and self.pieces[ids[0]][2] == NORMAL and whole.startswith(b" "):
            whole = whole[1:]
        try:
            return whole.decode()
        except UnicodeDecodeError:
            return "".join(_readable(whole))


def _readable(whole: bytes) -> Iterator[str]:
    """A replacement character for each byte that belongs to no character."""
    at = 0
    while at < len(whole):
        try:
            yield whole[at:].decode()
            return
        except UnicodeDecodeError as e:
            yield whole[at : at + e.start].decode() + "�"
            at += e.start + 1


def encoded(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """A row for each row of ``docs``: ``id``, ``n_bytes``, ``ids`` with the end id, ``decoded`` and ``agrees``.

    Null texts count as empty: the end id alone, decoded to the empty text. Whole texts are read,
    repeated rows and null ids are rows like any other, further columns are not read, and strings that
    look like special pieces are text. ``agrees`` tells whether the library has the same ids for all
    words of the text, null without ``check``. ``model`` is read on the driver and sent along; a vocabulary that changes
    texts first, has user-defined or unused pieces, pieces over the ends of words or no byte fallback is refused.
    """
    with open(model, "rb") as f:
        proto = f.read()
    Vocabulary(proto)
    shipped = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shipped.value)
        end = np.array([vocabulary.end], "<i4").tobytes()
        library = None
        if check:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_proto=shipped.value)
        for batch in sliced(batches, "text"):
            found, agrees = vocabulary.encode(batch.column("text").to_pylist(), library)
            rows = [np.frombuffer(ids + end, "<i4") for ids in found]
            decoded = [vocabulary.decode(row.tolist()) for row in rows]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), ids, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())],
                ["id", "n_bytes", "ids", "decoded", "agrees"],
            )

    whole = text_column(text)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, SCHEMA)
