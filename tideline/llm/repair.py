"""Least-cost repair of conversations by weighted CYK interval parsing.

A conversation is well formed when it is empty or the initials of its roles read ``s?(ua)+``. The
grammar is in Chomsky normal form. A nonterminal tells the first and the last initial of what a span
of rows yields, or that it yields nothing; ``xy -> xz wy`` holds where ``zw`` may stand side by side,
and a span that yields nothing adds to any other. Terminals are the edits of one row: keep, give
another role, delete. Insertions yield without a row: single-row cells are closed over them on both
sides, and with them all longer spans.

A cell holds the cheapest (cost, audit) of each nonterminal over its span. Audits of one span and
equal cost never begin one another, so the best parts make the best whole. Since a nonterminal
says all that a neighbour asks, a span may be cut anywhere with the same cell: one cut does where
textbooks try each. Spans combine bottom-up, their length doubling: inside blocks of rows in one
task, beyond them by joining neighbouring blocks.

Rows are put in order without a task that holds a conversation, and are only streamed, in order, when
the edits are applied: no step keeps the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.frames import stored
from tideline.llm.ordering import numbered

ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Yields of a whole conversation; "" is nothing.
WHOLE = ("", "ua", "sa")
KINDS = ("", "ss", "su", "sa", "uu", "ua", "au", "aa")
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLOCK = 256
SHORT = 16
REMEMBERED = 1 << 14
BLANKS = " \t\n\x0b\f\r"
Cell = dict[str, tuple[int, str]]

STREAM = "g string, place long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _offer(cell: Cell, kind: str, cost: int, audit: str) -> bool:
    if kind in cell and cell[kind] <= (cost, audit):
        return False
    cell[kind] = (cost, audit)
    return True


def _row(symbol: str) -> Cell:
    """Cell of one row, closed over insertions. Symbols are the role's initial (``x`` for others), in
    upper case if the text is cut off; ``b`` and ``d`` are blank and duplicate rows, which must go."""
    cell: Cell = {"": (DELETE, "D")}
    if symbol not in "bd":
        initial, extra = symbol.lower(), CUT_OFF if symbol.isupper() else 0
        if initial in "sua":
            _offer(cell, initial * 2, extra, "K")
        for other in ROLES:
            _offer(cell, other * 2, REROLE + extra, "R")
    news = list(cell)
    while news:
        kind = news.pop()
        cost, audit = cell[kind]
        for other in ROLES:
            if not kind:
                steps = [(other * 2, audit + "I"), (other * 2, "I" + audit)]
            else:
                steps = [(kind[0] + other, audit + "I")] * (kind[1] + other in LEGAL) + [(other + kind[1], "I" + audit)] * (other + kind[0] in LEGAL)
            news += [k for k, a in steps if _offer(cell, k, cost + INSERT, a)]
    return cell


def _joined(left: Cell, right: Cell) -> Cell:
    """Cell of two neighbouring spans."""
    cell: Cell = {}
    for a, (cost, audit) in left.items():
        for b, (more, further) in right.items():
            if not a or not b or a[1] + b[0] in LEGAL:
                kind = a + b if not a or not b else a[0] + b[1]
                if kind not in cell or cost + more <= cell[kind][0]:
                    _offer(cell, kind, cost + more, audit + further)
    return cell


def span(symbols: str, known: dict[str, Cell] | None = None) -> Cell:
    """Cell of a span of rows: single rows, then spans of twice the length, until one is left.

    ``known`` keeps the cells of short spans for the next time, as many as ``REMEMBERED``.
    """
    known = {} if known is None else known
    if symbols in known:
        return known[symbols]
    cells = [known[s] if s in known else known.setdefault(s, _row(s)) for s in symbols]
    while len(cells) > 1:
        cells = [_joined(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    if len(symbols) <= SHORT and len(known) < REMEMBERED:
        known[symbols] = cells[0]
    return cells[0]


def best(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    return min(cell[kind] for kind in WHOLE if kind in cell)


def codes(audit: str) -> tuple[np.ndarray, np.ndarray]:
    """What to do, letter by letter, and at which row: ``U`` and ``A`` insert a role in front of the row
    (behind it after the last), ``k``, ``d``, ``u`` and ``a`` keep, delete or give it a role."""
    letters = np.frombuffer(audit.encode(), np.uint8)
    says = letters != ord("D")
    # What is left ends in "a" and alternates, so that places from the end tell the role.
    user = (np.cumsum(says) - 1 + int(says.sum())) % 2 == 0
    out = np.where(letters == ord("K"), ord("k"), ord("d"))
    out = np.where(letters == ord("R"), np.where(user, ord("u"), ord("a")), out)
    out = np.where(letters == ord("I"), np.where(user, ord("U"), ord("A")), out)
    rows = letters != ord("I")
    at = np.cumsum(rows) - rows
    return out.astype(np.uint8), np.minimum(at, max(int(rows.sum()) - 1, 0))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Cell] = {}
    for batch in batches:
        yield _packed(batch, [span(s, known) for s in batch.column("symbols").to_pylist()])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = []
        for met in batch.column("met").to_pylist():
            parts = [{k: (c, a) for k, c, a in zip(KINDS, m["costs"], m["audits"], strict=True) if c is not None} for m in sorted(met, key=lambda m: m["b"])]
            cells.append(_joined(*parts) if len(parts) > 1 else parts[0])
        yield _packed(batch, cells)


def _packed(batch: pa.RecordBatch, cells: list[Cell]) -> pa.RecordBatch:
    costs = pa.array([[c[k][0] if k in c else None for k in KINDS] for c in cells], pa.list_(pa.int64()))
    audits = pa.array([[c[k][1] if k in c else None for k in KINDS] for c in cells], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("g", "b", "n")], costs, audits], ["g", "b", "n", "costs", "audits"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of each conversation, and its edits cut into those of each block of rows."""
    for batch in batches:
        out: dict[str, list] = {"g": [], "b": [], "codes": [], "cost": [], "audit": []}
        for g, costs, audits in zip(*[batch.column(c).to_pylist() for c in ("g", "costs", "audits")], strict=True):
            cost, audit = best({k: (c, a) for k, c, a in zip(KINDS, costs, audits, strict=True) if c is not None})
            letters, at = codes(audit)
            edges = np.searchsorted(at, np.arange(0, int(at[-1]) + 1 + BLOCK, BLOCK))
            for b, (start, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                for name, value in zip(out, (g, b, letters[start:end].tobytes().decode(), cost if b == 0 else None, audit if b == 0 else None), strict=True):
                    out[name].append(value)
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))


class _Conversation:
    """The state of one conversation while its rows stream by."""

    def __init__(self, g: str):
        self.g, self.place, self.cost, self.audit = g, 0, 0, ""
        self.faults = [0, 0, 0]
        self.illegal = self.turns = 0
        self.initial = self.least = self.last = None
        self.todo: deque[str] = deque()

    def edits(self, row: dict) -> None:
        self.todo.extend(row["codes"])
        self.faults = [a + b for a, b in zip(self.faults, (row["blank"], row["duplicate"], row["truncated"]), strict=True)]
        if row["cost"] is not None:
            self.cost, self.audit = row["cost"], row["audit"]

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last = turn
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        while True:
            code = self.todo.popleft()
            if code != "d":
                yield self._turn(role if code == "k" else ROLES[code.lower()], "" if code.isupper() else text)
            if code.islower():
                return

    def end(self) -> Iterator[tuple]:
        for code in self.todo:
            yield self._turn(ROLES[code.lower()], "")
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        yield (self.g, None, None, None, gaps, *self.faults, self.illegal, self.cost, self.audit)

    def _turn(self, role: str, text: str) -> tuple:
        self.place += 1
        return (self.g, self.place - 1, role, text, *[None] * len(TOTALS))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns in order, then the totals of the conversation; edits stand before their rows."""
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in STREAM.split(", "))])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    now: _Conversation | None = None
    for batch in batches:
        rows: list[tuple] = []
        for row in batch.to_pylist():
            if now is None or now.g != row["g"]:
                rows += now.end() if now else []
                now = _Conversation(row["g"])
            if row["kind"] == 1:
                now.edits(row)
            elif row["kind"] == 2:
                rows += now.row(row["turn"], row["role"], row["text"])
        yield packed(rows)
    if now:
        yield packed(list(now.end()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, first = hashlib.sha256(), True
    for batch in batches:
        shas = []
        for place, role, text in zip(*[batch.column(c).to_pylist() for c in ("place", "role", "text")], strict=True):
            if place is None:
                shas.append(state.hexdigest())
                state, first = hashlib.sha256(), True
            else:
                state.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
        totals = batch.filter(batch.column("place").is_null())
        yield pa.RecordBatch.from_arrays([totals.column("g"), *[totals.column(c) for c in TOTALS], pa.array(shas, pa.string())], ["g", *TOTALS, "sha256"])


def group_key(id_column: str) -> Column:
    """The id as a key that joins: the null id is the empty key, any other one has a mark in front."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_column).cast("string")), F.lit(""))


def repaired(rows: DataFrame, ids: DataFrame | None = None, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns of every conversation and its totals.

    Rows stand by turn, nulls first, then by role and the text's hash, so that repeated rows stand side
    by side. Null roles and texts are one space. A row's first fault counts: blank, duplicate (role and
    text seen before in the conversation), truncated (its last character that isn't white space is no
    ``.``, ``!`` or ``?``). Gives a row for each repaired turn (key ``g``, ``place`` from 0, ``role``,
    ``text``) and, where ``place`` is null, one of totals for each conversation: ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``. A conversation that only ``ids``
    names has totals of zero and an empty audit. All rows of a conversation come from one task, in order,
    with the totals last; it streams them, however many there are. Further columns are not read.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    who = F.coalesce(F.col(role).cast("string"), F.lit(" "))
    full = rows.select(group_key(id_column).alias("g"), F.col(turn).cast("long").alias("turn"), who.alias("role"), said.alias("text"))
    full = full.withColumn("h", F.unhex(F.sha2("text", 256)))

    ends = F.rtrim("text", F.lit(BLANKS))
    blank = ends == ""
    short = full.select("g", "turn", "role", "h", blank.alias("blank"), (~blank & ~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")]
    placed = numbered(stored(short), "g", order)
    # Of equal rows the first is no duplicate: a fold and a join on places, whatever a text's number of copies.
    firsts = placed.groupBy("g", "role", "h").agg(F.min("i").alias("i")).select("g", "i", F.lit(True).alias("first"))
    marked = placed.join(firsts, ["g", "i"], "left").withColumn("duplicate", ~F.col("blank") & F.col("first").isNull())
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("blank"), "b").when(F.col("duplicate"), "d").when(F.col("truncated"), F.upper(initial)).otherwise(initial)
    blocks = stored(
        marked.groupBy("g", F.expr(f"i div {BLOCK}").alias("b"))
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", symbol.alias("s")))), lambda x: x["s"]), "").alias("symbols"),
            F.min_by(F.struct("turn", "role", "h"), "i").alias("head"),
            F.max("n").alias("rows"),
            *[F.count_if(F.col(c)).alias(c) for c in ("blank", "duplicate")],
            F.count_if(F.col("truncated") & ~F.col("duplicate")).alias("truncated"),
        )
        .withColumn("n", F.expr(f"(rows + {BLOCK - 1}) div {BLOCK}"))
    )
    cell = "g string, b long, n long, costs array<long>, audits array<string>"
    level = stored(blocks.select("g", "b", "n", "symbols").mapInArrow(_cells, cell))
    most = blocks.agg(F.max("n")).first()[0] or 0
    whole = level.where("n = 1")
    while most > 1:
        met = level.where("n > 1").groupBy("g", F.expr("b div 2").alias("half")).agg(F.expr("(max(n) + 1) div 2").alias("n"), F.collect_list(F.struct("b", "costs", "audits")).alias("met"))
        level = stored(met.withColumnRenamed("half", "b").mapInArrow(_pairs, cell))
        whole = whole.unionByName(level.where("n = 1"))
        most = -(-most // 2)

    edits = whole.mapInArrow(_chunks, "g string, b long, codes string, cost long, audit string")
    edits = edits.join(blocks.select("g", "b", "head", "blank", "duplicate", "truncated"), ["g", "b"])
    nothing = {"text": "string", "codes": "string", "blank": "long", "duplicate": "long", "truncated": "long", "cost": "long", "audit": "string"}
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in nothing.items()}
    key = ["g", "turn", "role", "h", "kind"]
    parts = full.select("g", "turn", "role", "h", F.lit(2).alias("kind"), "text", *[empty[c] for c in list(nothing)[1:]])
    parts = parts.unionByName(edits.select("g", "head.*", F.lit(1).alias("kind"), empty["text"], *list(nothing)[1:]))
    if ids is not None:
        named = ids.select(group_key(id_column).alias("g")).distinct()
        absent = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("h", "binary"))]
        parts = parts.unionByName(named.select("g", *absent, F.lit(0).alias("kind"), *empty.values()))
    return parts.repartition("g").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in key]).mapInArrow(_applied, STREAM)


def digests(turns: DataFrame) -> DataFrame:
    """Totals of every conversation and ``sha256`` of its turns ``role:text``, a line feed between two; takes what ``repaired`` gives."""
    return turns.mapInArrow(_digests, "g string, " + STREAM.split("text string, ")[1] + ", sha256 string")
