"""Merkle manifests, piece encoding and conversation repair."""

from __future__ import annotations

import heapq
import itertools
import os
import random
import re
import sys
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pyspark.sql.functions as F
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from brute import sha  # noqa: E402

from tests.conftest import SAMPLE  # noqa: E402
from tideline.llm import queries  # noqa: E402
from tideline.llm.merkle import leaf, manifest, proof  # noqa: E402
from tideline.llm.piece_merges import Vocabulary, encoded  # noqa: E402
from tideline.llm.repair import BLOCK, best, codes, digests, repaired, span  # noqa: E402


def plain_tree(leaves: list[str], arity: int) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + arity])) for k in range(0, len(levels[-1]), arity)])
    return levels


def plain_manifest(rows, arity):
    """(id, leaf, subroot, root, proof, folded) of (id, name, leaf, claim)."""
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: plain_tree([r[2] for r in groups[n]], arity) for n in names}
    top = plain_tree([trees[n][-1][0] for n in names], arity)
    for j, n in enumerate(names):
        for i, (key, _, own, claim) in enumerate(groups[n]):
            siblings, h = "", claim
            for tree, k in ((trees[n], i), (top, j)):
                for level in tree[:-1]:
                    run, slot = level[k // arity * arity :][:arity], k % arity
                    siblings += "".join(run[:slot] + run[slot + 1 :])
                    h = sha("".join(run[:slot]) + h + "".join(run[slot + 1 :]))
                    k //= arity
            yield key, own, trees[n][-1][0], top[-1][0], sha(siblings), h


@pytest.mark.parametrize("arity, n, names", [(8, 150, ["a", "é", None, "", "B"]), (2, 40, list("abcdefghijk")), (3, 1, ["x"])])
def test_manifest_is_that_of_a_plain_tree(spark, arity, n, names):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(n)]), rng.choice(names), sha(str(rng.randrange(n)))) for _ in range(n)]
    rows = [(i, g, h, h if int(h, 16) % 2 else sha(h)) for i, g, h in rows + rows[:3]]
    df = spark.createDataFrame(rows, "id long, name string, leaf string, claim string")
    found = manifest(df, arity).select("id", "leaf", "subroot", "root", proof(F.col("path")), "folded").collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, found), key=key) == sorted(plain_manifest(rows, arity), key=key)
    assert sum(r["folded"] == r["root"] for r in found) == sum(h == c for _, _, h, c in rows)


def test_manifest_finds_changed_rows(spark):
    rows = [(k, "g", sha(f"{k}"), sha(f"{k}" if k % 5 else f"{k}!")) for k in range(100)]
    found = manifest(spark.createDataFrame(rows, "id long, name string, leaf string, claim string")).collect()
    assert {r["id"] for r in found if r["folded"] != r["root"]} == {k for k in range(100) if not k % 5}


def test_manifest_of_nothing(spark):
    assert manifest(spark.createDataFrame([], "id long, name string, leaf string, claim string")).collect() == []


def test_fields_cannot_run_into_each_other(spark):
    rows = [("ab", "c"), ("a", "bc"), (None, "-"), ("-", None), ("", None), ("é", "1:")]
    found = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(leaf(F.col("a"), F.col("b"))).collect()]
    assert len(set(found)) == len(rows) and found[-1] == sha("2:é2:1:") and found[2] == sha("-1:-")


def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


ODD = ["", "\n", " ", "  ", "▁", " ▁ x", "a\n\nb", "</s><s><unk> <0x0A>", "\0a", "é é 😀", "aaaa" * 300, " " * 50 + "x" + " " * 33, "日本語梦想", "﻿ a b　c", "\r\n\t", "ab" * 200]


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model())
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("aeiou tnshr\n▁.,é梦😀0x<>", k=rng.randint(1, 80))) for _ in range(2000)] + ["word " * 600_000, "x" * 300_000]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, None, 2), (3, ODD[3], 3)], "doc_id long, text string, ids long")
    found = encoded(docs, model()).collect()
    assert len(found) == len(texts) + 2 and all(r["agrees"] for r in found)
    for r in found:
        text = "" if r["id"] is None else texts[r["id"]]
        ids = library.encode(text, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == library.decode(ids) and r["n_bytes"] == len(text.encode())
    assert encoded(docs.limit(0), model()).collect() == []


def test_a_wrong_merge_is_seen():
    import sentencepiece

    vocabulary = Vocabulary(open(model(), "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=model())
    assert vocabulary.encode(["the thing", ""], library)[1] == [True, True]
    changed = Vocabulary(open(model(), "rb").read())
    changed.ranks[:-1] = changed.ranks[:-1].max() - changed.ranks[:-1]
    assert vocabulary.encode(["the thing"])[1] == [None] and changed.encode(["the tokenizers", ""], library)[1] == [False, True]


def test_decoding_any_ids_is_the_librarys():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model())
    vocabulary = Vocabulary(open(model(), "rb").read())
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(259) for _ in range(rng.randint(0, 12))]
        assert vocabulary.decode(ids) == library.decode(ids)


def test_both_agendas_agree():
    vocabulary = Vocabulary(open(model(), "rb").read())
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choices("etaoinshrdluéß梦😀.", k=rng.randint(0, 40))) for _ in range(3000)]
    assert vocabulary.merged(words) == [vocabulary._agenda(w) for w in words]


def test_other_vocabularies_are_refused():
    whole = open(model(), "rb").read()
    with pytest.raises(ValueError, match="merges"):
        Vocabulary(whole.replace(b"\x18\x02", b"\x18\x01"))


LEGAL = re.compile(r"(s?(ua)+)?")


def plain_best(symbols: str):
    """Cheapest (cost, audit) over the states of the pattern, edit by edit."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(symbols) and state in ("", "a"):
            return cost, audit
        for r in "ua":
            if (state, r) in after:
                heapq.heappush(heap, (cost + 3, audit + "I", at, r))
        if at < len(symbols):
            s = symbols[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if s not in "bd":
                extra = 3 if s.isupper() else 0
                for r in "sua":
                    if (state, r) in after and s.lower() == r:
                        heapq.heappush(heap, (cost + extra, audit + "K", at + 1, r))
                    if (state, r) in after and r != "s":
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", at + 1, r))
    raise AssertionError


def textbook(symbols: str):
    """The same grammar with every span and every cut."""
    from tideline.llm.repair import _joined, _row

    @lru_cache(None)
    def cell(i, j):
        out = dict(_row(symbols[i])) if j == i + 1 else {}
        for k in range(i + 1, j):
            for kind, way in _joined(cell(i, k), cell(k, j)).items():
                out[kind] = min(out.get(kind, way), way)
        return out

    return cell(0, len(symbols))


def test_cells_are_the_cheapest_edits():
    short = ["".join(x) for n in range(1, 4) for x in itertools.product("suaxSUAXbd", repeat=n)]
    rng = random.Random(4)
    for symbols in short + ["".join(rng.choices("suaxUAbdua", k=rng.randint(4, 40))) for _ in range(300)]:
        assert best(span(symbols)) == plain_best(symbols), symbols
    for _ in range(40):
        symbols = "".join(rng.choices("suaxUAbdua", k=rng.randint(2, 14)))
        assert span(symbols) == textbook(symbols)


def test_edits_give_a_legal_conversation():
    rng = random.Random(5)
    for _ in range(300):
        symbols = "".join(rng.choices("suaxUAbd", k=rng.randint(1, 30)))
        letters, at = codes(best(span(symbols))[1])
        roles = "".join({"k": symbols[i].lower(), "d": ""}.get(chr(c), chr(c).lower()) for c, i in zip(letters, at, strict=True))
        assert LEGAL.fullmatch(roles) and (np.diff(at) >= 0).all() and sum(chr(c).islower() for c in letters) == len(symbols)


ROWS = "conv_id long, turn long, role string, text string, g string"


def plain_repair(rows):
    """Totals and turns of one conversation's (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), bytes.fromhex(sha(r[2]))))
    symbols, counts, seen = "", dict.fromkeys(("blank", "duplicate", "truncated"), 0), set()
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbols += {"blank": "b", "duplicate": "d", "truncated": initial.upper()}.get(fault, initial)
    cost, audit = plain_best(symbols) if rows else (0, "")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    letters, at = codes(audit) if rows else ([], [])
    names = {"u": "user", "a": "assistant"}
    out = []
    for c, i in zip(map(chr, letters), at, strict=True):
        if c != "d":
            out.append((rows[i][1] if c == "k" else names[c.lower()], "" if c.isupper() else rows[i][2]))
    return (gaps, *counts.values(), illegal, cost, audit), out


def test_repair_of_odd_conversations(spark):
    rng = random.Random(6)
    texts = ["Hi.", "So?", "cut", " \t\n", "", None, "x.\x0b\f\r ", "ends with f", "é!"]
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(rng.randint(1, 9)):
            row = (conv, rng.choice([None, 0, 1, 2, 5, 7]), rng.choice(["system", "user", "assistant", "", None, "tool", "User"]), rng.choice(texts))
            rows += [row] * rng.choice([1, 1, 1, 2])
    # Longer than a block, with a hot text, and a very long text.
    rows += [(99, k // 3, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"{k}.", "cut"])) for k in range(3 * BLOCK + 17)]
    rows += [(100, 0, "user", "long " * 400_000 + "."), (100, 1, "assistant", "ok.")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], ROWS)
    only = spark.createDataFrame([(7777, 1, "user", "gone", "")] * 2, ROWS)
    turns = repaired(df, ids=df.unionByName(only)).cache()
    totals = {r["g"]: r for r in digests(turns).collect()}
    said = {}
    for r in turns.where("place is not null").orderBy("g", "place").collect():
        said.setdefault(r["g"], []).append((r["role"], r["text"]))
    for conv in {r[0] for r in rows}:
        want, lines = plain_repair([r[1:] for r in rows if r[0] == conv])
        got = totals.pop("" if conv is None else f"={conv}")
        assert tuple(got)[1:-1] == want and got["sha256"] == sha("\n".join(f"{r}:{t}" for r, t in lines))
        assert said.get(got["g"], []) == lines
    assert [tuple(r)[1:] for r in totals.values()] == [(0, 0, 0, 0, 0, 0, "", sha(""))]
    assert digests(repaired(df.limit(0))).collect() == []
    turns.unpersist()


def test_damage_is_by_checksum(spark):
    rows = [(c, t, "assistant", f"a. b! {c} {t}?", "") for c in range(30) for t in [None, *range(4)]] + [(None, 1, None, None, "")]
    want = []
    for c, t, role, text, _ in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text or " ")}.get(fate, text or " ")
        want += [(c, t, "user" if fate == 4 else role or " ", text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert sorted(map(tuple, queries.damaged(spark.createDataFrame(rows, ROWS)).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["op11_merkle", "op13_repair"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SAMPLE}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SAMPLE)
    want = con.execute(queries.ORACLE[name])
    columns = sorted(df.columns)
    assert sorted(c[0] for c in want.description) == columns
    names = [c[0] for c in want.description]
    expected = [tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in want.fetchall()]
    assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted(expected, key=repr)


def test_pieces_query(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=model())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}
    found = queries.op12_pieces(spark, SAMPLE).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert tuple(r) == (r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), True)
