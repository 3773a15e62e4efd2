"""Operators on one text at a time: pages, quality, token counts, secrets."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import pyspark.sql.functions as F
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tideline.llm.html_blocks import blocks, extract, grow_tree, main_text  # noqa: E402
from tideline.llm.quality import Trees, grow, held_out, scored, statistics, train  # noqa: E402
from tideline.llm.secrets import secret_spans  # noqa: E402
from tideline.llm.token_counts import count_pieces, load, pre_tokens, token_counts  # noqa: E402

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div id="main"><article>
<header><h1>Title it&#39;s</h1></header><p class=lead>First  para with <a href="/x" title=it's>a link</a> and &eacute;&nbsp;x.<p>Second<br>line
<div class="ad-box"><p>Buy now</p></div><blockquote>Quote</blockquote><ul><li>one<li>two</ul><aside>Side</aside>
<section class="comments"><article class="comment"><p>Nice post, I like this one a lot really very much so indeed friend</p></article></section>
<form><label>Name</label><input></form><p>Last</article></div><div class="sidebar"><p>Long text in a sidebar which goes on for many words</p></div>
<div class="cookie-notice">We use cookies</div><!-- x <p>hidden</p> --><script>if(a<b){"</p>"}</script><footer>F</footer>"""


def test_article_without_what_surrounds_it():
    text, _ = main_text(PAGE, grow_tree())
    assert text.split("\n") == ["Title it's", "First para with a link and é x.", "Second line", "Quote", "one", "two", "Last"]


def test_density_decides_without_an_article():
    body = "<body><div class=menu><a>a</a> <a>b</a></div><h2>Heading here</h2><p>" + "word " * 40 + "</p><p>short one</p><p>" + "more " * 50
    text, _ = main_text(body + "</p><div>© <a>x y z</a></div>", grow_tree())
    assert [len(x.split()) for x in text.split("\n")] == [2, 40, 2, 50]


@pytest.mark.parametrize("html", ["", "  ", "<", "<p", "<!-- open", "<p>x<script>y", "<a b='>", "</p></p>", "<p>" * 3000, "&#0;&bogus;&#xFFFFFFFF;"])
def test_odd_pages_do_not_crash(html):
    assert isinstance(main_text(html, grow_tree())[0], str)


@pytest.mark.parametrize(
    "start, whole",
    [
        ('<main class="content with-sidebar">', True), ('<article class="post has-related">', True), ('<div class="entry-content has-sidebar">', True),
        ('<div class="container has-sidebar"><div class="text">', True), ('<article class="post sidebar-left nav-open">', True),
        ('<div class="entry-content sidebar-right">', True), ('<main class="search">', True), ('<article class="post tag-search no-comments">', True),
        ('<article class="has-header">', True), ('<div class="sidebar-left">', False), ('<div class="main-sidebar-left">', False),
        ('<div class="has-main-nav related">', False), ('<article class="comment">', False), ('<div class="main-navigation">', False),
    ],
)
def test_layout_words_do_not_mark_the_article(start, whole):
    text, _ = main_text(f"<html><body>{start}<p>{'word ' * 40}</p><p>{'more ' * 30}</p>", grow_tree())
    assert len(text.split()) == (70 if whole else 0)


@pytest.mark.parametrize(
    "start",
    [
        "<body>\u0130<SCRIPT>x</SCRIPT>", "<body>\u0130<STYLE>x</STYLE>", "<head><title>\u0130</TITLE></head><body>", "<head><title>T</title>",
        "<head><meta charset=x><link rel=y><script>z</script>", "<head><title>T</title><a name=top></a>", "<head><title>T</title>Bare text",
    ],
)
def test_the_rest_of_a_page_is_kept(start):
    text, _ = main_text(f"<html>{start}<p>{'word ' * 40}</p><p>{'more ' * 30}</p>", grow_tree())
    assert text.split("\n")[-2:] == [("word " * 40).strip(), ("more " * 30).strip()]


def test_neighbours_are_described():
    found = blocks("<p>a b <a>c d</a></p><p>e</p>")
    assert [(b[0], b[1], b[2]) for b in found] == [("a b c d", 4, 2), ("e", 1, 0)]


def test_extract_keeps_rows_and_other_columns(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars", "n_blocks"]
    got = brute.ordered(r[:4] for r in out.collect())
    long = main_text(PAGE, grow_tree())[0]
    assert got == brute.ordered([(1, "u", long, len(long))] * 2 + [(None, None, "", 0), (2, "v", "", 0)])
    assert extract(df.limit(0)).collect() == []


def corpus(n=240):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(20, 60))]
        docs.append((i, " ".join(w.upper() + "!!" if bad else w for w in words)))
        labels.append((i, int(not bad)))
    return docs, labels


def test_quality_separates_held_out_documents(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs + [(None, None), (7, docs[7][1]), (9999, "")], "doc_id long, text string")
    y = spark.createDataFrame(labels + [(None, 1), (5, None), (123456, 1)], "doc_id long, quality int")
    trees = train(d, y)
    out = scored(d, trees).withColumn("held", held_out(F.col("doc_id"))).collect()
    assert len(out) == len(docs) + 3
    known = dict(labels)
    wrong = [r for r in out if r.held and r.doc_id in known and (r._score >= 0.5) != bool(known[r.doc_id])]
    assert not wrong and all(0 <= r._score <= 1 for r in out)
    twice = [r._score for r in out if r.doc_id == 7]
    assert len(twice) == 2 and twice[0] == twice[1]
    # Held-out labels teach nothing.
    flipped = y.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = train(d, flipped)
    assert (other.leaf == trees.leaf).all() and (other.threshold == trees.threshold).all()


def test_an_id_with_many_texts_teaches_once(spark, monkeypatch):
    docs, labels = corpus()
    hot = next(i for i, _ in labels if i % 3 and not spark.range(1).select(held_out(F.lit(i))).first()[0])
    d = spark.createDataFrame(docs + [(hot, f"other text {n}") for n in range(500)], "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr("tideline.llm.quality.grow", lambda x, y: seen.append(len(y)) or grow(x, y))
    train(d, y)
    train(d, y, sample=20)
    assert seen[0] <= len(labels) and seen[1] == 20


def test_quality_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r._score for r in scored(d, train(d, none)).collect()} == {0.5}
    assert scored(d.limit(0), train(d.limit(0), none)).collect() == []


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(0)
    x = rng.random((500, 4)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    trees = grow(x, y)
    assert (((trees.scores(x) >= 0.5) == y).mean()) > 0.95

    def walk(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.scores(x[:20]), [walk(r) for r in x[:20]])
    assert isinstance(grow(x[:0], y[:0]), Trees)


def test_statistics_do_not_leak_between_texts():
    import pyarrow as pa

    texts = ["abc def\nabc def", "", "É!! X*** 12", "w " * 5000, "no"]
    together = statistics(pa.array(texts))
    assert np.allclose(together, np.concatenate([statistics(pa.array([t])) for t in texts]))


TOKEN_TEXTS = [None, "", " ", "\n", "a\n\n b  \n", "▁a ▁ <s>é\u0000b\t日本語 \r\n x", "a" * 5000, "  lead", " \n \n", "ﬁx ① 😀", "x　y z", "tr ​"]


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [(i, t) for i, t in enumerate(TOKEN_TEXTS)] + [(4, TOKEN_TEXTS[4]), (4, "other"), (None, "hi there")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pre", "2 as n")
    got = brute.ordered(token_counts(df, model).collect())
    assert got == brute.ordered((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows)
    assert token_counts(df.limit(0), model).collect() == []


def test_pre_tokens_join_to_the_text():
    import public_tokenizers

    processor = load(public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice(" \n▁aeé.<s>\t0日") for _ in range(rnd.randint(0, 30)))
        found = pre_tokens(text)
        assert "".join(found) == (" " + text if text else "")
        assert sum(count_pieces(processor, found)) == len(processor.encode(text)), repr(text)


def test_secrets_match_the_patterns(spark):
    rnd = random.Random(1)
    key = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48))
    texts = [
        None, "", 'é😀 api_key: "abcdefgh" AKIA' + "A" * 20, "token=ab secret=token: abcdefgh", "PassWord = 'x.y=z-1'", "AKIAAKIA" + "B" * 11,
        "deadbeef" * 3, "deadbeef" * 2, "token=abcdef " * 500, "a" * 5000, f"see {key} here", "some-long-hyphenated-name_of_a_thing/path/to/it",
        "ſecret=abcdefgh", "toKen=abcdefg",
    ]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[4])]
    out = secret_spans(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()
    assert brute.ordered((r.id, r.base) for r in out) == brute.ordered((i, brute.secrets(t)) for i, t in rows)
    by = {r.id: r for r in out}
    assert by[10].spans == f"random:4:{4 + len(key)}" and by[11].spans == ""
    assert all(r.spans == r.base for r in out if r.id != 10)
    assert secret_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_random_tokens_are_found_amid_many_names(spark):
    rnd = random.Random(7)
    syllables = "ka lo mi ter son ver ing sta tion pre fix list map name user data get set load file path time zone type open read code item".split()

    def name(n):
        mark, out = rnd.choice(["_", "-", "/", "", None]), ""
        while len(out) < n:
            word = "".join(rnd.choices(syllables, k=rnd.randint(1, 3)))
            out += word.capitalize() if mark is None else word + mark
            out += str(rnd.randint(0, 99)) if rnd.random() < 0.1 else ""
        return out[:n]

    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    kinds = {"base62": base64[:62], "base32": base64[:26] + "234567", "base64": base64}
    rows = [(f"{kind} {n}", "".join(rnd.choices(symbols, k=n))) for kind, symbols in kinds.items() for n in (20, 32, 48, 64) for _ in range(12)]
    rows += [("name", name(rnd.choice((20, 24, 32, 48, 64)))) for _ in range(2856)]  # one in 21 is random
    found = [r.id for r in secret_spans(spark.createDataFrame(rows, "doc_id string, text string").repartition(8)).where("size(random) > 0").select("id").collect()]
    assert found.count("name") <= 0.01 * len(found)
    for kind in kinds:
        short, long = (sum(x in [f"{kind} {n}" for n in sizes] for x in found) for sizes in ((20,), (32, 48, 64)))
        assert short >= 9 and long >= 33, (kind, short, long)
