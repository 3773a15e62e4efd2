"""Main text of web pages by shallow features of flat text blocks.

A page is cut into blocks at block-level tags. Each block is described by its word count and
link density, those of the blocks before and after it, and the containers around it (article,
boilerplate). A decision tree, grown by Gini impurity on the labelled table ``LABELLED``, tells
content from the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.frames import fresh

# Fixed sets of HTML element names.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
HIDDEN = frozenset("head svg math button select datalist object canvas audio video dialog".split())
HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())  # what leaves the head open
BOILER = frozenset("nav footer aside form menu search".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words in class, id or role that mark a container as something beside the article.
HINT = re.compile(
    r"(?:^|[^a-z])(?:ads?|adsense|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|menu|nav|navbar|navigation|breadcrumbs?|"
    r"sidebar|side-?bar|widgets?|complementary|contentinfo|cookies?|notice|notification|alert|consent|gdpr|disclaimer|newsletter|"
    r"subscribe|signup|sign-?up|login|paywall|share|sharing|social|related|recommend(?:ed|ations)?|comments?|commentlist|respond|reply|"
    r"replies|disqus|popup|pop-?up|modal|overlay|pagination|pager|tags|copyright|footer|skip-?link|toolbar|search)(?:$|[^a-z])"
)
#: Such words that only count outside an article, where they may be part of it.
OUTSIDE = re.compile(r"(?:^|[^a-z])(?:header|masthead|topbar|top-?bar|site-?info)(?:$|[^a-z])")
BODY_HINT = re.compile(r"(?:^|[^a-z])(?:article|article-?body|post-?(?:body|content)|entry-?content|story-?body|main)(?:$|[^a-z])")
#: Words that tell what a container has beside or in it: has-sidebar, post-with-comments. They never mark the container itself.
HAVING = re.compile(r"(?<![a-z0-9-])(?:[a-z0-9-]*-)?(?:has|with|without|no)-[a-z0-9-]+")
#: Words that tell the layout or topic of an article that bears them (sidebar-left, nav-open, tag-search), but may name another container.
LAYOUT = re.compile(
    r"(?<![a-z0-9-])(?:(?:category|tag|format|topic)-[a-z0-9-]+|[a-z0-9-]+-(?:left|right|open|opened|closed|collapsed|expanded|enabled|disabled|on|off))(?![a-z0-9-])"
)

RAW_END = {name: re.compile("</" + name, re.I | re.A) for name in RAW}
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|hidden|aria-hidden|aria-label)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

FEATURES = (
    "words", "link_density", "words_before", "density_before", "words_after", "density_after", "article", "boiler", "heading", "page_has_article",
)

#: Blocks labelled by hand: ``FEATURES``, then 1 for content.
LABELLED = (
    # in an article
    (8, 0.0, 3, 1.0, 40, 0.0, 1, 0, 1, 1, 1), (55, 0.0, 8, 0.0, 61, 0.05, 1, 0, 0, 1, 1), (1, 0.0, 55, 0.0, 70, 0.0, 1, 0, 0, 1, 1),
    (120, 0.1, 40, 0.0, 9, 0.0, 1, 0, 0, 1, 1), (2, 0.0, 2, 0.0, 1, 0.0, 1, 0, 0, 1, 1), (12, 0.5, 80, 0.0, 33, 0.0, 1, 0, 0, 1, 1),
    (4, 1.0, 60, 0.0, 45, 0.1, 1, 0, 0, 1, 1), (3, 0.0, 90, 0.0, 12, 0.3, 1, 0, 0, 1, 1), (25, 0.2, 4, 0.0, 6, 1.0, 1, 0, 0, 1, 1),
    (5, 0.0, 120, 0.0, 50, 0.0, 1, 0, 1, 1, 1), (300, 0.02, 6, 0.0, 2, 1.0, 1, 0, 0, 1, 1), (1, 1.0, 1, 1.0, 30, 0.0, 1, 0, 0, 1, 1),
    # beside it, in a marked container, on pages with an article
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1, 0), (2, 1.0, 1, 1.0, 8, 0.0, 0, 1, 0, 1, 0), (14, 0.0, 2, 1.0, 8, 0.0, 0, 1, 0, 1, 0),
    (22, 0.0, 50, 0.0, 0, 0.0, 0, 1, 0, 1, 0), (60, 0.0, 35, 0.0, 40, 0.0, 1, 1, 0, 1, 0), (35, 0.1, 120, 0.0, 9, 0.5, 1, 1, 0, 1, 0),
    (6, 0.0, 80, 0.0, 20, 0.0, 1, 1, 1, 1, 0), (3, 1.0, 60, 0.0, 3, 1.0, 1, 1, 0, 1, 0), (150, 0.0, 12, 0.0, 14, 0.0, 0, 1, 0, 1, 0),
    (9, 0.3, 4, 1.0, 55, 0.0, 0, 1, 1, 1, 0), (40, 0.0, 6, 0.0, 6, 0.0, 1, 1, 0, 1, 0), (1, 0.0, 60, 0.0, 60, 0.0, 1, 1, 0, 1, 0),
    # beside it, unmarked, on pages with an article
    (4, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 1, 0), (7, 0.0, 1, 1.0, 60, 0.0, 0, 0, 0, 1, 0), (18, 0.0, 3, 1.0, 9, 0.0, 0, 0, 0, 1, 0),
    (30, 0.4, 70, 0.0, 5, 1.0, 0, 0, 0, 1, 0), (11, 0.0, 90, 0.0, 0, 0.0, 0, 0, 1, 1, 0), (45, 0.0, 2, 1.0, 12, 0.0, 0, 0, 0, 1, 0),
    (60, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 1, 0), (33, 0.1, 25, 0.0, 44, 0.0, 0, 0, 0, 1, 0), (80, 0.0, 60, 0.0, 30, 0.0, 0, 0, 0, 1, 0),
    (15, 0.0, 45, 0.0, 62, 0.0, 0, 0, 0, 1, 0), (52, 0.0, 9, 0.0, 38, 0.0, 0, 0, 0, 1, 0), (4, 0.0, 60, 0.0, 55, 0.0, 0, 0, 0, 1, 0),
    (24, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0, 1, 0), (110, 0.05, 30, 0.0, 25, 0.0, 0, 0, 0, 1, 0), (20, 0.0, 33, 0.0, 41, 0.1, 0, 0, 0, 1, 0),
    # marked, on pages without an article
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0, 0), (16, 0.0, 3, 1.0, 60, 0.0, 0, 1, 0, 0, 0), (48, 0.0, 70, 0.0, 6, 0.0, 0, 1, 0, 0, 0),
    (5, 0.0, 60, 0.0, 44, 0.0, 0, 1, 1, 0, 0), (90, 0.0, 5, 0.0, 3, 1.0, 0, 1, 0, 0, 0), (8, 0.0, 66, 0.0, 0, 0.0, 0, 1, 0, 0, 0),
    # unmarked, on pages without an article: density decides
    (40, 0.0, 6, 0.0, 55, 0.0, 0, 0, 0, 0, 1), (75, 0.05, 40, 0.0, 62, 0.1, 0, 0, 0, 0, 1), (22, 0.1, 80, 0.0, 30, 0.0, 0, 0, 0, 0, 1),
    (130, 0.2, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 1), (17, 0.0, 2, 1.0, 44, 0.0, 0, 0, 0, 0, 1), (12, 0.0, 50, 0.0, 66, 0.0, 0, 0, 0, 0, 1),
    (4, 0.0, 60, 0.0, 58, 0.0, 0, 0, 0, 0, 1), (7, 0.0, 2, 1.0, 70, 0.0, 0, 0, 1, 0, 1), (3, 0.0, 44, 0.0, 30, 0.0, 0, 0, 1, 0, 1),
    (28, 0.3, 33, 0.0, 41, 0.0, 0, 0, 0, 0, 1), (35, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (1, 0.0, 75, 0.0, 64, 0.0, 0, 0, 0, 0, 1),
    (9, 0.0, 38, 0.1, 52, 0.0, 0, 0, 0, 0, 1), (50, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 12, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (5, 1.0, 60, 0.0, 4, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0, 0),
    (1, 1.0, 50, 0.0, 70, 0.0, 0, 0, 0, 0, 0), (6, 0.8, 3, 1.0, 40, 0.0, 0, 0, 0, 0, 0), (25, 0.9, 60, 0.0, 30, 0.8, 0, 0, 0, 0, 0),
    (40, 0.7, 2, 1.0, 5, 1.0, 0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 0.0, 0, 0, 0, 0, 0), (6, 0.0, 5, 0.5, 0, 0.0, 0, 0, 0, 0, 0),
    (8, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0), (7, 0.5, 40, 0.0, 2, 1.0, 0, 0, 0, 0, 0),
    (3, 0.3, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (4, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (5, 0.2, 55, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (2, 0.0, 90, 0.0, 4, 1.0, 0, 0, 0, 0, 0), (12, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (14, 0.0, 100, 0.0, 40, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 120, 0.0, 80, 0.0, 0, 0, 0, 0, 1),
)


def grow_tree(rows: tuple = LABELLED) -> tuple:
    """Nested (feature, threshold, left, right); a leaf is 0 or 1. Ties go to the first feature and least threshold."""
    ones = sum(r[-1] for r in rows)
    if ones in (0, len(rows)):
        return int(ones > 0)
    gini = lambda part: sum(x[-1] for x in part) * (1 - sum(x[-1] for x in part) / len(part))
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            left = [r for r in rows if r[f] <= cut]
            right = [r for r in rows if r[f] > cut]
            loss = gini(left) + gini(right)
            if best is None or loss < best[0] - 1e-12:
                best = (loss, f, cut, left, right)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut, left, right = best
    return f, cut, grow_tree(left), grow_tree(right)


def is_content(tree, features: tuple) -> bool:
    while not isinstance(tree, int):
        f, cut, left, right = tree
        tree = left if features[f] <= cut else right
    return tree == 1


def _own_marks(name: str, marks: str) -> tuple[bool, str]:
    """Whether an element with these marks may be the article, and those that speak of the element itself."""
    marks = HAVING.sub(" ", marks)
    rest = LAYOUT.sub(lambda m: " " if HINT.search(m[0]) or OUTSIDE.search(m[0]) else m[0], marks)
    if name == "main":
        return True, ""
    if name == "article" or name not in ("body", "html") and BODY_HINT.search(rest):
        return True, rest
    return False, marks


def blocks(html: str) -> list[tuple]:
    """Text, words, link words, in an article, in boilerplate, heading: of each block that isn't blank."""
    found: list[tuple] = []
    parts: list[str] = []
    linked: list[str] = []
    # Open containers: name, in an article, in boilerplate, hidden.
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    link = heading = False

    def close_block() -> None:
        nonlocal parts, linked
        if parts:
            words = unescape("".join(parts)).split()
            if words:
                _, article, boiler, _ = stack[-1]
                found.append((" ".join(words), len(words), len(unescape(" ".join(linked)).split()), article, boiler, heading))
            parts, linked = [], []

    def leave_head() -> None:
        while len(stack) > 1 and stack[-1][0] == "head":
            stack.pop()

    def take(text: str) -> None:
        if stack[-1][0] == "head" and text.strip():
            leave_head()
        if text and not stack[-1][3]:
            parts.append(text)
            if link:
                linked.append(text)

    at, end = 0, len(html)
    search = TOKEN.search
    while at < end:
        m = search(html, at)
        if m is None:
            take(html[at:])
            break
        take(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        closing = m[1] == "/"
        if not closing and name not in HEAD:
            leave_head()
        if name in RAW and not closing:
            stop = RAW_END[name].search(html, at)
            at = end if stop is None else stop.start()
            continue
        if name == "a":
            link = not closing
            continue
        if name == "br":
            take(" ")
            continue
        block = name in BLOCK
        if not block and name not in HIDDEN:
            if name in ("td", "th", "option", "label", "img", "input"):
                take(" ")
            continue
        if block:
            close_block()
            link = link and closing
        if name in HEADING:
            heading = not closing
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if stack[-1][0] == "p" and block or name == "li" and stack[-1][0] == "li":
            stack.pop()
        if name in VOID or m[3].endswith("/") and name in HIDDEN:
            continue
        _, article, boiler, hidden = stack[-1]
        marks = ""
        if m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hidden = True
                elif key in ("class", "id", "role"):
                    marks += " " + re.sub(r"[\s_]+", "-", value.strip()) if key != "class" else " " + value.replace("_", "-")
        candidate, marks = _own_marks(name, marks) if marks else (name in ("article", "main"), marks)
        if name in HIDDEN:
            hidden = True
        elif name in BOILER:
            boiler = True
        elif name in ("body", "html"):
            pass
        elif marks and HINT.search(marks):
            boiler = True
        elif not article and (name == "header" or marks and OUTSIDE.search(marks)):
            # A page's own header; what an article in it holds is still the article's.
            boiler = True
        if candidate:
            if not boiler or not article and stack[-1][2] and not any(x[0] in BOILER for x in stack) and not HINT.search(marks):
                article, boiler = True, False
        stack.append((name, article, boiler, hidden))
    close_block()
    return found


def main_text(html: str, tree) -> tuple[str, int]:
    """Content blocks joined by line feeds, and how many blocks the page has."""
    found = blocks(html)
    density = [b[2] / b[1] for b in found]
    has_article = any(b[3] and not b[4] for b in found)
    kept = []
    for i, (text, words, _, article, boiler, heading) in enumerate(found):
        before = (found[i - 1][1], density[i - 1]) if i else (0, 0.0)
        after = (found[i + 1][1], density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        if is_content(tree, (words, density[i], *before, *after, int(article), int(boiler), int(heading), int(has_article))):
            kept.append(text)
    return "\n".join(kept), len(found)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every column of ``pages`` but ``html``, then ``text``, ``n_chars`` and ``n_blocks``; one row for each row.

    Null or blank pages, and pages without content, give an empty text. Columns of those three
    names in ``pages`` are replaced. Pages are judged one by one: repeats and null keys don't matter.
    """
    tree = grow_tree()
    rest = [(c, kind) for c, kind in pages.dtypes if c not in (html, "text", "n_chars", "n_blocks")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(x, tree) if x else ("", 0) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array([t for t, _ in made], pa.string()),
                    pa.array([len(t) for t, _ in made], pa.int64()),
                    pa.array([n for _, n in made], pa.int64()),
                ],
                [*batch.schema.names[1:], "text", "n_chars", "n_blocks"],
            )

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in rest), "text string", "n_chars long", "n_blocks long"])
    return pages.select(F.col(html).cast("string").alias(fresh(pages, "_html")[0]), *(F.col(f"`{c}`") for c, _ in rest)).mapInArrow(run, schema)
