"""Secrets in texts: three fixed patterns, and a battery of randomness tests for other tokens.

Built-in functions only. The patterns give the base spans. Any other token of at least
``SHORTEST`` characters from the base-64 alphabets is a candidate: its encoding (hexadecimal,
base 32, 62 or 64) is inferred, and its symbols are tested for

* uniform use of the alphabet (chi-squared over up to 16 cells),
* the number of runs above and below the middle of the alphabet,
* serial correlation of neighbouring symbols.

A token that fails the joint test (``RANDOM_LEVEL``) is not random. One that passes must also
be unlike ordinary names. Under the null hypothesis it is text of one of the ``STYLES``: a chain
of letter cases, digits and signs, whose letters have the frequencies of text and alternate
between vowels and consonants. The likelihood ratio of the uniform law over its alphabet to the
likeliest style weighs the same things as the battery (use of symbols, runs, neighbours and
class changes) against text, and by Markov's inequality its inverse is a p-value, which falls
with its length. Within each length band of the corpus, the Benjamini-Hochberg rule holds the
share of false discoveries to ``FALSE_DISCOVERIES``. Its thresholds come from a histogram of
p-values, so nothing is sorted or gathered but some hundred counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"  # as runs are taken whole, the same as dropping shorter ones
KINDS = ("assign", "access", "hex", "random")

SHORTEST = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
BANDS = (32, 64, 128)
FALSE_DISCOVERIES = 0.01
RANDOM_LEVEL = 0.001
STEPS = 4  # bins of the histogram to a halving of p
LAST_BIN = 400
CHUNK = 64

HEX_SYMBOLS = "0123456789abcdef"
BASE32_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

#: Letters a to z per thousand of European text; what text holds is common knowledge, not fitted to any table.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (82, 18, 34, 42, 118, 20, 20, 36, 76, 5, 10, 42, 28, 70, 68, 24, 4, 66, 66, 80, 34, 13, 14, 5, 16, 6), strict=True))
VOWELS = "aeiouy"
#: Styles of ordinary names: chances of lower case, upper case, digit, sign after each of these and at the start.
STYLES = {
    "words": ((0.88, 0.03, 0.02, 0.07), (0.60, 0.30, 0.04, 0.06), (0.05, 0.04, 0.80, 0.11), (0.70, 0.12, 0.15, 0.03), (0.60, 0.25, 0.10, 0.05)),
    "capitals": ((0.60, 0.25, 0.05, 0.10), (0.03, 0.85, 0.04, 0.08), (0.04, 0.10, 0.75, 0.11), (0.05, 0.75, 0.15, 0.05), (0.05, 0.80, 0.10, 0.05)),
    "codes": ((0.65, 0.12, 0.13, 0.10), (0.12, 0.65, 0.13, 0.10), (0.12, 0.13, 0.65, 0.10), (0.30, 0.30, 0.30, 0.10), (0.30, 0.30, 0.30, 0.10)),
}
VOWEL_AFTER = (0.25, 0.50)  # a vowel, a consonant
STATES = 6  # lower vowel and consonant, upper vowel and consonant, digit, sign; one more for the start


def _text_law() -> tuple[list[int], list[float], list[list[float]]]:
    """Of each base-64 symbol its state and the bits of its share in the state; of each style the bits of each pair of states."""
    total = sum(LETTERS.values())
    vowels = sum(LETTERS[c] for c in VOWELS) / total
    state, share = [], []
    for c in BASE64_SYMBOLS:
        low = c.lower()
        if low in LETTERS:
            vowel = low in VOWELS
            state.append(2 * c.isupper() + (not vowel))
            share.append(math.log2(LETTERS[low] / total / (vowels if vowel else 1 - vowels)))
        else:
            state.append(4 if c.isdigit() else 5)
            share.append(math.log2(0.1 if c.isdigit() else 0.5))
    pairs = []
    for chances in STYLES.values():
        bits = []
        for before in range(STATES + 1):
            for after in range(STATES):
                p = chances[(0, 0, 1, 1, 2, 3, 4)[before]][(0, 0, 1, 1, 2, 3)[after]]
                if after < 4:
                    vowel = VOWEL_AFTER[before % 2] if before < 4 else vowels
                    p *= 1 - vowel if after % 2 else vowel
                bits.append(math.log2(p))
        pairs.append(bits)
    return state, share, pairs


STATE_OF, SHARE_BITS, PAIR_BITS = _text_law()


def _running(steps: Column, begin: Column) -> Column:
    """What stands before each step: ``begin``, and the sum of the steps ahead of it."""
    zero = F.struct(begin.alias("total"), F.array().cast("array<bigint>").alias("out"))
    add = lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["out"], F.array(a["total"])).alias("out"))
    return F.aggregate(steps, zero, add, lambda a: a["out"])


def _offsets(steps: Column) -> Column:
    """Running sums over a long array, in chunks: appending one by one is quadratic."""
    zero = F.lit(0).cast("bigint")
    at = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(at, lambda c: F.aggregate(F.slice(steps, c, CHUNK), zero, lambda a, x: a + x))
    return F.flatten(F.zip_with(at, _running(sums, zero), lambda c, o: _running(F.slice(steps, c, CHUNK), o)))


def _located(df: DataFrame, name: str, pattern: str, kind: int, group: int | None = None, least: int = 0) -> DataFrame:
    """Adds ``name``: start, kind, end and text of each leftmost match that is long enough."""
    text = F.col("text")
    none = F.array().cast("array<string>")
    found = F.col("_hit")
    df = df.withColumn("_hit", text.rlike(pattern))
    df = df.withColumn("_hits", F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_gaps", F.when(found, F.split(text, pattern, -1)).otherwise(none))
    size = F.col("_hits") if group is None else F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)
    df = df.withColumn("_sizes", F.transform(size, lambda x: F.length(x)))
    gap = F.transform(F.slice("_gaps", F.lit(1), F.size("_hits")), lambda g: F.length(g).cast("bigint"))
    df = df.withColumn("_gap", gap)
    df = df.withColumn("_before", _offsets(F.zip_with("_gap", "_hits", lambda g, h: g + F.length(h))))
    pairs = F.arrays_zip(F.col("_before").alias("b"), F.col("_gap").alias("g"), F.col("_hits").alias("h"), F.col("_sizes").alias("n"))
    span = lambda p: F.struct(
        (p["b"] + p["g"]).alias("start"),
        F.lit(kind).alias("kind"),
        (p["b"] + p["g"] + F.length(p["h"])).alias("end"),
        p["h"].alias("s"),
    )
    df = df.withColumn(name, F.transform(F.filter(pairs, lambda p: p["n"] >= least), span))
    return df.drop("_hit", "_hits", "_gaps", "_sizes", "_gap", "_before")


def _upper_tail(z: Column) -> Column:
    """Of the normal law, to about four digits."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565616 * z * z * z))


def _encoded(s: Column) -> Column:
    """Alphabet and its size."""
    as_ = lambda text, k: F.struct(F.lit(text).alias("symbols"), F.lit(k).alias("k"))
    return (
        F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), as_(HEX_SYMBOLS, 16))
        .when(s.rlike("^[A-Z2-7]+$"), as_(BASE32_SYMBOLS, 32))
        .when(s.rlike("^[A-Za-z0-9]+$"), as_(BASE64_SYMBOLS, 62))
        .otherwise(as_(BASE64_SYMBOLS, 64))
    )


def _tested(c: Column) -> Column:
    """Start, end, length band and two p-values of a candidate."""
    coded = F.transform(F.array(c), lambda x: F.struct(x.alias("c"), _encoded(x["s"]).alias("e")))
    fold = lambda x: F.when(x["e"]["k"] == 16, F.lower(x["c"]["s"])).otherwise(F.translate(x["c"]["s"], "-_", "+/"))
    chars = lambda x: F.filter(F.split(fold(x), ""), lambda y: y != "")
    with_chars = F.transform(coded, lambda x: F.struct(x["c"].alias("c"), x["e"].alias("e"), chars(x).alias("chars")))
    values = F.transform(
        with_chars,
        lambda x: F.struct(
            x["c"].alias("c"),
            x["e"].alias("e"),
            F.transform(x["chars"], lambda y: F.instr(x["e"]["symbols"], y) - 1).alias("v"),
            F.transform(x["chars"], lambda y: F.instr(F.lit(BASE64_SYMBOLS), y)).alias("u"),
            F.size(x["chars"]).alias("n"),
        ),
    )
    pairs = lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda t, y: t + f(y))

    def measure(x: Column) -> Column:
        n, k = x["n"].cast("double"), x["e"]["k"].cast("double")
        cells = F.greatest(F.lit(2), F.least(F.lit(16), F.floor(n / 5).cast("int")))
        share = lambda i: (F.ceil((i + 1) * k / cells) - F.ceil(i * k / cells)) / k
        count = lambda i: F.size(F.filter(x["v"], lambda v: F.floor(v * cells / k) == i))
        chi = total(F.sequence(F.lit(0), cells - 1), lambda i: F.pow(count(i) - n * share(i), F.lit(2.0)) / (n * share(i)))
        free = (cells - 1).cast("double")
        spread = 2 / (9 * free)
        z_chi = (F.pow(chi / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        changes = total(pairs(x["v"]), lambda y: ((y["p"] * 2 >= k) != (y["q"] * 2 >= k)).cast("double"))
        z_runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        middle = (k - 1) / 2
        z_serial = total(pairs(x["v"]), lambda y: (y["p"] - middle) * (y["q"] - middle)) / (F.sqrt(n - 1) * (k * k - 1) / 12)
        joint = F.pow(F.greatest(z_chi, F.lit(0.0)), F.lit(2.0)) + z_runs * z_runs + z_serial * z_serial
        z_joint = (F.pow(joint / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / math.sqrt(2 / 27)
        states = F.transform(x["u"], lambda u: F.element_at(F.lit(STATE_OF), u))
        before = F.concat(F.array(F.lit(STATES)), F.slice(states, F.lit(1), F.size(states) - 1))
        steps = F.zip_with(before, states, lambda p, q: p * STATES + q + 1)
        likeliest = F.greatest(*(total(steps, lambda y, b=b: F.element_at(F.lit(b), y)) for b in PAIR_BITS))
        text_bits = likeliest + total(x["u"], lambda u: F.element_at(F.lit(SHARE_BITS), u))
        bits = F.greatest(-n * F.log2(k) - text_bits, F.lit(0.0))
        band = sum(((x["n"] >= b).cast("int") for b in BANDS), F.lit(0))
        return F.struct(
            x["c"]["start"].alias("start"),
            x["c"]["end"].alias("end"),
            band.alias("band"),
            F.least(F.floor(bits * STEPS + 1e-6), F.lit(LAST_BIN)).cast("int").alias("bin"),
            (_upper_tail(z_joint) >= RANDOM_LEVEL).alias("random"),
        )

    return F.transform(values, measure)[0]


def _scanned(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Base spans, and the tested candidates that touch none of them, of every row."""
    df = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    df = _located(df, "assign", ASSIGN, 0, group=2, least=6)
    df = _located(df, "access", ACCESS, 1, least=20)
    df = _located(df, "hex", HEX, 2, least=24)
    df = _located(df, "other", CANDIDATE, 3, least=SHORTEST)
    df = df.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    free = F.filter("other", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    df = df.withColumn("free", free).select("id", "assign", "access", "hex", "base", "free")
    return df.withColumn("tested", F.transform("free", _tested)).drop("free")


def thresholds(scanned: DataFrame) -> dict[int, int]:
    """For each length band the least bin that counts as found, by Benjamini and Hochberg."""
    # An inner explode would have the optimizer ask for non-empty arrays at the scan, and spell the whole test out twice.
    each = scanned.select(F.explode_outer("tested").alias("t")).where("t is not null")
    bins = each.groupBy(F.col("t.band").alias("band"), F.col("t.bin").alias("bin")).agg(F.count("*").alias("n"))
    counts: dict[int, dict[int, int]] = {}
    for row in bins.collect():  # bands times bins at most
        counts.setdefault(row["band"], {})[row["bin"]] = row["n"]
    least = {}
    for band, by_bin in counts.items():
        reached = 0
        for step in sorted(by_bin, reverse=True):
            reached += by_bin[step]
            if sum(by_bin.values()) * 2.0 ** (-step / STEPS) <= FALSE_DISCOVERIES * reached:
                least[band] = step
    return least


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``id``, ``assign``, ``access``, ``hex``, ``random``, ``base``, ``spans``.

    The four kinds are arrays of (start, kind, end) in code points, end exclusive; ``base`` and
    ``spans`` list ``kind:start:end`` by start, then kind. Null texts count as empty and have no
    spans; null or repeated ids and further columns change nothing, as each row is judged by
    itself and by the thresholds of the whole table. An empty table gives no rows.
    """
    scanned = _scanned(docs, id_column, text)
    least = thresholds(scanned)
    limit = F.array(*(F.lit(least.get(band, LAST_BIN + 1)) for band in range(len(BANDS) + 1)))
    span = lambda s, kind: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"))
    found = F.filter("tested", lambda t: t["random"] & (t["bin"] >= limit[t["band"]]))
    df = scanned.withColumn("random", F.transform(found, lambda t: span(t, F.lit(3))))
    for kind in ("assign", "access", "hex", "base"):
        df = df.withColumn(kind, F.transform(kind, lambda s: span(s, s["kind"])))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    df = df.withColumn("spans", listed(F.array_sort(F.concat("base", "random"))))
    return df.withColumn("base", listed(F.col("base"))).select("id", "assign", "access", "hex", "random", "base", "spans")
