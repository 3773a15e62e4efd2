"""The registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.decontaminate import contained
from tideline.llm.frames import table
from tideline.llm.html_blocks import extract
from tideline.llm.line_windows import dedupe_lines
from tideline.llm.lsh_forest import near_duplicates
from tideline.llm.merkle import leaf, manifest, proof
from tideline.llm.mixing import mix
from tideline.llm.nn_descent import nearest
from tideline.llm.piece_merges import encoded
from tideline.llm.prefix_free import remove_repeats
from tideline.llm.quality import held_out, scored, train
from tideline.llm.repair import digests, repaired
from tideline.llm.secrets import secret_spans
from tideline.llm.sql import OP11_SQL, OP13_SQL, UPPER
from tideline.llm.token_counts import token_counts

TOKEN_LIMIT = 4096


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in a mix of sources by weight."""
    mixed = mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
        F.col("_rate").alias("rate"),
    )


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left without 50-byte strings of earlier documents."""
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, top=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document left after repeated three-line windows are gone."""
    left = dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP5_SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS a FROM documents
), w AS (
  SELECT doc_id, p, array_to_string(a[p:p + 2], chr(10)) AS s FROM (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS p FROM d)
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w WHERE NOT regexp_full_match(s, '[ \t\n\f\r]*')
), gone AS (
  SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS q FROM ranked WHERE k > 1
), tally AS (
  SELECT g.doc_id, count(*) AS n_removed, count(*) FILTER (WHERE b.q IS NULL) AS n_spans
  FROM gone g LEFT JOIN gone b ON b.doc_id = g.doc_id AND b.q = g.q - 1 GROUP BY g.doc_id
), lines AS (
  SELECT doc_id, unnest(range(1, len(a) + 1)) AS q, unnest(a) AS line FROM d
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.q) AS t
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.q = l.q WHERE g.q IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, len(a)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN tally USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document among its near copies."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of benchmark items in every document."""
    found = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    trees = train(docs, table(spark, sf_dir, "labels"))
    score = F.col("_score")
    return scored(docs, trees, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 32k piece vocabulary."""
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: three patterns and random-looking tokens."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    size = lambda kind: F.size(kind).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *map(size, ("assign", "access", "hex", "random")), F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in a Merkle tree by language, a third of them tampered with."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own, other = leaf(*fields, F.col("text")), leaf(*fields, F.translate("text", UPPER, UPPER.lower()))
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, other).otherwise(own)
    proved = manifest(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("name"), own.alias("leaf"), claim.alias("claim")))
    return proved.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        proof(F.col("path")).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the 32k piece vocabulary and the text they decode to."""
    import public_tokenizers

    found = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by a checksum of id and turn; nulls are one space there."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate, text = F.crc32(name) % 20, F.coalesce("text", space)
    return conversations.where(fate != 0).select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after planted damage."""
    conversations = table(spark, sf_dir, "conversations")
    found = digests(repaired(damaged(conversations), ids=conversations))
    conv_id = F.expr("CAST(nullif(substr(g, 2), '') AS long)").alias("conv_id")
    totals = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return found.select(conv_id, *totals, F.col("sha256").alias("repaired_sha256"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_mixing": op2_mixing,
    "op3_repeats": op3_repeats,
    "op4_nearest": op4_nearest,
    "op5_line_windows": op5_line_windows,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle": op11_merkle,
    "op12_pieces": op12_pieces,
    "op13_repair": op13_repair,
}
ORACLE: dict[str, str] = {"op5_line_windows": OP5_SQL, "op11_merkle": OP11_SQL, "op13_repair": OP13_SQL}
