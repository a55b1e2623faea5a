"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embercast.llm import bpe, centroids, edit_counts, lexical, minhash, mixing, packing, phrases, quality_model, quality_rules, suffix_dedup, token_files, topk
from embercast.llm import oracles
from embercast.llm.arrays import work_folder
from embercast.session import table

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE, WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json"), 49_408


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_folder(spark, "token-files")
    manifest = token_files.write(docs, folder, WORD_BPE, end_id=1, vocabulary=WORD_VOCABULARY)
    return token_files.digests(spark, manifest, folder)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_RANKS, public_tokenizers.PATTERN)
    both = bpe.decode(ids.select("doc_id", "ids"), BYTE_RANKS, public_tokenizers.PATTERN)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars",
    )


#: Every source the same share of the characters; the seed of the draws.
MIX_WEIGHTS, MIX_SEED = {f"src{i}": 1.0 for i in range(20)}, 17


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SEED)


OP4_SQL = """
WITH have AS (
    SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS n FROM documents
    WHERE source IN (SELECT 'src' || i FROM range(20) t(i)) GROUP BY source HAVING sum(length(coalesce(text, ''))) > 0
), rates AS (
    SELECT source, 1.0 / (SELECT count(*) FROM have)::DOUBLE * (SELECT sum(n) FROM have) / n AS rate FROM have
), steps AS (
    SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS step
    FROM rates, range(200) t(k)
), drawn AS (
    SELECT d.*, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM documents d
), counted AS (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(s.step) AS n
    FROM drawn d JOIN steps s ON s.source = d.source AND s.step <= d.u GROUP BY ALL
    UNION ALL
    SELECT doc_id, text, lang, source, n_chars, 1 FROM documents
    WHERE source IS NULL OR source NOT IN (SELECT 'src' || i FROM range(20) t(i))
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy FROM counted, range(1, 50) t(copy) WHERE copy <= n
"""


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after personal data are taken out of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = edit_counts.count(docs, BYTE_RANKS, public_tokenizers.PATTERN)
    counted = edit_counts.private_edits(counted.withColumn("tokens_before", F.col("n_tokens")))
    return edit_counts.recount(counted, BYTE_RANKS, public_tokenizers.PATTERN).select(
        "doc_id", "tokens_before", F.size("edits").cast("long").alias("n_edits"), F.col("n_tokens").alias("tokens_after"),
        F.length("text").cast("long").alias("chars_after"), "reencoded_chars",
    )


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def op8_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    net = quality_model.train(docs, labels.where(~held_out()))
    return quality_model.score(docs, net).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, step=50, scale=256.0)


OP9_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.place, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.place <> c.place AND len(q.x) = len(c.x)
)
SELECT query_id, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) <= 5
"""


def op10_fast_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return phrases.remove_phrases(docs, window=13).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, window=100).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=1, context=2048)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group",
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, scale=256.0, seed="2")[0]


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_rules": op3_line_rules,
    "op4_poisson_mix": op4_poisson_mix,
    "op5_edit_counts": op5_edit_counts,
    "op6_phrase_automata": op6_phrase_automata,
    "op7_induced_suffixes": op7_induced_suffixes,
    "op8_quality_net": op8_quality_net,
    "op9_top_k": op9_top_k,
    "op10_fast_sketch": op10_fast_sketch,
    "op11_packing": op11_packing,
    "op12_centroids": op12_centroids,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE = {
    "op3_line_rules": oracles.OP3,
    "op4_poisson_mix": OP4_SQL,
    "op6_phrase_automata": oracles.OP6,
    "op9_top_k": OP9_SQL,
    "op10_fast_sketch": oracles.OP10,
    "op12_centroids": oracles.op12(clusters=40, rounds=5),
    "op13_ranked_search": oracles.OP13,
}
