"""The corpus pipeline: five stages from raw documents to token ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that
the stage before kept. ``run`` writes every stage's result to the shared folder
and reads it again, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embercast.llm import bpe, minhash, mixing, quality_model, suffix_dedup
from embercast.llm.arrays import written
from embercast.llm.queries import BYTE_RANKS, MIX_SEED, MIX_WEIGHTS, held_out
from embercast.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least an even chance of label 1.

    Null and empty texts are scored as one chunk of padding and kept or not by that score; repeated rows share a
    fate; rows without an id are scored too, but never learned from. With no labels, or an empty table, all
    documents get about the same score. Columns stay as they are, also one that is called ``score``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    net = quality_model.train(docs.select("doc_id", "text"), labels)
    return quality_model.score(docs, net, out="_score").where("_score >= 0.5").drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 and more): the one
    with the smallest doc_id; of repeated rows one.

    Null and empty texts, and those without words, are nobody's duplicate and stay; so do rows without an id (once
    for each text). Ties can't occur, as ids order a group. An empty table stays empty; other columns stay."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80)
    kept = written(found.where("kept").select(F.col("doc_id").alias("_kept")), "kept-ids")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi").dropDuplicates(["doc_id", "text"])


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that stand earlier; cut characters go too. No row is dropped.

    Null texts stay null and empty ones empty; of repeated rows the later ones lose their text. n_chars is counted
    again; an empty table stays empty; other columns stay."""
    found = suffix_dedup.remove_repeats(docs, window=100, as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a document stands as often as it was drawn.

    A null source, or one without a weight, passes once. Null texts count no characters. Repeated rows are drawn
    alike; an empty table stays empty; columns stay as they are."""
    return mixing.mix(docs, MIX_WEIGHTS, MIX_SEED).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digest of the text that they decode to.

    Null and empty texts have no ids; rows without an id stay, repeated rows give equal rows, an empty table stays
    empty. Of the other columns only ``source`` is kept."""
    ids = bpe.encode(docs.select("doc_id", "source", "text"), BYTE_RANKS, public_tokenizers.PATTERN)
    both = bpe.decode(ids.drop("text"), BYTE_RANKS, public_tokenizers.PATTERN)
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("mixture", mixture),
    ("token ids", token_ids),
]

#: Learned scores, sketches and token ids have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
