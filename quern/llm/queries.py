"""Queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, embdedup, langid, linededup, mixing, packing, pii, quality, simhash, toxicity
from quern.llm.common import held_out, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(4, 2))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicated(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copies", "replica", "shuffle_key")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "removed_lines", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxicity").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.with_language(table(spark, sf_dir, "documents"), ~held_out(4, 2))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_pii,
        op3_mixing,
        op4_simhash,
        op5_nearest,
        op6_line_dedup,
        op7_embedding_dedup,
        op8_packing,
        op9_toxicity,
        op10_language_id,
    )
}
ORACLES = {"op3_mixing": mixing.ORACLE, "op6_line_dedup": linededup.ORACLE, "op7_embedding_dedup": embdedup.ORACLE}
