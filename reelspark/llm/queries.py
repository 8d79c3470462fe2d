"""The registered queries of this subpackage: every operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, mixing, oracles, phrases, quality, secrets, simhash, substrings, token_counts, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), at_least=0.5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), at_least=0.3)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), least=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal target weights for all sources, as many rows in all as there are."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word 3-shingles, 64 bits, radius 2: eight blocks, of which six agree, leave at most 2**16 codes to a group."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, words=1, radius=2, masks=simhash.block_masks(2, 8))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("code")[0])), 16, "0").alias("fingerprint"), "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and the benchmark item that it holds."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.remove_repeats(table(spark, sf_dir, "documents"), span=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = token_counts.DEFAULT_VOCABULARY) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.read_vocabulary(vocabulary))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_suffix_dedup, op4_embedding_dedup, op5_mixing, op6_simhash, op7_decontaminate, op8_phrase_dedup, op9_secrets, op10_token_counts)}
ORACLES = oracles.ORACLES
