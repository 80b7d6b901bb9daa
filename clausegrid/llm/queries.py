"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausegrid.llm import backoff, bpe, codes, divergence, language, licenses, merges, mixing, quality, simhash, sketches, suffixes, topk

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of all documents without their long repeated strings."""
    return suffixes.removal_digests(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importance weight of all documents, and which are drawn."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backoff score of all documents under the counts of all documents."""
    return backoff.rounded_scores(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places and labels of all documents."""
    return licenses.license_labels(_table(spark, sf_dir, "documents"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in a mixture of the sources by tempered weights."""
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and how alike they are."""
    return sketches.fingerprints(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of all documents."""
    return language.predicted(_table(spark, sf_dir, "documents"))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents, encoded and decoded."""
    return bpe.token_digests(_table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best neighbours of every hundredth vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_bpe_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents by the merges of a tokenizer file."""
    return merges.token_digests(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all vectors and how far they are off."""
    return codes.compressed(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ in their words."""
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    """One query for each operator."""
    found = (
        op1_suffix_array_dedup,
        op2_quality_classifier,
        op3_lm_scoring,
        op4_license_scan,
        op5_mixing_sources,
        op6_document_fingerprints,
        op7_language_id,
        op8_byte_level_bpe,
        op9_exact_top_k,
        op10_simhash_near_dedup,
        op11_bpe_merge_rounds,
        op12_vector_codes,
        op13_source_divergence,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "op3_lm_scoring": backoff.SCORES_SQL,
        "op5_mixing_sources": mixing.MIXTURE_SQL,
        "op9_exact_top_k": topk.TOP_K_SQL,
        "op12_vector_codes": codes.CODES_SQL,
        "op13_source_divergence": divergence.DIVERGENCE_SQL,
    }
