"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, jaccard_join, language_id, license_scan, line_dedup, mixing, quality_cnn, quality_rules, substring_dedup
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text of documents by a network learned from labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_cnn.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole text of documents, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs).drop("text"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of sources 5 : 2 : 1 takes of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that the canonical digests of documents and of their lines name."""
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that an earlier document has, found by chains of seeds."""
    return substring_dedup.passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its text, markup and address."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(pages, docs).select("page_id", "language", "probability", "text_language", "declared")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of robust outlier detection for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by the Jaccard similarity of their 5-word shingles."""
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line repeats within one word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_removed", "emptied", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of embeddings at cosine 0.9."""
    return embedding_dedup.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Query]:
    return {"op1_quality_classifier": op1_quality_classifier, "op2_bpe_round_trip": op2_bpe_round_trip, "op3_mix_sources": op3_mix_sources, "op4_license_scan": op4_license_scan, "op5_substring_dedup": op5_substring_dedup, "op8_language_id": op8_language_id, "op6_quality_rules": op6_quality_rules, "op7_jaccard_join": op7_jaccard_join, "op9_line_dedup": op9_line_dedup, "op10_embedding_dedup": op10_embedding_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": license_scan.sql(), "op7_jaccard_join": jaccard_join.sql(), "op9_line_dedup": line_dedup.sql(), "op10_embedding_dedup": embedding_dedup.sql()}
