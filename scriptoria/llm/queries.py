"""The queries of this subpackage and their SQL. A query gets its rows through its operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, drift_clusters, exact_dedup, filter_audit, langid, mixing, near_dedup, pair_bpe, pii, secrets, suffix_tree_lm, toxicity
from .common import parquet

Query = Callable[[SparkSession, str], DataFrame]


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in a mixture of sources by the root of their sizes."""
    return mixing.schedule_rows(parquet(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of rows that aren't held out."""
    return toxicity.score_documents(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.near_duplicates(parquet(spark, sf_dir, "documents")).drop("row_key")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes for every document."""
    import public_tokenizers

    return bpe.token_digests(parquet(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth embedding."""
    return ann.nearest(parquet(spark, sf_dir, "embeddings"))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and suffix-tree scores of every document."""
    return suffix_tree_lm.score_documents(parquet(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts of every document."""
    return exact_dedup.exact_classes(parquet(spark, sf_dir, "documents")).drop("row_key")


def op8_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms that disclose it."""
    return pii.span_digests(parquet(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that aren't held out."""
    return langid.predict_languages(parquet(spark, sf_dir, "documents"))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate for a secret in the documents, judged by the forest."""
    return secrets.classify(parquet(spark, sf_dir, "documents"))


def op11_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts for every document."""
    import public_tokenizers

    return pair_bpe.token_digests(parquet(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes at each step of each order, by language."""
    return filter_audit.audit(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op13_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every embedding."""
    return drift_clusters.clustered(parquet(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_pfair_mixing, op2_toxicity, op3_dart_minhash, op4_byte_bpe, op5_additive_quantisation, op6_suffix_tree_lm, op7_exact_dedup, op8_pii_sanitise, op9_language_id, op10_secret_forest, op11_pair_index_bpe, op12_filter_audit, op13_drift_clusters)}

#: The columns of op6 that SQL can express are held against it in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t""",
    "op12_filter_audit": filter_audit.AUDIT_SQL,
    "op13_drift_clusters": drift_clusters.clusters_sql(),
}
