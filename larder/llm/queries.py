"""Registered queries of the text operators, each over its whole table, and their statements for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import bpe, exact, hamming, jaccard, multiset, packing, pii, secrets, shallot, suffix, toxicity, warc, whitening
from larder.llm.common import read


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(read(spark, sf_dir, "documents"), digests=True)


def op2_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.compare(read(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), digests=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages")).drop("payload")


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(read(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.cluster(read(spark, sf_dir, "embeddings"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.near_copies(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_multiset_fingerprints,
        op3_secret_scans,
        op4_exact_dedup,
        op5_packing,
        op6_byte_bpe,
        op7_toxicity,
        op8_ngram_jaccard_join,
        op9_warc,
        op10_pii_pseudonyms,
        op11_embedding_whitening,
        op12_centroid_clustering,
        op13_minhash_near_dedup,
    )
}

STATEMENTS = {
    "op12_centroid_clustering": shallot.statement(),
    "op4_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents
        ), g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256
        FROM t JOIN g USING (n)
    """,
}
