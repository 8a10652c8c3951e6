"""A cleaning pipeline over documents: toxic ones go, copies and near copies fold, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import exact, jaccard, packing, secrets, toxicity
from larder.llm.common import read, written


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic; the score is learned from the table of labels."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def copies_fold(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group of equal texts."""
    return exact.without_copies(docs)


def near_copies_fold(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each component of linked texts; five-word shingles, similarity 0.8."""
    return jaccard.without_near_copies(docs, words=5, percent=80)


def secrets_are_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secrets.without_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("exact_dedup", copies_fold),
    ("ngram_jaccard_join", near_copies_fold),
    ("secret_scans", secrets_are_masked),
    ("packing", packed),
]

#: Learned scores and token ids can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
