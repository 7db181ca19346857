"""A training-data pipeline over documents: quality rules, near-dedup, secret redaction, source mixing, SentencePiece coding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.

Defined cases are those of the operators: null, empty and very long texts, repeated rows, empty tables and clashing extra columns
pass through each stage as its operator's docstring says; columns beyond those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import mixing, neardup, pieces, quality, secrets
from fieldloom.session import bounded_batches, materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the adaptive thresholds of their language and source."""
    bounded_batches(spark)
    return quality.kept_documents(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest doc_id."""
    bounded_batches(spark)
    return neardup.one_of_each(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    bounded_batches(spark)
    return secrets.redacted(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: repeated ones as repeated rows, cut ones with the words that are taken."""
    bounded_batches(spark)
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_ids, round_trip."""
    bounded_batches(spark)
    return pieces.encoded(docs, keep=("source",))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]
#: No stage but the first could be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
