"""Corpus pipeline: reject poor text, keep one of each group of near copies, redact secrets, pack into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genoframe.llm import packing, quality, resemblance, secrets
from genoframe.session import cut, read_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), the one of the least id."""
    return resemblance.keep_first(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    model = secrets.train(secrets.trusted_words(docs, read_table(spark, sf_dir, "labels")))
    return secrets.redact_documents(docs, model)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, lean=True)


STAGES = [("quality classifier", quality_filter), ("SimHash near-dedup", near_dedup), ("secret scans", secret_redaction), ("packing", packed)]

#: SQL has no Kneser-Ney model, SimHash or tokenizer: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
