"""The corpus pipeline: quality, near duplicates, decontamination, secrets, pieces.

Each stage takes the documents its predecessor kept, whole, and returns documents with the same columns; the last
returns their ids in the public vocabulary. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrum.llm import decontamination, near_dedup, pieces, quality, secret_scan
from metrum.llm.tables import scratch, table


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels outside the held-out fold."""
    net = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.accepted(docs, net)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id."""
    return near_dedup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth of their words in windows of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_scan.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, exact."""
    return pieces.encoded(docs, pieces.Vocabulary.load())


STAGES = [("quality", accept), ("near_dedup", deduplicate), ("decontamination", decontaminate), ("secrets", redact), ("pieces", encode)]
#: The classifier and the piece model are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark)
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
