"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread.

Each stage works on all rows that its predecessor kept and returns the columns of documents; the
last returns, per document, the words that the mix takes of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagspace.llm import decontaminate, exact_dedup, mixing, near_dedup, quality_gam
from tagspace.llm.common import written

#: Similarity in percent from which the near-dedup stage links documents (85 is op4's contract).
NEAR_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_gam.keep_quality(docs, _table(spark, sf_dir, "labels"))


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id."""
    return near_dedup.drop_near_copies(docs, percent=NEAR_PERCENT)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every document that came here."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", remove_exact_copies),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix),
]

#: The trained, the sketched and the pseudorandom stages have no SQL form: tests hold the exact and the near-dedup
#: stage against brute force, the others against planted rows, labels and their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
