"""The corpus pipeline: toxicity, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the documents are written as Parquet into
the shared checkpoint folder and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import contamination, grace, mixture, noisyor, ordermin, registry
from assayer.llm.common import prepare, settle, table
from assayer.llm.queries import BYTE_BPE


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return noisyor.drop_toxic(prepare_docs(spark, docs), table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return grace.drop_exact_duplicates(prepare_docs(spark, docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ordermin.drop_near_duplicates(prepare_docs(spark, docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return contamination.drop_contaminated(prepare_docs(spark, docs), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents in windows of tokens."""
    return mixture.pack(prepare_docs(spark, docs), **BYTE_BPE)


def prepare_docs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepare(spark)
    return docs


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

# A learned score and sampled sketches have no SQL twin; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(prepare(spark), sf_dir, "documents")
    for _name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


registry.QUERIES["pipeline"] = run
if ORACLE_SQL is not None:
    registry.CHECKS["pipeline"] = ORACLE_SQL
