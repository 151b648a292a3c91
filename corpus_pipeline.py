"""Training corpus from raw documents: quality, recurring lines, near copies, benchmark passages, packing.

Every stage takes and returns all rows its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvaflow.llm import decontaminate, packing, parity_join, quality, templates
from sylvaflow.llm.queries import remainder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of three of four folds."""
    labels = table(spark, sf_dir, "labels").where(remainder(4) != 2)
    return quality.accepted(docs, quality.learn(docs, labels))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs across documents."""
    return templates.drop_recurring(docs).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return parity_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_recurring_lines),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The stages learn, parse and align. Those after the classifier are tested against plain versions of them, each on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
