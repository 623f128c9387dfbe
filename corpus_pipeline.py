"""The corpus pipeline: quality, near-duplicates, benchmark leaks, source mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents; the last adds ``shard`` and
``slot``. A document goes if the classifier rejects it, if it is a near-duplicate of one that stays, or
if it holds a benchmark window; the mixture repeats and drops documents by its draws.

Defined results, in every stage: a null or empty text is a document without words, which is judged as empty
text, is a copy of nothing, holds no window and takes part in the mixture; a null doc_id, source or lang is a
value like any other; rows with the same id and text are one document from the second stage on, rows with an
id alone in common are not; ties go to the smallest id or hash; texts of any length are read whole; an empty
table stays empty; other columns are kept whatever their names, and where one is called shard or slot the
last stage's gets an underscore after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, near_dedup, quality_classifier, sharding
from tessera.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.good_documents(docs, table(spark, sf_dir, "labels"))


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = sharding.document_shards(docs, 16, with_columns=True)
    # The curve's index comes right after the documents' own columns.
    return cut.drop(cut.columns[len(docs.columns)])


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", deduplication),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Trained trees, sketches and components have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
