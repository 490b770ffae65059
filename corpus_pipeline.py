"""A training corpus from ``documents``: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
Nulls: rows whose text is null go with the first stage, as no language can be told; rows with a null id pass every filter that their
text passes and are never trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triagelake.llm import language_id, near_duplicates, packing, personal_data, quality
from triagelake.llm.common import read_table, written


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with calibrated confidence; those that the model rejects go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group alike in 0.8 or more of their five-word shingles."""
    return near_duplicates.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets and ``n_chars`` brought up to date."""
    return personal_data.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_language),
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: Learnt decisions and a tokenizer's ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them the rows are tables in the shared folder, so no stage runs twice."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
