"""Queries of the training-data operators, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations, document_trees, language_id, language_model, license_scan, mixing, near_duplicates, packing, personal_data, piece_codec, quality, source_divergence, vector_search
from .common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify_languages(docs, language_id.train(docs))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(read_table(spark, sf_dir, "documents"))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(read_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.group_documents(read_table(spark, sf_dir, "documents"))


def op8_document_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_trees.compare_with_next(read_table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest_documents(read_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit_sources(read_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_personal_data": op3_personal_data,
    "op4_vector_search": op4_vector_search,
    "op5_piece_codec": op5_piece_codec,
    "op6_language_model": op6_language_model,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_document_trees": op8_document_trees,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_source_divergence": op11_source_divergence,
    "op12_collocations": op12_collocations,
    "op13_mixing": op13_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op11_source_divergence": source_divergence.SQL,
    "op12_collocations": collocations.SQL,
    "op13_mixing": mixing.SQL,
}
