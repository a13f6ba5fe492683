"""Corpus pipeline: documents to cleaned, mixed and sharded training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellprofiles.llm import decontamination, language, mixing, sharding, simhash
from cellprofiles.llm.common import document_columns, read_table
from cellprofiles.llm.queries import N_SHARDS
from cellprofiles.session import remove_scratch, scratch_path, scratch_scope


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not reject."""
    return language.keep_identified(docs).select(*document_columns(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs).select(*document_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    return decontamination.remove_contaminated(docs, benchmark).select(*document_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document appears as often as the mix takes it."""
    return mixing.mix_documents(docs).select(*document_columns(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the number of their shard, equal texts together."""
    return sharding.shard_documents(docs, N_SHARDS)


STAGES = [
    ("language ID", identify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: The stages use trained models and hashes that SQL does not have; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next one.

    What a stage leaves in the scratch folder is deleted when its rows are written, and its rows
    when those of the next stage are; the last stage reads the rows of the one before.
    """
    docs, held = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        with scratch_scope(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        if held is not None:
            remove_scratch(spark, held)
        docs, held = spark.read.schema(found.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
