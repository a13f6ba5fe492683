"""Parquet and metadata-CSV tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import (
    METADATA_TYPES,
    SchemaValidationError,
    cast_to_schema,
    metadata_type,
    partition_columns,
)

# Columns of the raw site and treatment tables.
RAW_IMAGE_DDL = (
    "TableNumber string, ImageNumber int, Image_Metadata_Plate_DAPI string, "
    "Image_Metadata_Well_DAPI string, Replicate int, Image_Metadata_Compound string, "
    "Image_Metadata_Concentration double"
)
RAW_COMPOUND_DDL = "compound string, smiles string"
RAW_MOA_DDL = "compound string, concentration double, moa string"


def as_table(spark: SparkSession, table: DataFrame | str) -> DataFrame:
    """A DataFrame as it is, a path as a Parquet scan."""
    return table if isinstance(table, DataFrame) else spark.read.parquet(str(table))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_single_cells(spark: SparkSession, path: str) -> DataFrame:
    """The single-cell table in canonical types and order.

    Partition columns come back from their folder names, where Spark would guess a type
    ("007" as a number), so they are read with the type of the metadata registry.
    """
    stored = spark.read.parquet(path).schema
    typed = T.StructType(
        [
            T.StructField(
                field.name,
                metadata_type(field.name) if field.name in METADATA_TYPES else field.dataType,
            )
            for field in stored
        ]
    )
    metadata, features = partition_columns(stored.names)
    known = [c for c in METADATA_TYPES if c in metadata]
    other = [c for c in metadata if c not in known]
    return spark.read.schema(typed).parquet(path).select(*known, *other, *features)


def write_parquet(
    table: DataFrame,
    path: str,
    *,
    schema: T.StructType | None = None,
    allow_extra_columns: bool = False,
    partition_by: str | None = None,
) -> str:
    """Write Parquet (overwriting), cast to ``schema`` first when one is given.

    With ``partition_by`` rows are rebalanced on that column, so each value goes to few,
    evenly sized files: AQE splits large values and packs small ones together.
    """
    if schema is not None:
        table = cast_to_schema(table, schema, allow_extra_columns=allow_extra_columns)
    if partition_by is not None:
        table = table.hint("rebalance", F.col(partition_by))
    writer = table.write.mode("overwrite")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV columns named in ``schema``, matched by header name and cast; others unread.

    All text is read as strings and cast by the plan, so no inference pass runs, the
    column order in the file does not matter and unused columns are pruned by the parser.
    """
    raw = spark.read.option("header", True).csv(path)
    absent = [n for n in schema.names if n not in raw.columns]
    if absent:
        raise SchemaValidationError(f"{path}: missing columns {absent}")
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def load_metadata_csvs(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """The three metadata files by logical name: ``image``, ``compound``, ``moa``."""
    ddl = {"image": RAW_IMAGE_DDL, "compound": RAW_COMPOUND_DDL, "moa": RAW_MOA_DDL}
    return {
        name: read_csv(spark, path, T.StructType.fromDDL(ddl[name]))
        for name, path in paths.items()
    }
