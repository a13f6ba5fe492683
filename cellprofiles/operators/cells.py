"""Joined compartment table to canonical single-cell table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COMPARTMENTS, cast_to_schema, single_cell_schema
from ..sources.compartments import OBJECT_COUNTER, join_compartments, read_compartment_csvs
from ..sources.tables import as_table, write_parquet


def joined_feature_columns(columns: Iterable[str]) -> list[str]:
    """Sorted compartment measurements, object counters left out."""
    prefixes = tuple(f"{name}_" for name in COMPARTMENTS)
    return sorted(
        c for c in columns if c.startswith(prefixes) and not c.endswith(OBJECT_COUNTER)
    )


def canonical_single_cells(joined: DataFrame, sites: DataFrame) -> DataFrame:
    """Cells with the metadata of their site, as :func:`single_cell_schema` orders it.

    Left join on the image number without a hint: a small site table is broadcast by
    Spark itself, a large one is shuffled and AQE splits images with very many cells.
    """
    features = joined_feature_columns(joined.columns)
    schema = single_cell_schema(features)
    keys = ["Metadata_ImageNumber", "Metadata_ObjectNumber"]
    cells = joined.select(*[F.col(k).cast("int").alias(k) for k in keys], *features)
    wanted = [c for c in schema.names if c in sites.columns]
    return cast_to_schema(
        cells.join(sites.select(*wanted), "Metadata_ImageNumber", "left"), schema
    )


def to_canonical_single_cells(
    joined: DataFrame | str, sites: DataFrame, dest_path: str, *, partition_by: str | None = None
) -> str:
    """Write :func:`canonical_single_cells`; ``partition_by`` is usually the plate."""
    table = as_table(sites.sparkSession, joined)
    return write_parquet(
        canonical_single_cells(table, sites), dest_path, partition_by=partition_by
    )


def build_single_cell_parquet(
    spark: SparkSession,
    csv_dir: str,
    sites: DataFrame,
    dest_path: str,
    *,
    partition_by: str | None = None,
) -> str:
    """Compartment CSVs to the single-cell table in one plan, without an interim table."""
    joined = join_compartments(read_compartment_csvs(spark, csv_dir), file_names=False)
    return to_canonical_single_cells(joined, sites, dest_path, partition_by=partition_by)
