"""Projections, group filters, hierarchy counts and patient enrichment of a cell table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import feature_columns, metadata_columns
from ..sources.tables import as_table

# Hierarchy level and the column that identifies it.
LEVEL_COLUMN = {
    "patient": "Metadata_PatientID",
    "sample": "Metadata_SampleID",
    "disease": "Metadata_DiseaseGroup",
    "plate": "Metadata_Plate",
    "well": "Metadata_Well",
}


def metadata_frame(df: DataFrame) -> DataFrame:
    return df.select(*metadata_columns(df.columns))


def feature_frame(df: DataFrame) -> DataFrame:
    return df.select(*feature_columns(df.columns))


def _keep(df: DataFrame, column: str, values: str | Iterable[str]) -> DataFrame:
    wanted = [values] if isinstance(values, str) else list(values)
    return df.where(F.col(column).isin(wanted))


def select_disease_groups(df: DataFrame, groups: str | Iterable[str]) -> DataFrame:
    """Rows of the given disease group(s); reaches the scan as a pushed ``IN`` filter."""
    return _keep(df, "Metadata_DiseaseGroup", groups)


def select_patients(df: DataFrame, patient_ids: str | Iterable[str]) -> DataFrame:
    """Rows of the given patient(s)."""
    return _keep(df, "Metadata_PatientID", patient_ids)


def attach_patient_metadata(df: DataFrame, patient_table: DataFrame | str) -> DataFrame:
    """Left join by patient that adds only the columns ``df`` does not have yet.

    ``patient_table`` is a DataFrame or a Parquet path. The join carries no hint: Spark
    broadcasts the patients if their size allows, else AQE splits skewed patients.
    """
    patients = as_table(df.sparkSession, patient_table)
    key = "Metadata_PatientID"
    added = [c for c in patients.columns if c not in df.columns]
    return df.join(patients.select(key, *added), key, "left").select(*df.columns, *added)


def cell_counts(df: DataFrame, level: str = "patient") -> DataFrame:
    """Rows per value of a hierarchy level, NULL keys left out, sorted by key."""
    if level not in LEVEL_COLUMN:
        raise ValueError(f"level must be one of {sorted(LEVEL_COLUMN)}, not '{level}'")
    column = LEVEL_COLUMN[level]
    counts = df.where(F.col(column).isNotNull()).groupBy(column)
    return counts.agg(F.count("*").alias("n_cells")).orderBy(column)


def hierarchy_summary(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """One row: distinct patients, samples, plates and (plate, well) pairs, and all rows.

    Exact distinct counts shuffle the distinct values of each level, never a whole group;
    ``approximate`` swaps them for sketches.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        distinct("Metadata_PatientID").alias("n_patients"),
        distinct("Metadata_SampleID").alias("n_samples"),
        distinct("Metadata_Plate").alias("n_plates"),
        distinct(F.struct("Metadata_Plate", "Metadata_Well")).alias("n_wells"),
        F.count("*").alias("n_cells"),
    )
