"""Patient-level integration of clinical, expression and morphology tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import as_table
from .profile import PATIENT_REPLICATE_COLUMNS

# Joined columns and the counted cell type.
CLINICAL_VALUES = (
    "ejection_fraction",
    "nyha_class",
    "bnp_pg_per_ml",
    "on_beta_blocker",
    "days_since_diagnosis",
)
FIBROBLAST = "Fibroblast"
# End of fixed values.

_KEY = "Metadata_PatientID"


def summarize_snrna(snrna: DataFrame) -> DataFrame:
    """Per patient: all nuclei, and the fraction that are fibroblasts."""
    share = F.when(F.col("cell_type") == FIBROBLAST, F.col("fraction_of_sample")).otherwise(0.0)
    return snrna.groupBy(_KEY).agg(
        F.sum("n_nuclei").alias("total_nuclei"), F.sum(share).alias("fibroblast_fraction")
    )


def integrate_multiomics(
    spark: SparkSession,
    patient: DataFrame | str,
    clinical: DataFrame | str,
    snrna: DataFrame | str,
    morphology: DataFrame | str,
) -> DataFrame:
    """One row per patient: patient columns, clinical values, expression summary,
    morphology features; sorted by patient. Tables may be DataFrames or Parquet paths.

    All joins are left joins on the patient, so their shuffles (if any table is too large
    to broadcast) use one partitioning. Expression rows are summed before the join.
    """
    profile = as_table(spark, morphology)
    clash = [c for c in PATIENT_REPLICATE_COLUMNS if c != _KEY]
    return (
        as_table(spark, patient)
        .join(as_table(spark, clinical).select(_KEY, *CLINICAL_VALUES), _KEY, "left")
        .join(summarize_snrna(as_table(spark, snrna)), _KEY, "left")
        .join(profile.drop(*clash), _KEY, "left")
        .orderBy(_KEY)
    )
