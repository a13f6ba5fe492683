"""Composite jobs: QC report, patient profiles, site subset and the end-to-end run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assign import assign_patients
from ..operators.cells import to_canonical_single_cells
from ..operators.features import select_features
from ..operators.integrate import integrate_multiomics
from ..operators.profile import (
    PATIENT_REPLICATE_COLUMNS,
    aggregate_to_wells,
    consensus_profiles,
    normalize_profiles,
)
from ..operators.qc import (
    count_outliers,
    counts_from_pyramid,
    drift_from_moments,
    missingness_from_moments,
    moment_pyramid,
    moments_of,
    outlier_features,
    outlier_summary,
)
from ..operators.sites import build_dev_subset, validate_image_table
from ..schema import (
    clinical_schema,
    feature_columns,
    image_schema,
    numeric_features,
    patient_schema,
    snrna_summary_schema,
)
from ..session import materialize, scratch_scope
from ..sources.compartments import join_compartments
from ..sources.tables import as_table, load_metadata_csvs, load_single_cells, write_parquet


def prepare_dev_subset(
    spark: SparkSession, csv_paths: Mapping[str, str], dest_path: str, *, n_plates: int = 3
) -> DataFrame:
    """Metadata CSVs to a checked, stored site table; returns a scan of it."""
    raw = load_metadata_csvs(spark, csv_paths)
    subset = build_dev_subset(raw["image"], raw["moa"], n_plates=n_plates)
    write_parquet(subset, dest_path, schema=image_schema())
    stored = spark.read.parquet(dest_path)
    problems = validate_image_table(stored)
    if problems:
        raise ValueError("the site subset is not valid: " + "; ".join(problems))
    return stored


def qc_report(
    cells: DataFrame,
    out_dir: str | None = None,
    *,
    thresholds: Mapping[str, float] | None = None,
) -> dict[str, DataFrame]:
    """The seven QC tables, written below ``out_dir`` as ``qc_<name>.parquet`` if given.

    The cells are scanned twice: once for a pyramid of moments per batch, plate, well and disease, from
    which counts, missingness and both drift tables are merged, and once to count the outliers
    around the merged means. With ``out_dir`` no scratch table is left.
    """
    if out_dir is None:
        return _report(cells, out_dir, thresholds)[0]
    with scratch_scope(cells.sparkSession):
        return _report(cells, out_dir, thresholds)[0]


def _report(
    cells: DataFrame, out_dir: str | None, thresholds: Mapping[str, float] | None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables, and the stored one row of cells and outliers."""
    batch, plate = "Metadata_Batch", "Metadata_Plate"
    keys = [batch, plate, "Metadata_Well", "Metadata_DiseaseGroup"]
    names = numeric_features(cells, None)
    present = outlier_features(cells, thresholds)
    measured = [*names, *[f for f in present if f not in names]]
    pyramid = materialize(moment_pyramid(cells, keys, measured), "pyramid")
    moments = moments_of(pyramid, keys, names)
    flagged = count_outliers(cells, moments_of(pyramid, keys, list(present)), present)
    flagged = materialize(flagged, "outliers")
    report = {
        "cell_counts_per_well": counts_from_pyramid(pyramid, "well"),
        "cell_counts_per_plate": counts_from_pyramid(pyramid, "plate"),
        "cell_counts_per_disease": counts_from_pyramid(pyramid, "disease"),
        "missingness": missingness_from_moments(moments),
        "feature_drift_by_batch": drift_from_moments(moments, batch),
        "plate_effects": drift_from_moments(moments, plate),
        "outliers": outlier_summary(flagged, present),
    }
    if out_dir is not None:
        read = cells.sparkSession.read.parquet
        report = {
            name: read(write_parquet(table, f"{out_dir}/qc_{name}.parquet"))
            for name, table in report.items()
        }
    return report, flagged


def build_patient_profiles(
    cells: DataFrame,
    out_dir: str | None = None,
    *,
    method: str = "standardize",
    normalize_samples: str = "all",
) -> dict[str, DataFrame]:
    """Cells to well profiles, normalised, selected and per-patient consensus profiles.

    The well profiles (in ``out_dir``, else in the scratch folder) and the normalised ones are
    stored, because the selection must run a pass over them before the consensus can be planned.
    """
    spark = cells.sparkSession
    wells = aggregate_to_wells(cells)
    if out_dir is None:
        wells = materialize(wells, "wells")
    else:
        wells = spark.read.parquet(write_parquet(wells, f"{out_dir}/well_profiles.parquet"))
    normalized = normalize_profiles(wells, method=method, samples=normalize_samples)
    normalized = materialize(normalized, "normalized")
    selected = select_features(normalized)
    patients = consensus_profiles(selected)
    if out_dir is not None:
        path = write_parquet(patients, f"{out_dir}/morphology_profile.parquet")
        patients = spark.read.parquet(path)
    return {
        "well_profiles": wells,
        "normalized": normalized,
        "selected": selected,
        "patient_profiles": patients,
    }


@dataclass(frozen=True)
class JobConfig:
    """Settings of :func:`run_profile_job`."""

    n_plates: int = 2
    seed: int = 0
    normalize_method: str = "standardize"
    normalize_samples: str = "all"
    disease_plate_confounding: float = 0.0
    outlier_thresholds: Mapping[str, float] | None = None
    partition_cells_by: str | None = None


def run_summary(
    sites: DataFrame,
    wells: DataFrame,
    flagged: DataFrame,
    outliers: DataFrame,
    integrated: DataFrame,
    n_features_selected: int,
) -> DataFrame:
    """One row of counts, from stored results alone: ``wells`` has the patients, ``flagged`` the cells
    (:func:`.qc.count_outliers`). ``n_outlier_flags`` adds up the thresholds' flags, so a cell that
    fails two counts twice; ``n_outlier_cells`` counts cells that fail any."""
    parts = [
        sites.agg(
            F.count_distinct("Metadata_Plate").alias("n_plates"),
            F.count_distinct(F.struct("Metadata_Plate", "Metadata_Well")).alias("n_wells"),
        ),
        flagged.agg(F.max("_rows").alias("n_cells")),
        wells.agg(F.count_distinct("Metadata_PatientID").alias("n_patients")),
        flagged.agg(F.max("_any").alias("n_outlier_cells")),
        outliers.agg(F.coalesce(F.sum("n_outliers"), F.lit(0)).alias("n_outlier_flags")),
        integrated.agg(F.count("*").alias("n_integrated_rows")),
    ]
    # Every part is one global aggregate, i.e. exactly one row.
    summary = parts[0]
    for part in parts[1:]:
        row = part.select(F.struct("*").alias("s")).scalar()
        summary = summary.withColumn("_p", row).select(
            *summary.columns, *[F.col("_p").getField(c).alias(c) for c in part.columns]
        )
    return summary.withColumn("n_features_selected", F.lit(n_features_selected).cast("bigint"))


def run_from_subset(
    spark: SparkSession,
    sites: DataFrame | str,
    patients: DataFrame | str,
    compartments: Mapping[str, DataFrame],
    clinical: DataFrame | str,
    snrna: DataFrame | str,
    out_dir: str,
    config: JobConfig = JobConfig(),
) -> tuple[DataFrame, dict[str, str]]:
    """Everything downstream of a site subset. Inputs are tables (nothing is simulated);
    each stage is stored below ``out_dir`` and read back by the next one.

    Returns the one-row summary, stored as well, and the output paths. Scratch tables are
    deleted at the end.
    """
    with scratch_scope(spark):
        summary, out = _run(
            spark, sites, patients, compartments, clinical, snrna, out_dir.rstrip("/"), config
        )
        out["summary"] = write_parquet(summary, f"{out_dir.rstrip('/')}/summary.parquet")
    return spark.read.parquet(out["summary"]), out


def _run(
    spark: SparkSession,
    sites: DataFrame | str,
    patients: DataFrame | str,
    compartments: Mapping[str, DataFrame],
    clinical: DataFrame | str,
    snrna: DataFrame | str,
    out_dir: str,
    config: JobConfig,
) -> tuple[DataFrame, dict[str, str]]:
    out = {
        name: f"{out_dir}/{name}.parquet"
        for name in (
            "dev_subset",
            "single_cell",
            "patient",
            "clinical",
            "snrna_summary",
            "integrated_patient",
        )
    }
    write_parquet(as_table(spark, sites), out["dev_subset"], schema=image_schema())
    write_parquet(as_table(spark, patients), out["patient"], schema=patient_schema())
    write_parquet(as_table(spark, clinical), out["clinical"], schema=clinical_schema())
    write_parquet(as_table(spark, snrna), out["snrna_summary"], schema=snrna_summary_schema())

    subset = spark.read.parquet(out["dev_subset"])
    assigned = assign_patients(
        subset,
        out["patient"],
        seed=config.seed,
        disease_plate_confounding=config.disease_plate_confounding,
    )
    to_canonical_single_cells(
        join_compartments(compartments, file_names=False),
        assigned,
        out["single_cell"],
        partition_by=config.partition_cells_by,
    )
    cells = load_single_cells(spark, out["single_cell"])
    report, flagged = _report(cells, out_dir, config.outlier_thresholds)
    profiles = build_patient_profiles(
        cells,
        out_dir,
        method=config.normalize_method,
        normalize_samples=config.normalize_samples,
    )
    out["well_profiles"] = f"{out_dir}/well_profiles.parquet"
    out["morphology_profile"] = f"{out_dir}/morphology_profile.parquet"
    integrated = integrate_multiomics(
        spark, out["patient"], out["clinical"], out["snrna_summary"], out["morphology_profile"]
    )
    write_parquet(integrated, out["integrated_patient"])
    summary = run_summary(
        subset,
        profiles["well_profiles"],
        flagged,
        report["outliers"],
        spark.read.parquet(out["integrated_patient"]),
        len(
            [
                c
                for c in feature_columns(profiles["selected"].columns)
                if c not in PATIENT_REPLICATE_COLUMNS
            ]
        ),
    )
    return summary, out


def run_profile_job(
    spark: SparkSession,
    csv_paths: Mapping[str, str],
    patients: DataFrame | str,
    compartments: Mapping[str, DataFrame],
    clinical: DataFrame | str,
    snrna: DataFrame | str,
    out_dir: str,
    config: JobConfig = JobConfig(),
) -> tuple[DataFrame, dict[str, str]]:
    """:func:`prepare_dev_subset` from the metadata CSVs, then :func:`run_from_subset`."""
    path = f"{out_dir.rstrip('/')}/checked_subset.parquet"
    subset = prepare_dev_subset(spark, csv_paths, path, n_plates=config.n_plates)
    return run_from_subset(
        spark, subset, patients, compartments, clinical, snrna, out_dir, config
    )
