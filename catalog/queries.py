"""One query per operator. Every function takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import cellprofiles as cp
from cellprofiles.operators import evaluate, features, pairs, profile, qc, sites
from cellprofiles.plans import jobs
from cellprofiles.session import materialize, materialize_in_turn, scratch_path, scratch_scope
from cellprofiles.sources import compartments, tables

from . import roles
from .roles import FEATURES, SEGMENTS

Query = Callable[[SparkSession, str], DataFrame]

#: Hot-group limit that sends every larger group of the test tables the bracketed way.
LOW_HOT_ROWS = 100


def rounded(df: DataFrame, digits: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Doubles to a number of decimals both engines agree on."""
    names = columns or [f.name for f in df.schema if f.dataType == T.DoubleType()]
    return df.withColumns({n: F.round(n, digits) for n in names})


def _role(sql: str) -> Query:
    return lambda spark, sf: roles.for_spark(spark, sf, sql)


cells = _role(roles.CELLS)


def well_table(spark: SparkSession, sf: str) -> DataFrame:
    return cp.aggregate_to_wells(cells(spark, sf))


def compartment_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    named = {
        "Image": roles.IMAGES,
        "Cells": roles.CELL_TABLE,
        "Cytoplasm": roles.CYTOPLASM,
        "Nuclei": roles.NUCLEI,
    }
    return {name: roles.for_spark(spark, sf, sql) for name, sql in named.items()}


# --- sources, sinks, schema ----------------------------------------------------------


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType.fromDDL(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    )
    path = scratch_path(spark, "orders-csv")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(*schema.names)
    orders.write.option("header", True).csv(path)
    back = tables.read_csv(spark, path, schema)
    return back.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "cells")
    schema = cp.single_cell_schema(FEATURES, [c for c in CELL_METADATA])
    tables.write_parquet(cells(spark, sf), path, schema=schema, partition_by="Metadata_Plate")
    return tables.load_single_cells(spark, path)


CELL_METADATA = [
    "Metadata_PatientID",
    "Metadata_SampleID",
    "Metadata_Plate",
    "Metadata_Well",
    "Metadata_Batch",
    "Metadata_DiseaseGroup",
    "Metadata_ImageNumber",
    "Metadata_ObjectNumber",
]


def validate_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of the customers from a schema: a column too few, one too many, two retyped."""
    table = spark.read.parquet(f"{sf}/customer.parquet")
    given = [f for f in table.schema if f.name != "c_mktsegment"]
    types = {"c_nationkey": T.StringType(), "c_acctbal": T.FloatType()}
    wanted = [T.StructField(f.name, types.get(f.name, f.dataType)) for f in given]
    wanted.append(T.StructField("c_region", T.StringType()))
    found = cp.schema.schema_differences(table, T.StructType(wanted))
    rows = [(kind, name) for kind, names in found.items() for name in names]
    return spark.createDataFrame(rows, "difference string, column string")


def cast_to_schema(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType.fromDDL("l_partkey string, l_quantity int, l_linenumber double")
    source = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_returnflag", "l_quantity", "l_linenumber", "l_partkey"
    )
    return cp.cast_to_schema(source, schema, allow_extra_columns=True)


def feature_pick(spark: SparkSession, sf: str) -> DataFrame:
    joined = cp.join_compartments(compartment_tables(spark, sf))
    return joined.select(*cp.joined_feature_columns(joined.columns))


# --- sites and cells -----------------------------------------------------------------


def canonical_sites(spark: SparkSession, sf: str) -> DataFrame:
    raw, moa = (roles.for_spark(spark, sf, s) for s in (roles.RAW_SITES, roles.MOA))
    return rounded(cp.canonicalize_image_table(raw, moa), 6)


def validate_sites(spark: SparkSession, sf: str) -> DataFrame:
    raw, moa = (roles.for_spark(spark, sf, s) for s in (roles.RAW_SITES, roles.MOA))
    return rounded(sites.image_table_checks(cp.canonicalize_image_table(raw, moa)), 6)


def dev_subset_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The same from metadata CSVs, checked and stored."""
    paths = {}
    for name, sql in {"image": roles.RAW_SITES, "moa": roles.MOA}.items():
        paths[name] = scratch_path(spark, f"{name}-csv")
        roles.for_spark(spark, sf, sql).write.option("header", True).csv(paths[name])
    return rounded(cp.prepare_dev_subset(spark, paths, scratch_path(spark, "subset"), n_plates=2), 6)


def dev_subset(spark: SparkSession, sf: str) -> DataFrame:
    raw, moa = (roles.for_spark(spark, sf, s) for s in (roles.RAW_SITES, roles.MOA))
    return rounded(cp.build_dev_subset(raw, moa, n_plates=2), 6)


def compartment_join(spark: SparkSession, sf: str) -> DataFrame:
    return cp.join_compartments(compartment_tables(spark, sf))


def attach_sites(spark: SparkSession, sf: str) -> DataFrame:
    assigned = roles.for_spark(spark, sf, roles.ASSIGNED_SITES)
    joined = cp.join_compartments(compartment_tables(spark, sf), file_names=False)
    return cp.canonical_single_cells(joined, assigned)


def cells_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Stored single cells, built from the CSV tables of the compartments in one plan."""
    folder, dest = scratch_path(spark, "compartment-csv"), scratch_path(spark, "cells")
    for name, table in compartment_tables(spark, sf).items():
        table.write.option("header", True).csv(f"{folder}/{name}.csv")
    assigned = roles.for_spark(spark, sf, roles.ASSIGNED_SITES)
    cp.build_single_cell_parquet(spark, folder, assigned, dest, partition_by="Metadata_Plate")
    return tables.load_single_cells(spark, dest)


def compartment_split(spark: SparkSession, sf: str) -> DataFrame:
    return compartments.compartment_table(cells(spark, sf), "Nuclei")


def image_split(spark: SparkSession, sf: str) -> DataFrame:
    located = roles.for_spark(spark, sf, roles.ASSIGNED_SITES)
    return compartments.image_table(cells(spark, sf), located)


def compartment_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The joins are stored one by one, and what is no longer read is removed, to bound the disk."""
    path = scratch_path(spark, "compartments")
    assigned = roles.for_spark(spark, sf, roles.ASSIGNED_SITES)
    with scratch_scope(spark):
        tables = compartment_tables(spark, sf)
        joined = cp.join_compartments(tables, file_names=False, staged=True)
        cells = materialize_in_turn(spark, [cp.canonical_single_cells(joined, assigned)], "cells")
        cp.write_compartment_csvs(cells, assigned, path, compression="lz4")
    return cp.join_compartments(cp.read_compartment_csvs(spark, path), staged=True)


def assignment(confounding: float) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return cp.assign_patients(
            roles.for_spark(spark, sf, roles.SITES),
            roles.for_spark(spark, sf, roles.PATIENTS),
            disease_plate_confounding=confounding,
            disease_order=SEGMENTS,
        )

    return query


# --- selection, enrichment, integration ----------------------------------------------


def select_groups(spark: SparkSession, sf: str) -> DataFrame:
    return cp.select_disease_groups(cells(spark, sf), ["BUILDING", "MACHINERY"])


def select_patients(spark: SparkSession, sf: str) -> DataFrame:
    return cp.select_patients(cells(spark, sf), [str(i) for i in range(1, 40)])


def attach_missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    return cp.attach_patient_metadata(
        cells(spark, sf), roles.for_spark(spark, sf, roles.PATIENTS)
    )


def integrate_patients(spark: SparkSession, sf: str) -> DataFrame:
    named = (roles.PATIENTS, roles.CLINICAL, roles.SNRNA, roles.MORPHOLOGY)
    return cp.integrate_multiomics(spark, *[roles.for_spark(spark, sf, s) for s in named])


# --- quality control -----------------------------------------------------------------


def cell_counts(level: str) -> Query:
    return lambda spark, sf: cp.cell_counts(cells(spark, sf), level)


def outlier_labels(spark: SparkSession, sf: str) -> DataFrame:
    return cp.detect_outliers(roles.for_spark(spark, sf, roles.EVENTS))[0]


def outlier_summary(spark: SparkSession, sf: str) -> DataFrame:
    cuts = {"Nuclei_AreaShape_Area": 1.5, "Cells_AreaShape_Area": -1.2, "Absent": 3.0}
    return rounded(cp.detect_outliers(cells(spark, sf), thresholds=cuts)[1], 9)


def qc_report(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of all seven tables in one tidy frame ``report, entity, measure, number``."""
    report = cp.qc_report(cells(spark, sf))
    frames = []
    for name, table in report.items():
        key, *values = table.columns
        measures = [
            F.struct(
                F.lit(value).alias("measure"),
                F.round(F.col(value).cast("double"), 9).alias("number"),
            )
            for value in values
        ]
        frames.append(
            table.select(
                F.lit(name).alias("report"),
                F.col(key).alias("entity"),
                F.inline(F.array(*measures)),
            )
        )
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


# --- profiles ------------------------------------------------------------------------


def hot_wells(spark: SparkSession, sf: str) -> DataFrame:
    """Wells without the patient: large groups, all of them above the lowered limit."""
    grain = ["Metadata_Plate", "Metadata_Well", "Metadata_Batch"]
    return rounded(
        cp.aggregate_to_wells(cells(spark, sf), strata=grain, hot_rows=LOW_HOT_ROWS), 6
    )


def mixed_wells(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles per patient with a limit that splits ordinary and hot groups."""
    grain = ["Metadata_PatientID", "Metadata_DiseaseGroup"]
    return rounded(cp.aggregate_to_wells(cells(spark, sf), strata=grain, hot_rows=45), 6)


def normalized(digits: int = 6, **options: object) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        wells = materialize(well_table(spark, sf), "wells")
        return rounded(cp.normalize_profiles(wells, features=FEATURES, **options), digits)

    return query


def normalize_spherize(spark: SparkSession, sf: str) -> DataFrame:
    """Whitening of all features, the mean in place of gaps."""
    wells = materialize(well_table(spark, sf), "wells")
    return rounded(
        cp.normalize_profiles(wells, method="spherize", features=FEATURES, impute=True), 6
    )


def normalize_spherize_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Whitening of two features, one of them with gaps, for which SQL has a closed form."""
    wells = materialize(well_table(spark, sf), "wells")
    white = cp.normalize_profiles(wells, method="spherize", features=FEATURES[1:3], impute=True)
    return rounded(white.select(*cp.schema.metadata_columns(white.columns), *FEATURES[1:3]), 6)


def controls_constant(method: str) -> Query:
    """Normalised by controls that agree in one feature."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        control = F.col("Metadata_DiseaseGroup") == "BUILDING"
        flat = F.when(control, 7.0).otherwise(F.col(FEATURES[0]))
        wells = materialize(well_table(spark, sf).withColumn(FEATURES[0], flat), "wells")
        options = {"method": method, "samples": "Metadata_DiseaseGroup == 'BUILDING'"}
        scaled = cp.normalize_profiles(wells, features=FEATURES, **options)
        # What differs from constant controls is huge: only its order of size is comparable.
        size = "CASE WHEN abs($) > 1e9 THEN sign($) * round(log10(abs($)), 6) ELSE round($, 6) END"
        return scaled.withColumns({f: F.expr(size.replace("$", f)) for f in FEATURES})

    return query


def select_variance(spark: SparkSession, sf: str) -> DataFrame:
    wells = materialize(well_table(spark, sf), "wells")
    return features.value_frequencies(wells, FEATURES)


def select_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """The correlation matrix the selection works on, one row per ordered pair."""
    wells = materialize(well_table(spark, sf), "wells")
    return correlation_rows(wells, FEATURES)


def correlation_rows(wells: DataFrame, names: Sequence[str]) -> DataFrame:
    matrix = profile.feature_correlation(wells, names)
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return rounded(wells.sparkSession.createDataFrame(rows, "a string, b string, r double"), 6)


def select_correlation_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a feature that is always missing and one that half of the wells lack."""
    half = F.when(F.col("Metadata_Object_Count") > 1, F.col(FEATURES[0]) * 2)
    wells = well_table(spark, sf).withColumns(
        {"Cells_Empty": F.lit(None).cast("double"), "Cells_Half": half}
    )
    return correlation_rows(materialize(wells, "wells"), [*FEATURES, "Cells_Empty", "Cells_Half"])


def selected_features(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each default operation of the selection drops each feature."""
    wells = materialize(well_table(spark, sf), "wells")
    found = features.drop_decisions(wells, features=FEATURES)
    rows = [(op, f, f in dropped) for op, dropped in found.items() for f in FEATURES]
    return spark.createDataFrame(rows, "operation string, feature string, dropped boolean")


def consensus_median(spark: SparkSession, sf: str) -> DataFrame:
    wells = well_table(spark, sf)
    return rounded(cp.consensus_profiles(wells, features=FEATURES), 6)


def consensus_mean(spark: SparkSession, sf: str) -> DataFrame:
    wells = materialize(well_table(spark, sf), "wells")
    scaled = cp.normalize_profiles(wells, features=FEATURES)
    return rounded(cp.consensus_profiles(scaled, operation="mean"), 6)


def consensus_modz(spark: SparkSession, sf: str) -> DataFrame:
    wells = materialize(well_table(spark, sf), "wells")
    scaled = cp.normalize_profiles(wells, features=FEATURES)
    return rounded(cp.consensus_profiles(scaled, operation="modz"), 6)


def patient_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Cells to consensus: wells, standardise, select, median per patient."""
    built = cp.build_patient_profiles(cells(spark, sf))
    names = cp.schema.feature_columns(built["patient_profiles"].columns)
    entries = [
        F.struct(F.lit(n).alias("feature"), F.round(F.col(n), 6).alias("value")) for n in names
    ]
    kept = cp.schema.metadata_columns(built["patient_profiles"].columns)
    return built["patient_profiles"].select(*kept, F.inline(F.array(*entries)))


# --- evaluation ----------------------------------------------------------------------


def silhouette_many_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Silhouette of labels with a few rows each."""
    rows = roles.for_spark(spark, sf, roles.EMBEDDINGS).withColumn("label", F.expr("row_id div 4"))
    data = pairs.prepare_vectors(rows, "embedding", ["label"], "row_id")
    return rounded(evaluate.silhouette(data, "label"), 6)


def vectors(spark: SparkSession, sf: str) -> pairs.Profiles:
    rows = roles.for_spark(spark, sf, roles.EMBEDDINGS)
    return pairs.prepare_vectors(rows, "embedding", ["label", "batch"], "row_id")


def metric(function: Callable[..., DataFrame], *args: object, **options: object) -> Query:
    return lambda spark, sf: rounded(function(vectors(spark, sf), *args, **options), 6)


def chance_level(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cp.chance_level(cells(spark, sf), "Metadata_DiseaseGroup"), 9)


def embedding_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One column per entry of the vectors, which must all have the same length."""
    rows = roles.for_spark(spark, sf, roles.EMBEDDINGS)
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    least, width = rows.agg(F.min(size), F.max(size)).first()
    if least != width or (width or 0) < 0:
        raise ValueError(f"embeddings have {least} to {width} values")
    return rows.select(
        F.col("row_id").alias("Metadata_Row"),
        F.col("label").alias("Metadata_DiseaseGroup"),
        F.col("batch").alias("Metadata_Batch"),
        F.col("label").alias("Metadata_PatientID"),
        *[F.col("embedding")[i].cast("double").alias(f"Cells_V{i:02d}") for i in range(width)],
    )


def clean_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix that the metrics work on, of profiles with gaps where an entry is negative, a
    feature without any value, and dots in the names."""
    wide = embedding_profiles(spark, sf)
    names = cp.schema.feature_columns(wide.columns)
    gaps = [F.when(F.col(n) >= 0, F.col(n)).alias(n.replace("_V", "_V.")) for n in names]
    empty = F.lit(None).cast("double").alias("Cells_Empty")
    profiles = wide.select("Metadata_Row", F.col("Metadata_Batch").alias("Metadata_Batch.No"), *gaps, empty)
    data = pairs.prepare_profiles(profiles, ["Metadata_Batch.No"], row_id="Metadata_Row")
    rows = data.table.select("_row", F.col(pairs.label_column("Metadata_Batch.No")).alias("batch"), F.posexplode("_vec"))
    return rounded(rows.toDF("row_id", "batch", "position", "value"), 6)


def feature_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values of the features, whose names are built from their parts."""
    parts = [
        ("Cells", "AreaShape", "Area", None),
        ("Cells", "Intensity", "MeanIntensity", "DNA"),
        ("Cytoplasm", "Texture", "Contrast", "Actin"),
        ("Nuclei", "AreaShape", "Area", None),
        ("Nuclei", "Intensity", "IntegratedIntensity", "DNA"),
    ]
    named = [(cp.feature_name(*part), *part) for part in parts]
    ddl = "feature string, compartment string, family string, measurement string, channel string"
    found = rounded(cp.missingness(cells(spark, sf)), 9)
    return found.join(spark.createDataFrame(named, ddl), "feature")


def scorecard_from_path(spark: SparkSession, sf: str) -> DataFrame:
    """The scorecard of stored profiles."""
    path = cp.write_parquet(embedding_profiles(spark, sf), scratch_path(spark, "profiles"))
    return rounded(cp.benchmark_from_path(spark, path, row_id="Metadata_Row"), 6)


def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cp.benchmark(embedding_profiles(spark, sf), row_id="Metadata_Row"), 6)


# --- end to end ----------------------------------------------------------------------


def job_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The whole batch job over the site, patient, compartment, clinical and expression roles."""
    summary, _ = cp.run_from_subset(
        spark,
        roles.for_spark(spark, sf, roles.SITES),
        roles.for_spark(spark, sf, roles.PATIENTS),
        compartment_tables(spark, sf),
        roles.for_spark(spark, sf, roles.CLINICAL),
        roles.for_spark(spark, sf, roles.SNRNA),
        scratch_path(spark, "job"),
        cp.JobConfig(
            outlier_thresholds={
                "Cells_AreaShape_Area": 1.0,
                "Nuclei_Intensity_MeanIntensity_DNA": -0.5,
            }
        ),
    )
    return summary


QUERIES: dict[str, Query] = {
    "csv_roundtrip": csv_roundtrip,
    "parquet_roundtrip": parquet_roundtrip,
    "cast_to_schema": cast_to_schema,
    "validate_schema": validate_schema,
    "metadata_projection": lambda s, d: cp.metadata_frame(cells(s, d)),
    "feature_projection": lambda s, d: rounded(cp.feature_frame(cells(s, d)), 4),
    "feature_pick": feature_pick,
    "canonical_sites": canonical_sites,
    "validate_sites": validate_sites,
    "dev_subset": dev_subset,
    "dev_subset_from_csv": dev_subset_from_csv,
    "compartment_join": compartment_join,
    "attach_sites": attach_sites,
    "cells_from_csv": cells_from_csv,
    "compartment_split": compartment_split,
    "image_split": image_split,
    "compartment_csv_roundtrip": compartment_csv_roundtrip,
    "assign_balanced": assignment(0.0),
    "assign_confounded": assignment(1.0),
    "assign_mixed": assignment(0.5),
    "select_groups": select_groups,
    "select_patients": select_patients,
    "attach_missing_columns": attach_missing_columns,
    "integrate_patients": integrate_patients,
    **{f"cell_counts_{level}": cell_counts(level) for level in cp.operators.select.LEVEL_COLUMN},
    "hierarchy_summary": lambda s, d: cp.hierarchy_summary(cells(s, d)),
    "missingness": lambda s, d: rounded(cp.missingness(cells(s, d)), 9),
    "feature_parts": feature_parts,
    "feature_drift_batch": lambda s, d: rounded(cp.feature_drift(cells(s, d)), 9),
    "plate_effects": lambda s, d: rounded(cp.feature_drift(cells(s, d), "Metadata_Plate"), 9),
    "top_drift": lambda s, d: rounded(cp.top_drift(cp.feature_drift(cells(s, d)), 3), 9),
    "outlier_labels": outlier_labels,
    "outlier_summary": outlier_summary,
    "qc_report": qc_report,
    "well_profiles_median": lambda s, d: rounded(well_table(s, d), 6),
    "well_profiles_mean": lambda s, d: rounded(
        cp.aggregate_to_wells(cells(s, d), operation="mean", features=FEATURES), 9
    ),
    "well_profiles_hot": hot_wells,
    "well_profiles_mixed": mixed_wells,
    "normalize_standardize": normalized(),
    "normalize_controls": normalized(samples="Metadata_DiseaseGroup == 'BUILDING'"),
    "normalize_mad": normalized(method="mad_robustize"),
    "normalize_mad_hot": normalized(method="mad_robustize", hot_rows=LOW_HOT_ROWS),
    "normalize_controls_constant": controls_constant("standardize"),
    "normalize_controls_constant_mad": controls_constant("mad_robustize"),
    "normalize_spherize": normalize_spherize,
    "normalize_spherize_pair": normalize_spherize_pair,
    "select_variance": select_variance,
    "select_na": lambda s, d: rounded(cp.missingness(well_table(s, d), FEATURES), 9),
    "select_correlation": select_correlation,
    "select_correlation_gaps": select_correlation_gaps,
    "selected_features": selected_features,
    "consensus_median": consensus_median,
    "consensus_mean": consensus_mean,
    "consensus_modz": consensus_modz,
    "patient_profiles": patient_profiles,
    "replicate_map": metric(cp.replicate_reproducibility, "label"),
    "replicate_map_hot": metric(cp.replicate_reproducibility, "label", max_listed=8),
    "replicate_map_ranked": metric(cp.replicate_reproducibility, "label", max_listed=0),
    "silhouette_many_labels": silhouette_many_labels,
    "silhouette_cut_labels": metric(cp.silhouette, "label", chunk_rows=20),
    "silhouette": metric(cp.silhouette, "label"),
    "label_classifiability": metric(cp.label_classifiability, "label"),
    "batch_mixing": metric(cp.batch_mixing, "batch"),
    "batch_mixing_shifted": metric(cp.batch_mixing, "label", skip=1),
    "chance_level": chance_level,
    "clean_matrix": clean_matrix,
    "scorecard": scorecard,
    "scorecard_from_path": scorecard_from_path,
    "job_summary": job_summary,
}
