from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import cellprofiles as cp
from cellprofiles.operators.features import (
    correlated_features,
    low_variance_features,
    missing_features,
)

N_FEATURES = 6
FEATURES = [f"Cells_F{i}" for i in range(N_FEATURES)]


@pytest.fixture(scope="module")
def values():
    return np.random.default_rng(1).normal(5.0, 2.0, (80, N_FEATURES)).round(3)


@pytest.fixture(scope="module")
def cells(spark, values):
    """8 wells of 10 cells, two wells per patient."""
    rows = []
    for i, value in enumerate(values):
        well, patient = i // 10, i // 20
        moa = "DMSO" if well % 2 else None
        rows.append(
            (f"P{patient}", f"S{well}", "Plate1", f"A{well}", "Plate1", "Healthy", "None", 30, "F", moa, i, *map(float, value))
        )
    ddl = (
        "Metadata_PatientID string, Metadata_SampleID string, Metadata_Plate string, Metadata_Well "
        "string, Metadata_Batch string, Metadata_DiseaseGroup string, Metadata_FailureType string, "
        "Metadata_Age int, Metadata_Sex string, Metadata_MoA string, Metadata_ObjectNumber int, "
    ) + ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, ddl)


def matrix(df, names=FEATURES, by="Metadata_SampleID"):
    return np.array([[r[n] for n in names] for r in df.orderBy(by).collect()], dtype=float)


@pytest.fixture(scope="module")
def wells(cells):
    return cp.aggregate_to_wells(cells).cache()


@pytest.mark.parametrize("operation,function", [("median", np.median), ("mean", np.mean)])
def test_wells_aggregate_their_cells(cells, values, operation, function):
    out = cp.aggregate_to_wells(cells, operation=operation)
    assert out.columns[10:11] == ["Metadata_Object_Count"]
    assert {r.Metadata_Object_Count for r in out.collect()} == {10}
    expected = np.array([function(values[i : i + 10], axis=0) for i in range(0, 80, 10)])
    assert matrix(out) == pytest.approx(expected)
    with pytest.raises(ValueError):
        cp.aggregate_to_wells(cells, operation="mode")


def test_nan_is_missing_and_null_strata_are_a_group(spark):
    df = spark.createDataFrame(
        [(None, 1.0), (None, float("nan")), (None, 3.0), ("w", float("nan"))],
        "Metadata_Well string, Cells_A double",
    )
    rows = cp.aggregate_to_wells(df).collect()
    assert {(r[0], r[1], r[2]) for r in rows} == {(None, 3, 2.0), ("w", 1, None)}


def test_standardize(wells):
    out = matrix(cp.normalize_profiles(wells))
    assert out.mean(axis=0) == pytest.approx(np.zeros(N_FEATURES), abs=1e-12)
    assert out.std(axis=0) == pytest.approx(np.ones(N_FEATURES))


def test_standardize_on_controls(wells):
    raw = matrix(wells)
    controls = raw[1::2]
    out = matrix(cp.normalize_profiles(wells, samples="Metadata_MoA == 'DMSO'"))
    assert out == pytest.approx((raw - controls.mean(axis=0)) / controls.std(axis=0))


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_mad_robustize(wells, hot_rows):
    raw = matrix(wells)
    center = np.median(raw, axis=0)
    scale = 1.4826 * np.median(np.abs(raw - center), axis=0)
    out = matrix(cp.normalize_profiles(wells, method="mad_robustize", hot_rows=hot_rows))
    assert out == pytest.approx((raw - center) / scale)


@pytest.mark.parametrize("method", ["standardize", "mad_robustize"])
def test_constant_features_become_zero_and_gaps_stay(spark, method):
    df = spark.createDataFrame(
        [("a", 2.0, 1.0), ("b", 2.0, None), ("c", None, 5.0)],
        "Metadata_W string, Cells_C double, Cells_X double",
    )
    rows = {r[0]: (r[1], r[2]) for r in cp.normalize_profiles(df, method=method).collect()}
    assert rows["a"][0] == 0.0 and rows["c"][0] is None and rows["b"][1] is None


@pytest.mark.parametrize("method", ["standardize", "mad_robustize"])
def test_rows_unlike_constant_controls_keep_their_distance(spark, method):
    rows = [("DMSO", 1.0), ("DMSO", 1.0), ("drug", 5.0), ("drug", 9.0)]
    df = spark.createDataFrame(rows, "Metadata_MoA string, Cells_X double")
    out = cp.normalize_profiles(df, method=method, samples="Metadata_MoA = 'DMSO'").collect()
    values = [r.Cells_X for r in out]
    assert values[:2] == [0.0, 0.0] and values[3] == pytest.approx(2 * values[2])
    assert values[2] == 4.0 if method == "standardize" else values[2] > 1e15


def test_names_with_special_characters(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "Metadata_Well string, `Cells_A.b` double")
    assert cp.normalize_profiles(df).collect() == [("a", -1.0), ("b", 1.0)]
    assert sorted(cp.aggregate_to_wells(df).collect()) == [("a", 1, 1.0), ("b", 1, 3.0)]
    assert sorted(cp.aggregate_to_wells(df, hot_rows=0).collect()) == [("a", 1, 1.0), ("b", 1, 3.0)]
    assert cp.missingness(df).first().feature == "Cells_A.b"
    assert cp.detect_outliers(df, thresholds={"Cells_A.b": 0.5})[1].first().n_outliers == 1


def test_spherize_whitens(cells, values):
    out = matrix(cp.normalize_profiles(cells, method="spherize"), by="Metadata_ObjectNumber")
    assert np.cov(out.T, ddof=0) == pytest.approx(np.eye(N_FEATURES), abs=1e-4)
    # Standardised values times the inverse square root of their correlation.
    eigen, basis = np.linalg.eigh(np.corrcoef(values.T))
    standard = (values - values.mean(axis=0)) / values.std(axis=0)
    expected = standard @ (basis / np.sqrt(eigen + 1e-6)) @ basis.T
    assert out == pytest.approx(expected, abs=1e-8)
    # The unit of a feature does not matter.
    units = {f: F.col(f) * 10.0 ** (4 * i - 8) for i, f in enumerate(FEATURES)}
    scaled = cp.normalize_profiles(cells.withColumns(units), method="spherize")
    assert matrix(scaled, by="Metadata_ObjectNumber") == pytest.approx(out, abs=1e-6)


def test_spherize_with_gaps_and_unknown_method(spark, cells):
    gap = F.when(F.col("Metadata_ObjectNumber") != 5, F.col("Cells_F0"))
    gappy = cells.withColumn("Cells_F0", gap)
    with pytest.raises(ValueError, match="Cells_F0"):
        cp.normalize_profiles(gappy, method="spherize")
    out = cp.normalize_profiles(gappy, method="spherize", impute=True)
    assert all(r[f] is not None for r in out.collect() for f in FEATURES)
    with pytest.raises(ValueError):
        cp.normalize_profiles(cells, method="magic")


@pytest.fixture(scope="module")
def trimmed(cells):
    i = F.col("Metadata_ObjectNumber")
    return cells.withColumns(
        {
            "Cells_Constant": F.lit(1.0),
            "Cells_NearlyConstant": F.when(i == 0, 9.0).otherwise(1.0),
            "Cells_Copy": F.col("Cells_F0") * 2.0 + F.col("Cells_F1") * 0.01,
            "Cells_Gappy": F.when(i < 70, F.col("Cells_F2") * F.col("Cells_F3")),
            "Cells_Empty": F.lit(None).cast("double"),
        }
    )


def test_each_selection_operation(trimmed):
    assert low_variance_features(trimmed) == ["Cells_Constant", "Cells_Empty", "Cells_NearlyConstant"]
    assert missing_features(trimmed) == ["Cells_Empty", "Cells_Gappy"]
    copies = correlated_features(trimmed, [*FEATURES, "Cells_Copy", "Cells_Constant"])
    assert len(copies) == 1 and copies[0] in ("Cells_F0", "Cells_Copy")
    # Gaps elsewhere change nothing: a pair is judged on the rows that have both.
    assert correlated_features(trimmed) == copies


def test_selection_keeps_metadata_and_good_features(trimmed, wells):
    kept = cp.select_features(trimmed, operations=["variance_threshold", "drop_na_columns"])
    assert set(kept.columns) == set(trimmed.columns) - {
        "Cells_Constant",
        "Cells_Empty",
        "Cells_NearlyConstant",
        "Cells_Gappy",
    }
    # Eight independent wells: the defaults must leave at least one feature.
    left = [c for c in cp.select_features(wells).columns if c in FEATURES]
    assert 1 <= len(left) <= N_FEATURES
    with pytest.raises(ValueError):
        cp.select_features(wells, operations=["astrology"])


def test_consensus_collapses_to_patients(wells):
    raw = matrix(wells)
    pairs = raw.reshape(4, 2, N_FEATURES)
    out = cp.consensus_profiles(wells)
    assert out.columns[:5] == [
        "Metadata_PatientID",
        "Metadata_DiseaseGroup",
        "Metadata_FailureType",
        "Metadata_Age",
        "Metadata_Sex",
    ]
    assert matrix(out, by="Metadata_PatientID") == pytest.approx(np.median(pairs, axis=1))
    mean = cp.consensus_profiles(wells, operation="mean", replicate_columns=["Metadata_PatientID"])
    assert matrix(mean, by="Metadata_PatientID") == pytest.approx(pairs.mean(axis=1))
    with pytest.raises(ValueError):
        cp.consensus_profiles(wells, operation="guess")


def ranks(row):
    return np.array([(np.sum(row < v) + 1 + np.sum(row <= v)) / 2 for v in row])


def test_modz_weighs_replicates_by_agreement(spark):
    rng = np.random.default_rng(5)
    sizes = {"a": 1, "b": 2, "c": 5}
    rows = [
        (g, *map(float, rng.integers(0, 6, N_FEATURES))) for g, n in sizes.items() for _ in range(n)
    ]
    rows.append(("c", *[2.0] * N_FEATURES))  # a profile without any order
    ddl = "Metadata_PatientID string, " + ", ".join(f"{f} double" for f in FEATURES)
    out = cp.consensus_profiles(spark.createDataFrame(rows, ddl), operation="modz")
    found = {r[0]: np.array(r[1:]) for r in out.collect()}
    for group in sizes:
        x = np.array([r[1:] for r in rows if r[0] == group])
        weights = []
        for p in range(len(x)):
            r = []
            for q in range(len(x)):
                if p != q:
                    a, b = ranks(x[p]), ranks(x[q])
                    flat = a.std() == 0 or b.std() == 0
                    r.append(0.0 if flat else np.corrcoef(a, b)[0, 1])
            weights.append(max(np.mean(r) if r else 0.0, 0.01))
        weights = np.array(weights) / np.sum(weights)
        assert found[group] == pytest.approx(weights @ x)


def test_patient_profiles_job(spark, cells, tmp_path):
    built = cp.build_patient_profiles(cells, str(tmp_path))
    assert list(built) == ["well_profiles", "normalized", "selected", "patient_profiles"]
    assert built["well_profiles"].count() == 8
    assert built["patient_profiles"].count() == 4
    assert spark.read.parquet(str(tmp_path / "well_profiles.parquet")).count() == 8
    assert spark.read.parquet(str(tmp_path / "morphology_profile.parquet")).count() == 4
    unsaved = cp.build_patient_profiles(cells, method="mad_robustize")
    assert unsaved["patient_profiles"].count() == 4
