from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import cellprofiles as cp
from cellprofiles.operators.qc import drift_from_moments, feature_moments, missingness_from_moments

FEATURES = [
    "Nuclei_AreaShape_Area",
    "Cells_AreaShape_Area",
    "Nuclei_Intensity_IntegratedIntensity_DNA",
    "Cells_Texture_Contrast_DNA",
    "Cells_Shifted",
]


@pytest.fixture(scope="module")
def frame():
    """Two plates of 80 cells with a planted shift, four giants and one gap."""
    rng = np.random.default_rng(0)
    values = rng.normal(10.0, 1.0, (160, 5))
    values[80:, 4] += 5.0
    values[:4, 0] = 5000.0
    values[10, 3] = np.nan
    return values


@pytest.fixture(scope="module")
def cells(spark, frame):
    rows = []
    for i, value in enumerate(frame):
        plate = "PlateA" if i < 80 else "PlateB"
        well = f"A{i % 4:02d}"
        rows.append((plate, plate, well, f"{plate}_{well}", f"P{i % 4}", "Healthy", *map(float, value)))
    names = ["Plate", "Batch", "Well", "SampleID", "PatientID", "DiseaseGroup"]
    ddl = ", ".join(f"Metadata_{n} string" for n in names)
    ddl += ", " + ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, ddl)


def test_missingness_finds_the_gap(cells):
    rows = cp.missingness(cells).collect()
    assert len(rows) == 5
    assert tuple(rows[0]) == ("Cells_Texture_Contrast_DNA", 1, 1 / 160)
    assert all(r.n_missing == 0 for r in rows[1:])
    assert [r.fraction_missing for r in cp.missingness(cells.limit(0)).collect()] == [0.0] * 5


def test_drift_matches_its_definition(cells, frame):
    rows = cp.feature_drift(cells).collect()
    assert rows[0].feature == "Cells_Shifted"
    means = np.array([np.nanmean(half, axis=0) for half in (frame[:80], frame[80:])])
    expected = dict(zip(FEATURES, means.std(axis=0) / np.nanstd(frame, axis=0)))
    assert {r.feature: r.drift_score for r in rows} == pytest.approx(expected, rel=1e-9)
    assert [r.feature for r in cp.top_drift(cp.feature_drift(cells), 2).collect()] == [
        r.feature for r in rows[:2]
    ]


def test_constant_features_and_null_groups(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0), ("a", 1.0, 3.0), ("b", 1.0, 5.0), (None, 1.0, 100.0)],
        "Metadata_Batch string, Cells_Constant double, Cells_X double",
    )
    scores = {r.feature: r.drift_score for r in cp.feature_drift(df).collect()}
    assert scores["Cells_Constant"] == 0.0
    assert scores["Cells_X"] == pytest.approx(np.std([2.0, 5.0]) / np.std([1, 3, 5, 100]))


def test_moments_of_a_finer_grain_give_the_same(cells):
    moments = feature_moments(cells, ["Metadata_Batch", "Metadata_Well"])
    coarse = {r.feature: r.drift_score for r in cp.feature_drift(cells).collect()}
    fine = drift_from_moments(moments, "Metadata_Batch").collect()
    assert {r.feature: r.drift_score for r in fine} == pytest.approx(coarse, rel=1e-9)
    assert missingness_from_moments(moments).collect() == cp.missingness(cells).collect()


def test_giants_are_flagged(cells):
    labeled, summary = cp.detect_outliers(cells)
    flagged = labeled.where("cqc_is_outlier")
    assert flagged.where("Nuclei_AreaShape_Area = 5000").count() == 4
    assert labeled.columns == [*cells.columns, "cqc_is_outlier"]
    rows = {r.feature: r for r in summary.collect()}
    assert len(rows) == 3 and rows["Nuclei_AreaShape_Area"].n_outliers == 4
    assert rows["Nuclei_AreaShape_Area"].fraction_outliers == 4 / 160


def test_thresholds_may_be_negative_absent_or_empty(cells):
    _, low = cp.detect_outliers(cells, thresholds={"Cells_Shifted": -1.0, "No_Such": 1.0})
    row = low.collect()
    assert len(row) == 1 and row[0].n_outliers > 0
    labeled, nothing = cp.detect_outliers(cells, thresholds={"No_Such": 1.0})
    assert nothing.count() == 0 and labeled.where("cqc_is_outlier").count() == 0
    _, default = cp.detect_outliers(cells, thresholds={})
    assert default.count() == 3


def test_missing_values_and_constant_features_flag_nothing(spark):
    df = spark.createDataFrame(
        [(1.0, None), (1.0, float("nan")), (1.0, 2.0)],
        "Cells_AreaShape_Area double, Nuclei_AreaShape_Area double",
    )
    labeled, summary = cp.detect_outliers(df)
    assert labeled.where("cqc_is_outlier IS NULL OR cqc_is_outlier").count() == 0
    assert summary.agg(F.sum("n_outliers")).first()[0] == 0


def test_report_has_seven_tables_and_writes_them(spark, cells, tmp_path):
    report = cp.qc_report(cells, str(tmp_path))
    assert list(report) == [
        "cell_counts_per_well",
        "cell_counts_per_plate",
        "cell_counts_per_disease",
        "missingness",
        "feature_drift_by_batch",
        "plate_effects",
        "outliers",
    ]
    for name, table in report.items():
        stored = spark.read.parquet(str(tmp_path / f"qc_{name}.parquet"))
        assert stored.count() == table.count() > 0
    assert report["cell_counts_per_plate"].collect() == [("PlateA", 80), ("PlateB", 80)]
    assert report["feature_drift_by_batch"].first().feature == "Cells_Shifted"
