from __future__ import annotations

import pytest

import cellprofiles as cp


@pytest.fixture
def cells(spark):
    rows = [
        (f"Plate{p}", f"A0{w}", f"P{w}", f"Plate{p}_A0{w}", "Healthy" if w == 1 else "Stable SV", p * 10 + w, o, 1.0, 2.0)
        for p in (1, 2)
        for w in (1, 2)
        for o in (1, 2, 3)
    ]
    return spark.createDataFrame(
        rows,
        "Metadata_Plate string, Metadata_Well string, Metadata_PatientID string, Metadata_SampleID "
        "string, Metadata_DiseaseGroup string, Metadata_ImageNumber int, Metadata_ObjectNumber int, "
        "Cells_A double, Nuclei_B double",
    )


def test_projections(cells):
    assert cp.feature_frame(cells).columns == ["Cells_A", "Nuclei_B"]
    assert len(cp.metadata_frame(cells).columns) == 7


def test_group_filters_take_one_or_many(cells):
    assert cp.select_disease_groups(cells, "Healthy").count() == 6
    assert cp.select_disease_groups(cells, ["Healthy", "Stable SV"]).count() == 12
    assert cp.select_patients(cells, ["P2", "P9"]).count() == 6


def test_counts_by_level(cells):
    assert cp.cell_counts(cells).collect() == [("P1", 6), ("P2", 6)]
    assert cp.cell_counts(cells, "well").collect() == [("A01", 6), ("A02", 6)]
    assert [r.n_cells for r in cp.cell_counts(cells, "sample").collect()] == [3, 3, 3, 3]
    with pytest.raises(ValueError):
        cp.cell_counts(cells, "galaxy")


def test_counts_leave_null_keys_out(cells):
    holes = cells.selectExpr("nullif(Metadata_PatientID, 'P1') AS Metadata_PatientID")
    assert cp.cell_counts(holes).collect() == [("P2", 6)]


def test_hierarchy_summary(cells):
    assert cp.hierarchy_summary(cells).first().asDict() == {
        "n_patients": 2,
        "n_samples": 4,
        "n_plates": 2,
        "n_wells": 4,
        "n_cells": 12,
    }
    assert cp.hierarchy_summary(cells, approximate=True).first().n_wells == 4


def test_enrichment_adds_only_missing_columns(spark, cells, tmp_path):
    patients = spark.createDataFrame(
        [("P1", "overwritten?", 30)],
        "Metadata_PatientID string, Metadata_DiseaseGroup string, Metadata_Age int",
    )
    joined = cp.attach_patient_metadata(cells, patients)
    assert joined.columns == [*cells.columns, "Metadata_Age"]
    rows = joined.collect()
    assert len(rows) == 12
    assert {(r.Metadata_PatientID, r.Metadata_Age) for r in rows} == {("P1", 30), ("P2", None)}
    assert "overwritten?" not in {r.Metadata_DiseaseGroup for r in rows}
    path = cp.write_parquet(patients, str(tmp_path / "patients"))
    assert sorted(cp.attach_patient_metadata(cells, path).collect(), key=str) == sorted(rows, key=str)
