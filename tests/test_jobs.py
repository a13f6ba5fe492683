from __future__ import annotations

import pytest

import cellprofiles as cp

GROUPS = cp.DISEASE_GROUPS


@pytest.fixture(scope="module")
def tables(spark):
    """2 plates x 3 wells x 2 sites, 6 cells per site, 4 patients."""
    sites, cells, image = [], [], 1
    for p in (1, 2):
        for w in range(1, 4):
            for s in (1, 2):
                sites.append(("1", image, f"Plate{p}", f"A{w:02d}", s, 1, "DMSO", 0.0, "DMSO"))
                for o in range(1, 7):
                    cells.append((image, o, image * 1.5 + o, (image * o) % 7 + 0.25 * p))
                image += 1
    patients = [(f"P{i:03d}", GROUPS[i], "None", 20 + i, "F") for i in range(4)]
    clinical = [(f"P{i:03d}", 50.0 + i, 1, 40.0, i % 2 == 0, 100) for i in range(3)]
    snrna = [
        (f"P{i:03d}", kind, 100 * (k + 1), 0.25, 2500.0, 0.5)
        for i in range(4)
        for k, kind in enumerate(("Fibroblast", "Cardiomyocyte", "Endothelial", "Immune"))
    ]
    keys = "ImageNumber bigint, ObjectNumber bigint, "
    parents = ", Parent_Cells bigint, Parent_Nuclei bigint"
    compartments = {
        "Image": spark.createDataFrame(
            [(s[1], "x.tif") for s in sites], "ImageNumber bigint, Image_FileName_DNA string"
        ),
        "Cells": spark.createDataFrame(
            [(i, o, a) for i, o, a, _ in cells], keys + "AreaShape_Area double"
        ),
        "Nuclei": spark.createDataFrame(
            [(i, o, b) for i, o, _, b in cells], keys + "AreaShape_Area double"
        ),
        "Cytoplasm": spark.createDataFrame(
            [(i, o, a * b, o, o) for i, o, a, b in cells],
            keys + "Texture_Contrast_Actin double" + parents,
        ),
    }
    return {
        "sites": spark.createDataFrame(sites, cp.image_schema()),
        "patients": spark.createDataFrame(patients, cp.patient_schema()),
        "compartments": compartments,
        "clinical": spark.createDataFrame(clinical, cp.clinical_schema()),
        "snrna": spark.createDataFrame(snrna, cp.snrna_summary_schema()),
    }


def test_end_to_end(spark, tables, tmp_path):
    config = cp.JobConfig(
        outlier_thresholds={"Cells_AreaShape_Area": 1.0, "Nuclei_AreaShape_Area": 1.0},
        partition_cells_by="Metadata_Plate",
    )
    summary, out = cp.run_from_subset(spark, **tables, out_dir=str(tmp_path), config=config)
    row = summary.collect()
    assert len(row) == 1
    row = row[0]
    assert (row.n_plates, row.n_wells, row.n_cells) == (2, 6, 72)
    assert (row.n_patients, row.n_integrated_rows) == (4, 4)
    assert 1 <= row.n_features_selected <= 3
    assert 0 < row.n_outlier_cells <= row.n_outlier_flags
    cells = cp.load_single_cells(spark, out["single_cell"])
    features = cp.joined_feature_columns(cells.columns)
    assert cp.validate_schema(cells, cp.single_cell_schema(features)) == []
    assert cells.where("Metadata_PatientID IS NULL").count() == 0
    assert spark.read.parquet(out["integrated_patient"]).count() == 4
    assert spark.read.parquet(str(tmp_path / "qc_outliers.parquet")).count() == 2


def test_job_from_metadata_files(spark, tables, tmp_path):
    raw = tables["sites"].selectExpr(
        "Metadata_TableNumber AS TableNumber",
        "Metadata_ImageNumber AS ImageNumber",
        "Metadata_Plate AS Image_Metadata_Plate_DAPI",
        "Metadata_Well AS Image_Metadata_Well_DAPI",
        "Metadata_Replicate AS Replicate",
        "Metadata_Compound AS Image_Metadata_Compound",
        "Metadata_Concentration AS Image_Metadata_Concentration",
    )
    raw.write.option("header", True).csv(str(tmp_path / "image"))
    (tmp_path / "moa.csv").write_text("compound,concentration,moa\nDMSO,0,DMSO\n")
    paths = {"image": str(tmp_path / "image"), "moa": str(tmp_path / "moa.csv")}
    rest = {k: v for k, v in tables.items() if k != "sites"}
    summary, _ = cp.run_profile_job(
        spark, paths, **rest, out_dir=str(tmp_path / "out"), config=cp.JobConfig(n_plates=1)
    )
    row = summary.first()
    # Cells of the plate that was not picked keep no metadata.
    assert (row.n_plates, row.n_wells, row.n_cells, row.n_patients) == (1, 3, 72, 3)


def test_integration_is_left_and_has_no_duplicate_columns(spark, tables, tmp_path):
    morphology = spark.createDataFrame(
        [("P000", "clash", "x", 1, "F", 0.5, 1.5), ("P003", "clash", "x", 1, "F", 2.5, 3.5)],
        "Metadata_PatientID string, Metadata_DiseaseGroup string, Metadata_FailureType string, "
        "Metadata_Age int, Metadata_Sex string, Cells_A double, Nuclei_B double",
    )
    path = cp.write_parquet(tables["clinical"], str(tmp_path / "c"), schema=cp.clinical_schema())
    out = cp.integrate_multiomics(spark, tables["patients"], path, tables["snrna"], morphology)
    assert out.columns == [
        *cp.patient_schema().names,
        *cp.clinical_schema().names[1:],
        "total_nuclei",
        "fibroblast_fraction",
        "Cells_A",
        "Nuclei_B",
    ]
    rows = out.collect()
    assert [r.Metadata_PatientID for r in rows] == ["P000", "P001", "P002", "P003"]
    assert [r.Metadata_DiseaseGroup for r in rows] == list(GROUPS)
    assert [r.total_nuclei for r in rows] == [1000] * 4
    assert [r.fibroblast_fraction for r in rows] == [0.25] * 4
    assert [r.Cells_A for r in rows] == [0.5, None, None, 2.5]
    assert rows[3].ejection_fraction is None


def test_invalid_subset_stops_the_job(spark, tmp_path):
    (tmp_path / "image.csv").write_text(
        "TableNumber,ImageNumber,Image_Metadata_Plate_DAPI,Image_Metadata_Well_DAPI,Replicate,"
        "Image_Metadata_Compound,Image_Metadata_Concentration\n1,1,P,A01,1,x,-1\n"
    )
    (tmp_path / "moa.csv").write_text("compound,concentration,moa\nx,-1,y\n")
    paths = {"image": str(tmp_path / "image.csv"), "moa": str(tmp_path / "moa.csv")}
    with pytest.raises(ValueError, match="Concentration"):
        cp.prepare_dev_subset(spark, paths, str(tmp_path / "subset"))


@pytest.fixture
def scans(spark, monkeypatch):
    """How often plans that run scan a stored table with more than its row count."""
    from pyspark.sql import DataFrame, DataFrameWriter

    plans = []

    def noting(owner, name, frame):
        original = getattr(owner, name)

        def run(self, *args, **options):
            plans.append(frame(self)._jdf.queryExecution().executedPlan().toString())
            return original(self, *args, **options)

        monkeypatch.setattr(owner, name, run)

    noting(DataFrameWriter, "parquet", lambda writer: writer._df)
    noting(DataFrame, "collect", lambda frame: frame)
    noting(DataFrame, "first", lambda frame: frame)

    def count(path):
        lines = [line for plan in plans for line in plan.splitlines()]
        return sum("FileScan" in line and path in line and "ReadSchema: struct<>" not in line for line in lines)

    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    yield count
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_report_scans_the_cells_twice(spark, tables, tmp_path, scans):
    _, out = cp.run_from_subset(spark, **tables, out_dir=str(tmp_path / "job"))
    cells = spark.read.parquet(out["single_cell"])
    cells.write.parquet(str(tmp_path / "cells_for_report"))
    report = cp.qc_report(spark.read.parquet(str(tmp_path / "cells_for_report")), str(tmp_path / "report"))
    assert scans("cells_for_report") == 2
    assert {r.Metadata_Plate: r.n_cells for r in report["cell_counts_per_plate"].collect()} == {
        "Plate1": 36,
        "Plate2": 36,
    }
    direct = cp.detect_outliers(cells)[1].collect()
    assert report["outliers"].collect() == direct


def test_job_scans_the_cells_at_most_four_times(spark, tables, tmp_path, scans):
    cp.run_from_subset(spark, **tables, out_dir=str(tmp_path))
    assert 2 <= scans("single_cell.parquet") <= 4


def test_selection_scans_the_profiles_once(spark, tables, tmp_path, scans):
    rows = [(f"P{i}", float(i % 3), float(i), None if i % 2 else 1.0 * i, 2.0 * i) for i in range(60)]
    path = str(tmp_path / "profiles_to_select")
    ddl = "Metadata_PatientID string, Cells_A double, Cells_B double, Cells_Gap double, Cells_C double"
    spark.createDataFrame(rows, ddl).write.parquet(path)
    found = cp.operators.features.drop_decisions(spark.read.parquet(path))
    assert found["drop_na_columns"] == ["Cells_Gap"]
    assert "Cells_C" in found["correlation_threshold"] or "Cells_B" in found["correlation_threshold"]
    assert scans("profiles_to_select") == 1


def scratch_tables(spark):
    from pathlib import Path

    from cellprofiles.session import scratch_root

    root = Path(scratch_root(spark).removeprefix("file:"))
    return {p.name for p in root.iterdir()} if root.exists() else set()


def test_job_and_report_leave_no_scratch_tables(spark, tables, tmp_path):
    before = scratch_tables(spark)
    summary, out = cp.run_from_subset(spark, **tables, out_dir=str(tmp_path))
    assert scratch_tables(spark) == before
    assert summary.collect() == spark.read.parquet(out["summary"]).collect() and summary.first().n_cells > 0
    report = cp.qc_report(spark.read.parquet(out["single_cell"]), str(tmp_path / "report"))
    assert scratch_tables(spark) == before
    assert all(table.count() > 0 for table in report.values())
