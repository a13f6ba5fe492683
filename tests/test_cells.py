from __future__ import annotations

from pathlib import Path

import pytest

import cellprofiles as cp
from cellprofiles.sources.compartments import compartment_table, image_table

FEATURES = ["Cells_AreaShape_Area", "Cytoplasm_Texture_Contrast_Actin", "Nuclei_AreaShape_Area"]


@pytest.fixture
def sites(spark):
    rows = [
        (i, "P1", f"A0{i}", 1, 1, "DMSO", 0.0, None, f"P1_A0{i}", "P1", f"X{i}", "Healthy", "None", 30, "F")
        for i in range(1, 5)
    ]
    names = (
        "ImageNumber Plate Well Site Replicate Compound Concentration MoA SampleID Batch "
        "PatientID DiseaseGroup FailureType Age Sex"
    ).split()
    ddl = ", ".join(f"Metadata_{n} {cp.schema.METADATA_TYPES[f'Metadata_{n}']}" for n in names)
    return spark.createDataFrame(rows, ddl)


@pytest.fixture
def cells(spark, sites):
    rows = [(i, o, i * 10.0 + o, o / 2, 1.0 * i) for i in range(1, 5) for o in (1, 2)]
    ddl = "Metadata_ImageNumber int, Metadata_ObjectNumber int, " + ", ".join(
        f"{f} double" for f in FEATURES
    )
    return spark.createDataFrame(rows, ddl)


def test_feature_pick_drops_bookkeeping_and_sorts():
    names = ["Nuclei_B", "Image_FileName_DNA", "Cells_Number_Object_Number", "Cells_A", "Metadata_X"]
    assert cp.joined_feature_columns(names) == ["Cells_A", "Nuclei_B"]


def test_canonical_cells_have_metadata_and_types(cells, sites):
    joined = cells.selectExpr(
        "CAST(Metadata_ImageNumber AS BIGINT) AS Metadata_ImageNumber",
        "CAST(Metadata_ObjectNumber AS BIGINT) AS Metadata_ObjectNumber",
        "'x' AS Image_FileName_DNA",
        *FEATURES,
        "1 AS Cells_Number_Object_Number",
    )
    table = cp.canonical_single_cells(joined, sites)
    assert cp.validate_schema(table, cp.single_cell_schema(FEATURES)) == []
    rows = table.collect()
    assert len(rows) == 8
    assert all(r.Metadata_PatientID == f"X{r.Metadata_ImageNumber}" for r in rows)


def test_cells_of_unknown_images_stay_without_metadata(cells, sites):
    rows = cp.canonical_single_cells(cells, sites.where("Metadata_ImageNumber <> 3")).collect()
    assert len(rows) == 8
    assert sum(r.Metadata_PatientID is None for r in rows) == 2


def test_split_tables_have_parents_only_in_the_cytoplasm(cells):
    assert compartment_table(cells, "Cells").columns == [
        "ImageNumber",
        "ObjectNumber",
        "AreaShape_Area",
        "Number_Object_Number",
    ]
    assert compartment_table(cells, "Cytoplasm").columns[-2:] == ["Parent_Cells", "Parent_Nuclei"]


def test_image_table_counts_cells_per_image(cells, sites):
    few = cells.where("NOT (Metadata_ImageNumber = 2 AND Metadata_ObjectNumber = 2)")
    few = few.where("Metadata_ImageNumber <> 4")
    rows = {r.ImageNumber: r for r in image_table(few, sites.union(sites)).collect()}
    assert {i: r.Count_Cells for i, r in rows.items()} == {1: 2, 2: 1, 3: 2, 4: 0}
    assert rows[1].Image_FileName_DNA == "P1_A01_s1_DNA.tif"


def test_csv_round_trip_restores_the_cells(spark, cells, sites, tmp_path):
    directory = str(tmp_path / "csv")
    written = cp.write_compartment_csvs(cells, sites, directory)
    assert set(written) == {"Image", "Cells", "Cytoplasm", "Nuclei"}
    raw = cp.convert_compartment_csvs(spark, directory, str(tmp_path / "joined"))
    cp.convert_compartment_csvs(spark, directory, raw)  # overwrites
    joined = spark.read.parquet(raw)
    assert joined.where("Cells_Number_Object_Number <> Metadata_ObjectNumber").count() == 0
    assert {r.Image_FileName_DNA for r in joined.collect()} == {f"P1_A0{i}_s1_DNA.tif" for i in range(1, 5)}
    path = cp.build_single_cell_parquet(spark, directory, sites, str(tmp_path / "cells"))
    back = cp.load_single_cells(spark, path)
    assert sorted(back.select(cells.columns).collect()) == sorted(cells.collect())


def test_missing_compartments_leave_nulls(spark):
    def table(rows, extra=""):
        return spark.createDataFrame(rows, f"ImageNumber bigint, ObjectNumber bigint, A double{extra}")

    parents = ", Parent_Cells bigint, Parent_Nuclei bigint"
    joined = cp.join_compartments(
        {
            "Image": spark.createDataFrame([(1, "f")], "ImageNumber bigint, Image_FileName_DNA string"),
            "Cytoplasm": table([(1, 1, 0.1, 2, 1), (1, 2, 0.2, 1, None)], parents),
            "Cells": table([(1, 1, 10.0), (1, 2, 20.0), (1, 3, 30.0)]),
            "Nuclei": table([(1, 1, 5.0)]),
        }
    )
    rows = {r.Metadata_ObjectNumber: (r.Cells_A, r.Nuclei_A) for r in joined.collect()}
    assert rows == {1: (20.0, 5.0), 2: (10.0, None)}


def test_staged_joins_leave_no_shuffle_files(spark, cells, sites, tmp_path):
    """The same rows, joins that shuffle, compressed tables, and no more shuffle files than before."""

    def shuffle_files():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(files.apply(i)) for i in range(files.size()) if "shuffle" in str(files.apply(i))}

    def rows(df):
        return sorted(map(str, df.collect()))

    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    cp.write_compartment_csvs(cells, sites, plain)
    want = rows(cp.join_compartments(cp.read_compartment_csvs(spark, plain)))
    before = shuffle_files()
    written = cp.write_compartment_csvs(cells, sites, packed, compression="lz4")
    tables = cp.read_compartment_csvs(spark, packed)
    # Without file names the last join is stored as well, and nothing is left to be shuffled.
    joined = cp.join_compartments(tables, file_names=False, staged=True)
    assert shuffle_files() <= before
    assert joined.count() == 8 and len(want) == 8
    staged = cp.join_compartments(tables, staged=True)
    assert "Broadcast" not in staged._jdf.queryExecution().executedPlan().toString()
    assert rows(staged) == want
    assert all(list(Path(path).glob("*.csv.lz4")) for path in written.values())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
