from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

import cellprofiles as cp
from cellprofiles import schema


def test_columns_split_by_prefix_in_order():
    names = ["Cells_A", "Metadata_Plate", "Nuclei_B", "Metadata_Well"]
    assert cp.partition_columns(names) == (
        ["Metadata_Plate", "Metadata_Well"],
        ["Cells_A", "Nuclei_B"],
    )


def test_feature_name_with_and_without_channel():
    assert cp.feature_name("Nuclei", "AreaShape", "Area") == "Nuclei_AreaShape_Area"
    assert cp.feature_name("Cells", "Intensity", "Mean", "DNA") == "Cells_Intensity_Mean_DNA"


def test_single_cell_schema_deduplicates_and_appends_features():
    built = cp.single_cell_schema(["Cells_A"])
    assert len(built) == 16 + 1
    assert built.names.count("Metadata_Plate") == 1
    assert built["Cells_A"].dataType == T.DoubleType()
    assert built["Metadata_Age"].dataType == T.IntegerType()


def test_schema_builders_reject_bad_names():
    with pytest.raises(ValueError):
        cp.single_cell_schema(["Metadata_Sneaky"])
    with pytest.raises(KeyError):
        cp.single_cell_schema([], ["Metadata_Unheard"])


def test_table_schemas_have_their_columns():
    assert len(cp.image_schema()) == 9
    assert cp.patient_schema().names == list(schema.PATIENT_COLUMNS)
    assert cp.profile_schema(["Cells_A"]).names[-2:] == ["Metadata_CellCount", "Cells_A"]
    assert cp.clinical_schema()["on_beta_blocker"].dataType == T.BooleanType()
    assert len(cp.snrna_summary_schema()) == 6


def test_validation_reports_each_kind_of_problem(spark):
    table = spark.createDataFrame([("p", 1)], "Metadata_PatientID string, Metadata_Age bigint")
    table = table.selectExpr("*", "1.0D AS extra")
    problems = cp.validate_schema(table, cp.patient_schema())
    assert any("absent" in p and "Metadata_Sex" in p for p in problems)
    assert "of another type: Metadata_Age: bigint instead of int" in problems
    assert "not in the schema: extra" in problems
    lenient = cp.validate_schema(table, cp.patient_schema(), allow_extra_columns=True)
    assert len(lenient) == len(problems) - 1
    with pytest.raises(cp.SchemaValidationError):
        cp.require_schema(table, cp.patient_schema())


def test_cast_orders_converts_and_keeps_or_drops_extras(spark):
    table = spark.createDataFrame([(2.0, "x", 7)], "b double, extra string, a bigint")
    wanted = T.StructType.fromDDL("a string, b int")
    assert cp.cast_to_schema(table, wanted).collect() == [("7", 2)]
    kept = cp.cast_to_schema(table, wanted, allow_extra_columns=True)
    assert kept.columns == ["a", "b", "extra"]
    with pytest.raises(cp.SchemaValidationError):
        cp.cast_to_schema(table, T.StructType.fromDDL("missing int"))


def test_cast_refuses_to_lose_a_fraction(spark):
    table = spark.createDataFrame([(1.5,)], "a double")
    with pytest.raises(PySparkException):
        cp.cast_to_schema(table, T.StructType.fromDDL("a int")).collect()
    large = spark.createDataFrame([(2**53 + 1,)], "a bigint")
    with pytest.raises(PySparkException):
        cp.cast_to_schema(large, T.StructType.fromDDL("a double")).collect()
    third = spark.createDataFrame([(1 / 3,)], "a double")
    with pytest.raises(PySparkException):
        cp.cast_to_schema(third, T.StructType.fromDDL("a float")).collect()
    nothing = spark.createDataFrame([(None,)], "a double")
    assert cp.cast_to_schema(nothing, T.StructType.fromDDL("a int")).collect() == [(None,)]


def test_partitioned_cells_come_back_with_registered_types(spark, tmp_path):
    cells = spark.createDataFrame(
        [("007", "A01", 1, 1.5), ("008", "A02", 2, None)],
        "Metadata_Plate string, Metadata_Well string, Metadata_ImageNumber int, Cells_A double",
    )
    path = str(tmp_path / "cells")
    cp.write_parquet(cells, path, partition_by="Metadata_Plate")
    back = cp.load_single_cells(spark, path)
    assert back.columns == cells.columns
    assert sorted(back.collect()) == sorted(cells.collect())


def test_csv_is_read_by_name_with_types(spark, tmp_path):
    (tmp_path / "moa.csv").write_text("moa,concentration,compound,note\nActin,0.3,taxol,x\n,1,y,\n")
    read = cp.load_metadata_csvs(spark, {"moa": str(tmp_path / "moa.csv")})["moa"]
    assert read.columns == ["compound", "concentration", "moa"]
    assert read.collect() == [("taxol", 0.3, "Actin"), ("y", 1.0, None)]
    with pytest.raises(cp.SchemaValidationError):
        cp.read_csv(spark, str(tmp_path / "moa.csv"), T.StructType.fromDDL("absent int"))
