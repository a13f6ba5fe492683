from __future__ import annotations

import pytest

import cellprofiles as cp
from cellprofiles.operators.sites import number_sites

TREATMENTS = [("DMSO", 0.0), ("taxol", 0.3), ("cytochalasin B", 1.0), ("unknownCpd", 5.0)]
RAW = (
    "TableNumber int, ImageNumber int, Image_Metadata_Plate_DAPI string, "
    "Image_Metadata_Well_DAPI string, Replicate int, Image_Metadata_Compound string, "
    "Image_Metadata_Concentration double"
)


@pytest.fixture
def raw(spark):
    rows, image = [], 1
    for plate in ("PlateB", "PlateA"):
        for w, (compound, dose) in enumerate(TREATMENTS):
            for _ in range(2):
                rows.append((1, image, plate, f"A{w + 1:02d}", 1, compound, dose))
                image += 1
    return spark.createDataFrame(rows, RAW)


@pytest.fixture
def moa(spark):
    rows = [("DMSO", 0.0, "DMSO"), ("taxol", 0.3, "Tubulin"), ("cytochalasin B", 1.0, "Actin")]
    return spark.createDataFrame(rows, "compound string, concentration double, moa string")


def test_canonical_table_conforms_and_looks_up_mechanisms(raw, moa):
    table = cp.canonicalize_image_table(raw, moa)
    assert cp.validate_schema(table, cp.image_schema()) == []
    rows = table.collect()
    assert len(rows) == 16
    known = {r.Metadata_Compound: r.Metadata_MoA for r in rows}
    assert known["taxol"] == "Tubulin" and known["unknownCpd"] is None
    assert {r.Metadata_TableNumber for r in rows} == {"1"}


def test_sites_are_numbered_by_image_within_well(raw, moa):
    by_well = {}
    for r in cp.canonicalize_image_table(raw, moa).collect():
        by_well.setdefault((r.Metadata_Plate, r.Metadata_Well), []).append(
            (r.Metadata_ImageNumber, r.Metadata_Site)
        )
    assert all([s for _, s in sorted(v)] == [1, 2] for v in by_well.values())


def test_numbering_crosses_buckets_and_skips_missing_images(spark):
    images = [5, 70_000, 65_536, 2_000_000, None, 65_535]
    rows = [("p", None, i, f"c{n}") for n, i in enumerate(images)]
    ddl = "Metadata_Plate string, Metadata_Well string, Metadata_ImageNumber int, x string"
    numbered = number_sites(spark.createDataFrame(rows, ddl)).collect()
    found = {r.Metadata_ImageNumber: r.Metadata_Site for r in numbered}
    assert found == {5: 1, 65_535: 2, 65_536: 3, 70_000: 4, 2_000_000: 5, None: None}


def test_subset_keeps_first_plate_by_name_and_known_mechanisms(raw, moa):
    subset = cp.build_dev_subset(raw, moa, n_plates=1).collect()
    assert {r.Metadata_Plate for r in subset} == {"PlateA"}
    assert len(subset) == 6
    order = [(r.Metadata_Plate, r.Metadata_Well, r.Metadata_Site) for r in subset]
    assert order == sorted(order)
    assert cp.build_dev_subset(raw, moa, n_plates=1, moa_only=False).count() == 8


def test_null_plates_take_no_place(spark, raw, moa):
    extra = spark.createDataFrame([(1, 99, None, "A01", 1, "DMSO", 0.0)], RAW)
    subset = cp.build_dev_subset(raw.union(extra), moa, n_plates=1)
    assert {r.Metadata_Plate for r in subset.collect()} == {"PlateA"}


def test_valid_table_has_no_problems(raw, moa):
    assert cp.validate_image_table(cp.build_dev_subset(raw, moa)) == []


def test_validation_finds_nulls_ranges_and_structure(spark, raw, moa):
    table = cp.canonicalize_image_table(raw, moa)
    bad = table.selectExpr(
        *[c for c in table.columns if c not in ("Metadata_Well", "Metadata_Concentration")],
        "nullif(Metadata_Well, 'A01') AS Metadata_Well",
        "Metadata_Concentration - 1 AS Metadata_Concentration",
    )
    assert cp.validate_image_table(bad) == [
        "broken 4 time(s): Metadata_Well is set",
        "broken 1 time(s): Metadata_Concentration is 0 or more",
    ]
    assert cp.validate_image_table(table.limit(0)) == ["broken 1 time(s): the table has rows"]
    missing = cp.validate_image_table(table.drop("Metadata_Site"))
    assert missing == ["columns absent: Metadata_Site"]


def test_repeated_lookups_and_sites_are_numbered_row_by_row(spark, raw, moa):
    """Every entry of the lookup gives a row; images, then the other columns, order the numbers. Copies
    of a site and entries of a treatment are numbered before they become rows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cellprofiles.operators import sites

    more = [("DMSO", 0.0, "A"), ("DMSO", 0.0, "DMSO"), ("DMSO", 0.0, None), ("taxol", 0.3, "Tubulin")]
    lookup = moa.union(spark.createDataFrame(more, moa.schema))
    extra = [(1, None, "PlateA", "A01", 1, "DMSO", 0.0), (2, 9, "PlateA", "A01", 1, "taxol", 0.3)]
    images = raw.union(raw.where("ImageNumber % 3 = 0")).union(spark.createDataFrame(extra, RAW))
    table = cp.canonicalize_image_table(images, lookup)
    rest = [c for c in table.columns if c not in ("Metadata_Site", "Metadata_ImageNumber", "Metadata_MoA")]
    order = Window.partitionBy("Metadata_Plate", "Metadata_Well").orderBy(
        F.asc_nulls_last("Metadata_ImageNumber"), *rest, "Metadata_MoA"
    )
    number = F.when(F.col("Metadata_ImageNumber").isNotNull(), F.row_number().over(order))
    want = table.withColumn("Metadata_Site", number.cast("int"))
    joined = images.join(
        lookup,
        (images.Image_Metadata_Compound == lookup.compound)
        & (images.Image_Metadata_Concentration == lookup.concentration),
        "left",
    )
    assert table.count() == joined.count()
    assert sorted(map(str, table.collect())) == sorted(map(str, want.collect()))
    distinct = images.distinct().count()
    assert sites._numbered(images, lookup).count() == distinct < joined.count()
    subset = cp.build_dev_subset(images, lookup, n_plates=1).collect()
    places = [(r.Metadata_Well, r.Metadata_Site or 0) for r in subset]
    assert places == sorted(places) and all(r.Metadata_MoA for r in subset)
    kept = table.where("Metadata_Plate = 'PlateA' AND Metadata_MoA IS NOT NULL").collect()
    assert sorted(map(str, subset)) == sorted(map(str, kept))
