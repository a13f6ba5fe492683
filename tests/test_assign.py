from __future__ import annotations

from collections import Counter

import pytest

import cellprofiles as cp

GROUPS = cp.DISEASE_GROUPS


@pytest.fixture
def sites(spark):
    rows = [
        ("1", 10 * p + w, f"Plate{p}", f"A{w:02d}", 1, 1, "DMSO", 0.0, "DMSO")
        for p in (2, 1)
        for w in range(1, 5)
    ]
    return spark.createDataFrame(rows, cp.image_schema())


def patients(spark, n):
    rows = [(f"P{i:03d}", GROUPS[i % 4], "None", 20 + i, "F") for i in range(n)]
    return spark.createDataFrame(rows, cp.patient_schema())


def test_balanced_assignment_is_round_robin_over_sorted_wells(spark, sites):
    out = cp.assign_patients(sites, patients(spark, 4)).collect()
    assert len(out) == 8
    assert Counter(r.Metadata_PatientID for r in out) == {f"P{i:03d}": 2 for i in range(4)}
    where = {(r.Metadata_Plate, r.Metadata_Well): r.Metadata_PatientID for r in out}
    assert where["Plate1", "A01"] == "P000" and where["Plate2", "A02"] == "P001"
    row = out[0]
    assert row.Metadata_SampleID == f"{row.Metadata_Plate}_{row.Metadata_Well}"
    assert row.Metadata_Batch == row.Metadata_Plate


def test_round_robin_continues_across_plates(spark, sites):
    out = cp.assign_patients(sites, patients(spark, 3)).collect()
    where = {(r.Metadata_Plate, r.Metadata_Well): r.Metadata_PatientID for r in out}
    wells = [(f"Plate{p}", f"A{w:02d}") for p in (1, 2) for w in range(1, 5)]
    assert [where[w] for w in wells] == [f"P{i % 3:03d}" for i in range(8)]


def test_full_confounding_separates_diseases_by_plate(spark, sites):
    out = cp.assign_patients(sites, patients(spark, 4), disease_plate_confounding=1.0)
    groups = {}
    for r in out.collect():
        groups.setdefault(r.Metadata_Plate, []).append(r.Metadata_DiseaseGroup)
    assert Counter(groups["Plate1"]) == {GROUPS[0]: 2, GROUPS[2]: 2}
    assert Counter(groups["Plate2"]) == {GROUPS[1]: 2, GROUPS[3]: 2}


def test_plate_without_home_patients_uses_all(spark, sites):
    out = cp.assign_patients(sites, patients(spark, 1), disease_plate_confounding=1.0)
    assert {r.Metadata_PatientID for r in out.collect()} == {"P000"}


def test_partial_confounding_is_repeatable_and_seeded(spark, sites):
    def draw(seed):
        out = cp.assign_patients(
            sites, patients(spark, 4), seed=seed, disease_plate_confounding=0.5
        )
        return sorted((r.Metadata_ImageNumber, r.Metadata_PatientID) for r in out.collect())

    assert draw(1) == draw(1)
    assert len({tuple(draw(s)) for s in range(4)}) > 1


def test_bad_arguments_are_rejected(spark, sites):
    with pytest.raises(ValueError):
        cp.assign_patients(sites, patients(spark, 2), disease_plate_confounding=1.5)
    with pytest.raises(ValueError):
        cp.assign_patients(sites, patients(spark, 2).limit(0))
