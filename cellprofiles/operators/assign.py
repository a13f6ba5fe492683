"""Assignment of wells to patients, balanced or confounded with the plate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import hash_draw
from ..functions.ranking import global_row_index
from ..schema import DISEASE_GROUPS
from ..session import materialize
from ..sources.tables import as_table

_PLATE, _WELL = "Metadata_Plate", "Metadata_Well"
_DRAW_DIGITS = 12


def assign_patients(
    image_table: DataFrame,
    patient_table: DataFrame | str,
    *,
    seed: int = 0,
    disease_plate_confounding: float = 0.0,
    disease_order: Sequence[str] = DISEASE_GROUPS,
) -> DataFrame:
    """Add sample, batch and patient columns to every site.

    Each distinct (plate, well) is a sample and goes to one patient; patients count in the
    order of their ID, wells in the order of (plate, well).

    * Without confounding, well number i goes to patient i modulo the number of patients.
    * With confounding 1, every disease has a home plate (its place in ``disease_order``
      modulo the number of plates) and the wells of a plate cycle over the patients at
      home there, or over all patients where nobody is.
    * In between, each well takes the second way with that probability. The draw is a
      hash of (plate, well, seed), the same in every run.

    Rows with a NULL plate get no patient. The numbering steps write small tables of
    wells and patients to the scratch folder, so this function runs jobs.
    """
    if not 0.0 <= disease_plate_confounding <= 1.0:
        raise ValueError("disease_plate_confounding is a probability")
    patients = as_table(image_table.sparkSession, patient_table)
    people = global_row_index(patients, ["Metadata_PatientID"], "_person")
    n_people = people.count()
    if n_people == 0:
        raise ValueError("the patient table is empty")

    pairs = image_table.select(_PLATE, _WELL).where(F.col(_PLATE).isNotNull()).distinct()
    wells = global_row_index(pairs, [_PLATE, _WELL], "_index")
    person: Column = F.pmod(F.col("_index"), F.lit(n_people))
    if disease_plate_confounding > 0.0:
        wells, home = _home_person(wells, people, n_people, disease_order)
        if disease_plate_confounding < 1.0:
            # The leading hex digits as a fraction of their range.
            head = F.substring(hash_draw(seed, _PLATE, _WELL), 1, _DRAW_DIGITS)
            draw = F.conv(head, 16, 10).cast("double") / float(16**_DRAW_DIGITS)
            chosen = draw < disease_plate_confounding
            person = F.when(chosen, home).otherwise(person)
        else:
            person = home
    samples = (
        wells.withColumn("_person", person)
        .join(people, "_person", "left")
        .select(
            _PLATE,
            _WELL,
            F.concat(_PLATE, F.lit("_"), _WELL).alias("Metadata_SampleID"),
            F.col(_PLATE).alias("Metadata_Batch"),
            *patients.columns,
        )
    )
    added = [c for c in samples.columns if c not in (_PLATE, _WELL)]
    joined = image_table.join(samples, [_PLATE, _WELL], "left")
    return joined.select(*image_table.columns, *added)


def _home_person(
    wells: DataFrame, people: DataFrame, n_people: int, disease_order: Sequence[str]
) -> tuple[DataFrame, Column]:
    """``wells`` with the patient each well gets under full confounding."""
    plates = wells.groupBy(_PLATE).agg(F.min("_index").alias("_first"))
    plates = materialize(global_row_index(plates, [_PLATE], "_plate"), "plates")
    n_plates = plates.count()

    # One entry per disease: its home plate. Unknown diseases have no home.
    home = F.coalesce(
        *[
            F.when(F.col("Metadata_DiseaseGroup") == group, F.lit(i % max(n_plates, 1)))
            for i, group in enumerate(disease_order)
        ]
    )
    homed = people.select("_person", home.alias("_plate")).where(F.col("_plate").isNotNull())
    members = global_row_index(homed, ["_plate", "_person"], "_row")
    homes = members.groupBy("_plate").agg(
        F.min("_row").alias("_start"), F.count("*").alias("_members")
    )
    plates = plates.join(homes, "_plate", "left")

    turn = F.col("_index") - F.col("_first")
    located = wells.join(plates, _PLATE).withColumn(
        "_row", F.col("_start") + F.pmod(turn, F.col("_members"))
    )
    located = located.join(members.select("_row", F.col("_person").alias("_home")), "_row", "left")
    person = F.coalesce("_home", F.pmod(turn, F.lit(n_people)))
    return located, person
