"""Per-compartment measurement tables: read, join, split and write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHANNELS, COMPARTMENTS, feature_columns
from ..session import materialize_in_turn, shuffles_deleted

# Bookkeeping columns of the compartment tables.
IMAGE_KEY = "ImageNumber"
OBJECT_KEY = "ObjectNumber"
OBJECT_COUNTER = "Number_Object_Number"
PARENT_COLUMNS = {"Cells": "Parent_Cells", "Nuclei": "Parent_Nuclei"}
CENTRAL_COMPARTMENT = "Cytoplasm"

_LONG_COLUMNS = {IMAGE_KEY, OBJECT_KEY, OBJECT_COUNTER, *PARENT_COLUMNS.values()}


def read_compartment_csvs(
    spark: SparkSession, csv_dir: str, *, suffix: str = ".csv"
) -> dict[str, DataFrame]:
    """``Image`` and the compartments from ``csv_dir``, keys as long, measurements as
    double, image columns other than the key as text."""
    tables = {}
    for name in ("Image", *COMPARTMENTS):
        raw = spark.read.option("header", True).csv(f"{csv_dir.rstrip('/')}/{name}{suffix}")
        other = "string" if name == "Image" else "double"
        tables[name] = raw.select(
            *[
                F.col(f"`{c}`").cast("long" if c in _LONG_COLUMNS else other).alias(c)
                for c in raw.columns
            ]
        )
    return tables


def join_compartments(
    tables: Mapping[str, DataFrame], *, file_names: bool = True, staged: bool = False
) -> DataFrame:
    """One row per cytoplasm with its cell, its nucleus and the file names of its image.

    All joins are left joins from the cytoplasm. Cells and nuclei match on (image, parent
    object); the two-part key also spreads an image with very many objects over tasks.
    Without ``file_names`` the image table is not needed, which saves a shuffle of the
    joined rows. ``staged`` stores the rows after each compartment, so that the disk holds the shuffle
    files of one join and not of all.
    """
    image, parent = "Metadata_ImageNumber", "_parent"

    def renamed(name: str) -> DataFrame:
        table = tables[name]
        own = {IMAGE_KEY, OBJECT_KEY, *PARENT_COLUMNS.values()}
        measured = [F.col(c).alias(f"{name}_{c}") for c in table.columns if c not in own]
        return table.select(
            F.col(IMAGE_KEY).alias(image), F.col(OBJECT_KEY).alias(parent), *measured
        )

    central = tables[CENTRAL_COMPARTMENT]
    joined = central.select(
        F.col(IMAGE_KEY).alias(image),
        F.col(OBJECT_KEY).alias("Metadata_ObjectNumber"),
        *[
            F.col(c).alias(f"{CENTRAL_COMPARTMENT}_{c}")
            for c in central.columns
            if c not in (IMAGE_KEY, OBJECT_KEY, *PARENT_COLUMNS.values())
        ],
        *PARENT_COLUMNS.values(),
    )
    for name, reference in PARENT_COLUMNS.items():
        side = renamed(name).withColumnRenamed(parent, reference)
        # Stored and compressed tables look smaller than they are, so that Spark would broadcast them.
        side = side.hint("merge") if staged else side
        joined = joined.join(side, [image, reference], "left")
        if staged:
            joined = materialize_in_turn(joined.sparkSession, [joined], "joined")
    joined = joined.drop(*PARENT_COLUMNS.values())
    files = []
    if file_names:
        files = [c for c in tables["Image"].columns if c.startswith("Image_FileName_")]
        images = tables["Image"].select(F.col(IMAGE_KEY).alias(image), *files)
        joined = joined.join(images.hint("merge") if staged else images, image, "left")
    measured = [c for name in COMPARTMENTS for c in joined.columns if c.startswith(f"{name}_")]
    return joined.select(image, "Metadata_ObjectNumber", *files, *measured)


def convert_compartment_csvs(spark: SparkSession, csv_dir: str, dest_path: str) -> str:
    """Read the CSV tables of a directory, join them and write Parquet (overwriting)."""
    join_compartments(read_compartment_csvs(spark, csv_dir)).write.mode("overwrite").parquet(
        dest_path
    )
    return dest_path


def compartment_table(
    cells: DataFrame, compartment: str, features: Sequence[str] | None = None
) -> DataFrame:
    """The narrow table of one compartment, measurement names without their prefix."""
    prefix = f"{compartment}_"
    names = features if features is not None else feature_columns(cells.columns)
    objects = F.col("Metadata_ObjectNumber")
    columns = [F.col("Metadata_ImageNumber").alias(IMAGE_KEY), objects.alias(OBJECT_KEY)]
    columns += [F.col(c).alias(c[len(prefix) :]) for c in names if c.startswith(prefix)]
    columns.append(objects.alias(OBJECT_COUNTER))
    if compartment == CENTRAL_COMPARTMENT:
        columns += [objects.alias(reference) for reference in PARENT_COLUMNS.values()]
    return cells.select(*columns)


def image_table(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per distinct site: location, one file name per channel, cells counted."""
    keys = ["Metadata_ImageNumber", "Metadata_Plate", "Metadata_Well", "Metadata_Site"]
    counts = cells.groupBy("Metadata_ImageNumber").agg(F.count("*").alias("Count_Cells"))
    stem = F.concat(
        "Metadata_Plate",
        F.lit("_"),
        "Metadata_Well",
        F.lit("_s"),
        F.col("Metadata_Site").cast("string"),
    )
    return (
        sites.select(*keys)
        .distinct()
        .join(counts, "Metadata_ImageNumber", "left")
        .select(
            F.col("Metadata_ImageNumber").alias(IMAGE_KEY),
            *keys[1:],
            *[
                F.concat(stem, F.lit(f"_{channel}.tif")).alias(f"Image_FileName_{channel}")
                for channel in CHANNELS
            ],
            F.coalesce(F.col("Count_Cells"), F.lit(0)).cast("int").alias("Count_Cells"),
        )
    )


def write_compartment_csvs(
    cells: DataFrame, sites: DataFrame, out_dir: str, *, compression: str | None = None
) -> dict[str, str]:
    """Write ``Image.csv`` and one CSV folder per compartment; returns their paths.

    ``compression`` is a codec of Spark's CSV writer, e.g. ``gzip``; its reader tells it by the names of the files.
    """
    tables = {"Image": image_table(cells, sites)}
    tables.update({name: compartment_table(cells, name) for name in COMPARTMENTS})
    written = {}
    for name, table in tables.items():
        written[name] = f"{out_dir.rstrip('/')}/{name}.csv"
        with shuffles_deleted(cells.sparkSession):
            table.write.mode("overwrite").csv(written[name], header=True, compression=compression)
    return written
