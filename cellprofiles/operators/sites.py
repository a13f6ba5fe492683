"""Site table: canonical columns, mechanism lookup, site numbers, subsets, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import bucketed_row_number
from ..schema import IMAGE_COLUMNS

# Raw column, canonical column, type (None keeps the type).
RAW_TO_CANONICAL = (
    ("TableNumber", "Metadata_TableNumber", "string"),
    ("ImageNumber", "Metadata_ImageNumber", "int"),
    ("Image_Metadata_Plate_DAPI", "Metadata_Plate", None),
    ("Image_Metadata_Well_DAPI", "Metadata_Well", None),
    ("Replicate", "Metadata_Replicate", "int"),
    ("Image_Metadata_Compound", "Metadata_Compound", None),
    ("Image_Metadata_Concentration", "Metadata_Concentration", "double"),
)
REQUIRED_NON_NULL = (
    "Metadata_Plate",
    "Metadata_Well",
    "Metadata_Site",
    "Metadata_ImageNumber",
    "Metadata_Compound",
)
CONCENTRATION_DECIMALS = 6

_IMAGE_BITS = 16  # image numbers per numbering bucket, as a power of two
_NULL_BUCKETS = 1024


def canonicalize_image_table(image: DataFrame, moa: DataFrame) -> DataFrame:
    """Canonical site table from the raw one: rename, cast, look up the mechanism by
    (compound, concentration to 6 decimals), number the sites of each well by image.

    The lookup is a left join (unknown treatments get NULL) without a broadcast hint:
    Spark broadcasts the lookup while it is small and splits skewed compounds otherwise. A
    treatment listed several times gives a row per entry.
    """
    return _expanded(_numbered(image, moa))


def _numbered(image: DataFrame, moa: DataFrame) -> DataFrame:
    """Different sites with ``_copies``, the mechanisms found for them and the number of their first row.

    ``_found`` lists the mechanisms in their order, each with its entries in the lookup and
    those before it. A treatment with many entries makes as many rows of each of its sites; numbers
    are given before that, so those rows are neither shuffled nor sorted.
    """
    sites = image.select(
        *[
            (F.col(raw) if kind is None else F.col(raw).cast(kind)).alias(name)
            for raw, name, kind in RAW_TO_CANONICAL
        ]
    )
    sites = sites.groupBy(*sites.columns).agg(F.count("*").alias("_copies"))
    lookup = moa.select(
        F.col("compound").alias("_compound"),
        F.round("concentration", CONCENTRATION_DECIMALS).alias("_dose"),
        F.col("moa").alias("_moa"),
    )
    keys = ["_compound", "_dose"]
    lookup = lookup.groupBy(*keys, "_moa").agg(F.count("*").alias("_n"))
    ordered = Window.partitionBy(*keys).orderBy("_moa")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lookup = lookup.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    lookup = lookup.groupBy(*keys).agg(
        F.collect_list(F.struct("_before", "_n", "_moa")).alias("_found"), F.sum("_n").alias("_entries")
    )
    dose = F.round("Metadata_Concentration", CONCENTRATION_DECIMALS)
    matched = sites.join(
        lookup,
        (F.col("Metadata_Compound") == F.col("_compound")) & (dose == F.col("_dose")),
        "left",
    ).drop(*keys)
    one = F.lit(1).cast("bigint")
    nothing = F.struct(
        F.lit(0).cast("bigint").alias("_before"),
        one.alias("_n"),
        F.lit(None).cast(moa.schema["moa"].dataType).alias("_moa"),
    )
    matched = matched.withColumn("_found", F.coalesce("_found", F.array(nothing)))
    weight = F.col("_copies") * F.coalesce("_entries", one)
    rest = [name for _, name, _ in RAW_TO_CANONICAL if name != "Metadata_ImageNumber"]
    return _numbered_by_image(matched, rest, weight).drop("_entries")


def _expanded(numbered: DataFrame) -> DataFrame:
    """One row per copy of a site and entry found for it."""
    rows = numbered.withColumn("_f", F.explode("_found"))
    nth = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") * F.col("_f._n") - 1))
    first = F.col("_number") + F.col("_copies") * F.col("_f._before")
    rows = rows.withColumn("_nth", nth)
    number = F.when(
        F.col("Metadata_ImageNumber").isNotNull(), (first + F.col("_nth")).cast("int")
    )
    rows = rows.withColumns({"Metadata_MoA": F.col("_f._moa"), "Metadata_Site": number})
    return rows.select(*IMAGE_COLUMNS)


def number_sites(sites: DataFrame) -> DataFrame:
    """Add ``Metadata_Site``: 1-based position of the image within its (plate, well).

    Buckets of consecutive image numbers keep the window small for a well of any size.
    Sites without an image number get none; their rows are spread over hash buckets.
    """
    rest = [c for c in sites.columns if c != "Metadata_ImageNumber"]
    number = F.when(F.col("Metadata_ImageNumber").isNotNull(), F.col("_number").cast("int"))
    return _numbered_by_image(sites, rest).withColumn("Metadata_Site", number).drop("_number")


def _numbered_by_image(
    sites: DataFrame, rest: list[str], weight: Column | None = None
) -> DataFrame:
    """``_number`` of each row in its (plate, well) by image, then by the columns ``rest``."""
    image = F.col("Metadata_ImageNumber")
    spread = -1 - F.pmod(F.xxhash64(*rest), F.lit(_NULL_BUCKETS))
    # NULLs sort after all images, so that they do not shift the numbers.
    after = F.lit(1 << (32 - _IMAGE_BITS)) - spread
    bucket = F.coalesce(F.shiftright(image, _IMAGE_BITS).cast("long"), after)
    return bucketed_row_number(
        sites,
        ["Metadata_Plate", "Metadata_Well"],
        bucket,
        [image.asc(), *[F.col(c).asc() for c in rest]],
        "_number",
        weight,
    )


def build_dev_subset(
    image: DataFrame, moa: DataFrame, *, n_plates: int = 3, moa_only: bool = True
) -> DataFrame:
    """Canonical sites of the first ``n_plates`` plates by name, sorted by plate, well, site.

    Whole plates are kept, so the plates are picked before lookup and numbering and the
    dropped ones never reach a shuffle. The list of plates is at most ``n_plates`` rows
    long, hence the broadcast. ``moa_only`` drops treatments without a known mechanism
    afterwards, because they take part in the numbering.
    """
    plate = "Image_Metadata_Plate_DAPI"
    first = image.select(plate).where(F.col(plate).isNotNull()).distinct()
    first = first.orderBy(plate).limit(n_plates)
    kept = image.join(F.broadcast(first), plate, "left_semi")
    sites = _numbered(kept, moa)
    if moa_only:
        sites = sites.withColumn("_found", F.filter("_found", lambda f: f["_moa"].isNotNull()))
        sites = sites.where(F.size("_found") > 0)
    # Sites without an image number have no number and come first.
    sites = sites.orderBy(
        "Metadata_Plate", "Metadata_Well", F.col("Metadata_ImageNumber").isNotNull(), "_number"
    )
    return _expanded(sites)


def image_table_checks(table: DataFrame) -> DataFrame:
    """One row with the facts behind :func:`validate_image_table`, from one pass."""
    return table.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED_NON_NULL],
        F.min("Metadata_Site").alias("min_site"),
        F.min("Metadata_Concentration").alias("min_concentration"),
    )


def image_table_violations(facts: dict) -> list[tuple[str, int]]:
    """(rule, violations) from one row of :func:`image_table_checks`; a rule that holds has 0."""
    rules = [("the table has rows", int(facts["n_rows"] == 0))]
    rules += [(f"{c} is set", facts[f"null_{c}"]) for c in REQUIRED_NON_NULL]
    for column, lowest, least in (
        ("Metadata_Site", facts["min_site"], 1),
        ("Metadata_Concentration", facts["min_concentration"], 0),
    ):
        rules.append((f"{column} is {least} or more", int(lowest is not None and lowest < least)))
    return rules


def validate_image_table(table: DataFrame) -> list[str]:
    """Broken rules of a canonical site table; one aggregate, and none if columns are absent."""
    absent = sorted(set(IMAGE_COLUMNS) - set(table.columns))
    if absent:
        return [f"columns absent: {', '.join(absent)}"]
    facts = image_table_checks(table).first().asDict()
    return [f"broken {n} time(s): {rule}" for rule, n in image_table_violations(facts) if n]
