"""ANSI-style SQL (DuckDB) for the queries, written against the same roles.

Rounded numbers add 0.0 so that a negative zero compares equal to zero.
"""

from __future__ import annotations

from . import roles
from .roles import FEATURES, SEGMENTS, for_oracle

CELLS = f"cells AS ({for_oracle(roles.CELLS)})"
STRATA = (
    "Metadata_PatientID, Metadata_SampleID, Metadata_Plate, Metadata_Well, Metadata_Batch, "
    "Metadata_DiseaseGroup"
)


def columns(template: str, features: list[str] | tuple[str, ...] = tuple(FEATURES)) -> str:
    """The template once per feature ``$f``."""
    return ", ".join(template.replace("$f", f) for f in features)


def union(template: str, features: list[str] | tuple[str, ...] = tuple(FEATURES)) -> str:
    return " UNION ALL ".join(template.replace("$f", f) for f in features)


def with_tables(*tables: str) -> str:
    return "WITH " + ", ".join(tables) + " "


def wells(operation: str = "median", features: list[str] = FEATURES) -> str:
    picked = columns(f"{operation}($f) AS $f", features)
    return (
        f"wells AS (SELECT {STRATA}, count(*) AS Metadata_Object_Count, {picked} "
        f"FROM cells GROUP BY {STRATA})"
    )


# --- sites ----------------------------------------------------------------------------

SITE_ORDER = "Metadata_ImageNumber, Metadata_MoA NULLS FIRST"


def canonical(plates: int | None = None) -> str:
    kept = ""
    if plates is not None:
        kept = (
            "WHERE Image_Metadata_Plate_DAPI IN (SELECT DISTINCT Image_Metadata_Plate_DAPI "
            f"FROM raw ORDER BY 1 LIMIT {plates})"
        )
    return f"""raw AS ({for_oracle(roles.RAW_SITES)}), moa AS ({for_oracle(roles.MOA)}),
joined AS (
    SELECT CAST(TableNumber AS VARCHAR) AS Metadata_TableNumber,
           CAST(ImageNumber AS INTEGER) AS Metadata_ImageNumber,
           Image_Metadata_Plate_DAPI AS Metadata_Plate, Image_Metadata_Well_DAPI AS Metadata_Well,
           CAST(Replicate AS INTEGER) AS Metadata_Replicate,
           Image_Metadata_Compound AS Metadata_Compound,
           Image_Metadata_Concentration AS conc, moa AS Metadata_MoA
    FROM raw LEFT JOIN moa ON Image_Metadata_Compound = compound
        AND round(Image_Metadata_Concentration, 6) = round(concentration, 6) {kept}),
sites AS (
    SELECT Metadata_TableNumber, Metadata_ImageNumber, Metadata_Plate, Metadata_Well,
           CAST(row_number() OVER (PARTITION BY Metadata_Plate, Metadata_Well
                ORDER BY {SITE_ORDER}) AS INTEGER) AS Metadata_Site,
           Metadata_Replicate, Metadata_Compound, round(conc, 6) AS Metadata_Concentration,
           Metadata_MoA
    FROM joined)"""


COMPARTMENTS = ", ".join(
    f"{name} AS ({for_oracle(sql)})"
    for name, sql in (
        ("image", roles.IMAGES),
        ("cell", roles.CELL_TABLE),
        ("cytoplasm", roles.CYTOPLASM),
        ("nuclei", roles.NUCLEI),
    )
)
JOINED = f"""{COMPARTMENTS}, joined AS (
    SELECT y.ImageNumber AS Metadata_ImageNumber, y.ObjectNumber AS Metadata_ObjectNumber,
           i.Image_FileName_DNA, c.AreaShape_Area AS Cells_AreaShape_Area,
           c.Number_Object_Number AS Cells_Number_Object_Number,
           y.AreaShape_Area AS Cytoplasm_AreaShape_Area,
           y.Texture_Contrast_Actin AS Cytoplasm_Texture_Contrast_Actin,
           y.Number_Object_Number AS Cytoplasm_Number_Object_Number,
           n.Intensity_MeanIntensity_DNA AS Nuclei_Intensity_MeanIntensity_DNA,
           n.Number_Object_Number AS Nuclei_Number_Object_Number
    FROM cytoplasm y
    LEFT JOIN cell c ON y.ImageNumber = c.ImageNumber AND y.Parent_Cells = c.ObjectNumber
    LEFT JOIN nuclei n ON y.ImageNumber = n.ImageNumber AND y.Parent_Nuclei = n.ObjectNumber
    LEFT JOIN image i ON y.ImageNumber = i.ImageNumber)"""
JOINED_FEATURES = (
    "Cells_AreaShape_Area, Cytoplasm_AreaShape_Area, Cytoplasm_Texture_Contrast_Actin, "
    "Nuclei_Intensity_MeanIntensity_DNA"
)
ASSIGNED = f"assigned AS ({for_oracle(roles.ASSIGNED_SITES)})"
SAMPLE_COLUMNS = (
    "Metadata_PatientID, Metadata_SampleID, Metadata_DiseaseGroup, Metadata_FailureType, "
    "Metadata_Age, Metadata_Sex, Metadata_Batch, Metadata_Plate, Metadata_Well, "
    "Metadata_Replicate, Metadata_Compound, Metadata_Concentration, Metadata_MoA"
)
CANONICAL_CELLS = f"""{JOINED}, {ASSIGNED}, canonical AS (
    SELECT CAST(j.Metadata_ImageNumber AS INTEGER) AS Metadata_ImageNumber,
           CAST(j.Metadata_ObjectNumber AS INTEGER) AS Metadata_ObjectNumber,
           Metadata_Site, {SAMPLE_COLUMNS}, {JOINED_FEATURES}
    FROM joined j LEFT JOIN assigned s ON j.Metadata_ImageNumber = s.Metadata_ImageNumber)"""

# --- assignment -----------------------------------------------------------------------

ASSIGN = f"""sites AS ({for_oracle(roles.SITES)}), patients AS ({for_oracle(roles.PATIENTS)}),
people AS (SELECT *, row_number() OVER (ORDER BY Metadata_PatientID) - 1 AS person FROM patients),
pairs AS (SELECT DISTINCT Metadata_Plate, Metadata_Well FROM sites),
wells AS (SELECT *, row_number() OVER (ORDER BY Metadata_Plate, Metadata_Well) - 1 AS idx,
          row_number() OVER (PARTITION BY Metadata_Plate ORDER BY Metadata_Well) - 1 AS turn,
          dense_rank() OVER (ORDER BY Metadata_Plate) - 1 AS plate FROM pairs)"""
SEGMENT_CASE = (
    "CASE Metadata_DiseaseGroup "
    + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEGMENTS))
    + " END"
)
HOMES = f"""homed AS (
    SELECT person, {SEGMENT_CASE} % (SELECT count(DISTINCT plate) FROM wells) AS home FROM people),
members AS (SELECT person, home, row_number() OVER (PARTITION BY home ORDER BY person) - 1 AS place,
            count(*) OVER (PARTITION BY home) AS n FROM homed),
sized AS (SELECT w.*, (SELECT max(n) FROM members m WHERE m.home = w.plate) AS n FROM wells w),
chosen AS (SELECT w.Metadata_Plate, w.Metadata_Well,
           coalesce(m.person, w.turn % (SELECT count(*) FROM people)) AS person
           FROM sized w LEFT JOIN members m ON m.home = w.plate AND m.place = w.turn % w.n)"""


def assigned(chosen: str) -> str:
    return f"""SELECT s.*, s.Metadata_Plate || '_' || s.Metadata_Well AS Metadata_SampleID,
        s.Metadata_Plate AS Metadata_Batch, p.* EXCLUDE (person)
    FROM sites s JOIN {chosen} c USING (Metadata_Plate, Metadata_Well)
    JOIN people p ON p.person = c.person"""


DRAW = "CAST('0x' || substr(md5('0/' || Metadata_Plate || '/' || Metadata_Well), 1, 12) AS BIGINT)"
MIXED = (
    f"mixed AS (SELECT c.Metadata_Plate, c.Metadata_Well, CASE WHEN {DRAW} / power(16, 12) < 0.5 "
    "THEN c.person ELSE w.idx % (SELECT count(*) FROM people) END AS person FROM chosen c "
    "JOIN wells w USING (Metadata_Plate, Metadata_Well))"
)

# --- quality control ------------------------------------------------------------------


def drift(by: str) -> str:
    return union(
        "SELECT '$f' AS feature, (SELECT stddev_pop(m) FROM (SELECT avg($f) AS m FROM cells "
        f"GROUP BY {by})) / (SELECT stddev_pop($f) FROM cells) AS drift_score"
    )


def missing(table: str, features: list[str] = FEATURES) -> str:
    return union(
        "SELECT '$f' AS feature, count(*) - count($f) AS n_missing, "
        f"(count(*) - count($f)) / CAST(count(*) AS DOUBLE) AS fraction_missing FROM {table}",
        features,
    )


def outliers(table: str, cuts: dict[str, float]) -> str:
    parts = []
    for feature, cut in cuts.items():
        sign = "<" if cut < 0 else ">"
        z = f"({feature} - m) / s {sign} {cut}"
        parts.append(
            f"SELECT '{feature}' AS feature, CAST({cut} AS DOUBLE) AS threshold, "
            f"count(*) FILTER (WHERE {z}) AS n_outliers, "
            f"count(*) FILTER (WHERE {z}) / CAST(count(*) AS DOUBLE) AS fraction_outliers "
            f"FROM {table}, (SELECT avg({feature}) AS m, stddev_pop({feature}) AS s FROM {table})"
        )
    return " UNION ALL ".join(parts)


def report_rows() -> str:
    parts = [
        f"SELECT '{name}' AS report, {column} AS entity, 'n_cells' AS measure, "
        "CAST(count(*) AS DOUBLE) AS number "
        f"FROM cells GROUP BY {column}"
        for name, column in (
            ("cell_counts_per_well", "Metadata_Well"),
            ("cell_counts_per_plate", "Metadata_Plate"),
            ("cell_counts_per_disease", "Metadata_DiseaseGroup"),
        )
    ]
    present = {f: 3.0 for f in FEATURES if f in DEFAULT_CUTS}
    tidy = (
        ("missingness", missing("cells"), ("n_missing", "fraction_missing")),
        ("feature_drift_by_batch", drift("Metadata_Batch"), ("drift_score",)),
        ("plate_effects", drift("Metadata_Plate"), ("drift_score",)),
        ("outliers", outliers("cells", present), ("threshold", "n_outliers", "fraction_outliers")),
    )
    parts += [
        f"SELECT '{name}', feature, '{value}', round({value}, 9) + 0.0 FROM ({sql})"
        for name, sql, values in tidy
        for value in values
    ]
    return " UNION ALL ".join(parts)


DEFAULT_CUTS = (
    "Nuclei_AreaShape_Area",
    "Cells_AreaShape_Area",
    "Nuclei_Intensity_IntegratedIntensity_DNA",
)

# --- profiles -------------------------------------------------------------------------


def normalized(center: str, scale: str, fit: str = "wells", features: list[str] = FEATURES) -> str:
    """CTE ``normalized``: (x - center) / scale, and over 1 where the scale is 0."""
    stats = columns(f"({center}) AS c_$f, ({scale}) AS s_$f", features).replace("$rows", fit)
    scaled = columns("($f - c_$f) / CASE WHEN s_$f = 0 THEN 1.0 ELSE s_$f END AS $f", features)
    return (
        f"stats AS (SELECT {stats}), normalized AS (SELECT {STRATA}, Metadata_Object_Count, "
        f"{scaled} FROM wells, stats)"
    )


STANDARD = ("SELECT avg($f) FROM $rows", "SELECT stddev_pop($f) FROM $rows")
ROBUST = (
    "SELECT median($f) FROM $rows",
    "SELECT 1.4826 * median(abs($f - (SELECT median($f) FROM $rows))) + 1e-18 FROM $rows",
)


def final_normalized(features: list[str] = FEATURES) -> str:
    picked = columns("round($f, 6) + 0.0 AS $f", features)
    return f"SELECT {STRATA}, Metadata_Object_Count, {picked} FROM normalized"


def consensus(operation: str, table: str) -> str:
    picked = columns(f"round({operation}($f), 6) + 0.0 AS $f")
    return (
        f"SELECT Metadata_PatientID, Metadata_DiseaseGroup, {picked} FROM {table} "
        "GROUP BY Metadata_PatientID, Metadata_DiseaseGroup"
    )


def frequencies(table: str = "wells", features: list[str] = FEATURES) -> str:
    return union(
        f"SELECT '$f' AS feature, (SELECT count(*) FROM {table}) AS n_rows, "
        f"(SELECT count(DISTINCT $f) FROM {table}) AS n_distinct, (SELECT max(c) FROM "
        f"(SELECT count(*) AS c FROM {table} WHERE $f IS NOT NULL GROUP BY $f)) AS first, "
        f"(SELECT c FROM (SELECT count(*) AS c FROM {table} WHERE $f IS NOT NULL GROUP BY $f) "
        "ORDER BY c DESC LIMIT 1 OFFSET 1) AS second",
        features,
    )


def correlations(table: str = "wells", features: list[str] = FEATURES) -> str:
    """Pairwise: ``corr`` takes the rows that have both."""
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, 1.0 AS r"
        if a == b
        else f"SELECT '{a}' AS a, '{b}' AS b, coalesce(corr({a}, {b}), 0.0) AS r FROM {table}"
        for a in features
        for b in features
    )


def selection(table: str = "wells", features: list[str] = FEATURES) -> str:
    """CTEs up to ``dropped``, what the default operations exclude."""
    return f"""freq AS ({frequencies(table, features)}), corrs AS ({correlations(table, features)}),
total AS (SELECT a, sum(abs(r)) AS t FROM corrs GROUP BY a),
dropped AS (
    SELECT 'variance_threshold' AS operation, feature FROM freq WHERE n_distinct < 2 OR second / CAST(first AS DOUBLE) < 0.05
        OR n_distinct / CAST(n_rows AS DOUBLE) < 0.01
    UNION SELECT 'drop_na_columns', feature FROM ({missing(table, features)}) WHERE fraction_missing > 0.05
    UNION SELECT 'correlation_threshold', CASE WHEN ta.t > tb.t OR (ta.t = tb.t AND p.a > p.b) THEN p.a ELSE p.b END
    FROM corrs p JOIN total ta ON ta.a = p.a JOIN total tb ON tb.a = p.b
    WHERE p.a < p.b AND abs(p.r) > 0.9)"""


#: Moderated consensus by its definition: the correlation of the ranks of every pair of
#: replicates, where a missing value has the mean rank, and means over what is there.
MODZ = f"""numbered AS (SELECT row_number() OVER (ORDER BY Metadata_PatientID, Metadata_SampleID)
    AS id, Metadata_PatientID AS p, Metadata_DiseaseGroup AS d, {", ".join(FEATURES)}
    FROM normalized),
long AS ({union("SELECT id, p, d, '$f' AS f, $f AS v FROM numbered WHERE $f IS NOT NULL")}),
ranked AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY v)
    + (count(*) OVER (PARTITION BY id, v) - 1) / 2.0 AS rk FROM long),
centred AS (SELECT *, rk - avg(rk) OVER (PARTITION BY id) AS c FROM ranked),
united AS (SELECT *, coalesce(c / nullif(sqrt(sum(c * c) OVER (PARTITION BY id)), 0), 0.0) AS u
    FROM centred),
agreed AS (SELECT a.id, sum(a.u * b.u) AS r
    FROM united a JOIN united b ON a.p = b.p AND a.f = b.f AND a.id <> b.id GROUP BY a.id, b.id),
others AS (SELECT id, count(*) OVER (PARTITION BY p, d) - 1 AS n FROM numbered),
weights AS (SELECT n.id, greatest(coalesce((SELECT sum(r) FROM agreed g WHERE g.id = n.id)
    / nullif(o.n, 0), 0.0), 0.01) AS w FROM numbered n JOIN others o ON n.id = o.id)
SELECT p AS Metadata_PatientID, d AS Metadata_DiseaseGroup,
    {columns("round(sum(w * $f) / sum(CASE WHEN $f IS NOT NULL THEN w END), 6) + 0.0 AS $f")}
FROM numbered JOIN weights USING (id) GROUP BY p, d"""


def flat_controls() -> str:
    """CTEs ``wells`` with one feature constant in the controls, and ``controls``."""
    flat, *others = FEATURES
    return (
        f"wells AS (SELECT {STRATA}, Metadata_Object_Count, CASE WHEN Metadata_DiseaseGroup = "
        f"'BUILDING' THEN 7.0 ELSE {flat} END AS {flat}, {', '.join(others)} FROM raw_wells), "
        "controls AS (SELECT * FROM wells WHERE Metadata_DiseaseGroup = 'BUILDING')"
    )


def white_pair(a: str, b: str) -> str:
    """The inverse root of a 2 x 2 correlation matrix has the eigenvalues 1 + r and 1 - r."""
    filled = f"coalesce(({{0}} - avg({{0}}) OVER ()) / stddev_pop({{0}}) OVER (), 0.0) AS z_{{0}}"
    return (
        f"SELECT {STRATA}, Metadata_Object_Count, round(z_{a} * same + z_{b} * mixed, 6) + 0.0 AS {a}, "
        f"round(z_{a} * mixed + z_{b} * same, 6) + 0.0 AS {b} FROM ("
        f"SELECT {STRATA}, Metadata_Object_Count, {filled.format(a)}, {filled.format(b)} FROM wells), "
        "(SELECT (1 / sqrt(1 + r + 1e-6) + 1 / sqrt(1 - r + 1e-6)) / 2 AS same, "
        "(1 / sqrt(1 + r + 1e-6) - 1 / sqrt(1 - r + 1e-6)) / 2  AS mixed "
        f"FROM (SELECT corr({a}, {b}) AS r FROM wells))"
    )


# --- evaluation -----------------------------------------------------------------------

VECTORS = f"v AS (SELECT row_id, label, batch, CAST(embedding AS DOUBLE[]) AS e FROM ({for_oracle(roles.EMBEDDINGS)}))"
COSINE = f"""{VECTORS}, ranked AS (
    SELECT a.row_id, CAST(a.label = b.label AS INTEGER) AS same,
           round(list_cosine_similarity(a.e, b.e), 12) AS s
    FROM v a JOIN v b ON a.row_id <> b.row_id),
precise AS (SELECT row_id, same, sum(same) OVER w / CAST(count(*) OVER w AS DOUBLE) AS p
    FROM ranked WINDOW w AS (PARTITION BY row_id ORDER BY s DESC
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
scored AS (SELECT row_id, sum(same * p) / sum(same) AS ap FROM precise GROUP BY row_id
    HAVING sum(same) > 0 AND sum(same) < count(*))"""
MAP_VALUE = "SELECT avg(ap) FROM scored"
SILHOUETTE = f"""{VECTORS}, near AS (
    SELECT a.row_id, a.label AS own, b.label AS other, avg(list_distance(a.e, b.e)) AS d
    FROM v a JOIN v b ON a.row_id <> b.row_id GROUP BY a.row_id, a.label, b.label),
ab AS (SELECT row_id, max(d) FILTER (WHERE own = other) AS a,
    min(d) FILTER (WHERE own <> other) AS b FROM near GROUP BY row_id)"""
SILHOUETTE_VALUE = "SELECT avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) FROM ab"


def mixing(column: str, skip: int, name: str) -> str:
    return f"""{name} AS (
    SELECT avg(CAST(other <> own AS DOUBLE)) /
        (SELECT 1.0 - sum(power(c / CAST(n AS DOUBLE), 2)) FROM (SELECT count(*) AS c,
            (SELECT count(*) FROM v) AS n FROM v GROUP BY {column})) AS value
    FROM (SELECT a.{column} AS own, b.{column} AS other,
            row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.e, b.e), b.row_id) AS k
          FROM v a JOIN v b ON a.row_id <> b.row_id)
    WHERE k > {skip} AND k <= {15 + skip})"""


def classifier(column: str, name: str) -> str:
    """CTEs up to ``name`` with the cross-validated balanced accuracy for a label."""
    smallest = f"(SELECT min(n) FROM (SELECT count(*) AS n FROM v GROUP BY {column}))"
    return f"""{name}_folds AS (SELECT row_id, {column} AS own, e,
        (row_number() OVER (PARTITION BY {column} ORDER BY md5('0/' || row_id || '/' || row_id)) - 1)
            % least(5, {smallest}) AS fold FROM v),
    {name}_near AS (SELECT a.row_id, a.fold, a.own, b.own AS other, row_number() OVER (
            PARTITION BY a.row_id ORDER BY list_distance(a.e, b.e), b.row_id) AS k
        FROM {name}_folds a JOIN {name}_folds b ON a.fold <> b.fold),
    {name}_votes AS (SELECT row_id, fold, own, other, count(*) AS n FROM {name}_near
        WHERE k <= least(5, {smallest}) GROUP BY ALL),
    {name}_guess AS (SELECT row_id, fold, own, first(other ORDER BY n DESC, other) AS guess
        FROM {name}_votes GROUP BY ALL),
    {name}_recall AS (SELECT fold, own, avg(CAST(guess = own AS DOUBLE)) AS r FROM {name}_guess
        GROUP BY ALL),
    {name} AS (SELECT avg(b) AS value FROM (SELECT fold, avg(r) AS b FROM {name}_recall
        GROUP BY fold))"""


#: The scorecard's labels are those of the embeddings; the patient is the label again.
SCORECARD = (
    with_tables(
        COSINE,
        SILHOUETTE.removeprefix(VECTORS + ", "),
        classifier("label", "by_label"),
        classifier("batch", "by_batch"),
        mixing("batch", 0, "mix"),
        "rows AS ("
        + " UNION ALL ".join(
            f"SELECT '{metric}' AS metric, ({value}) AS value, {text} AS interpretation"
            for metric, value, text in (
                (
                    "replicate_reproducibility_map",
                    MAP_VALUE,
                    "'higher is better (same-replicate profiles look alike)'",
                ),
                (
                    "disease_silhouette",
                    SILHOUETTE_VALUE,
                    "'higher is better (disease groups separate)'",
                ),
                (
                    "disease_classifier_balacc",
                    "SELECT value FROM by_label",
                    "format('higher is better; chance={:.3f}', "
                    "(SELECT 1.0 / count(DISTINCT label) FROM v))",
                ),
                (
                    "batch_classifier_balacc",
                    "SELECT value FROM by_batch",
                    "format('lower is better (batch leakage); chance={:.3f}', "
                    "(SELECT 1.0 / count(DISTINCT batch) FROM v))",
                ),
                (
                    "batch_mixing_ratio",
                    "SELECT value FROM mix",
                    "'1.0 = mixed, toward 0 = batch-separated'",
                ),
            )
        )
        + ")",
    )
    + "SELECT metric, round(value, 6) + 0.0 AS value, interpretation FROM rows"
)

#: Wells of the batch job: the joined compartments with the round-robin patients.
JOB_FEATURES = JOINED_FEATURES.split(", ")
JOB_STRATA = (
    "Metadata_PatientID, Metadata_SampleID, Metadata_Plate, Metadata_Well, Metadata_Batch, "
    "Metadata_DiseaseGroup, Metadata_FailureType, Metadata_Age, Metadata_Sex, Metadata_Compound, "
    "Metadata_Concentration, Metadata_MoA"
)


def job_summary() -> str:
    everyone = (
        "(SELECT Metadata_Plate, Metadata_Well, idx % (SELECT count(*) FROM people) AS person "
        "FROM wells)"
    )
    large = "coalesce((Cells_AreaShape_Area - m) / s > 1.0, false)"
    small = "coalesce((Nuclei_Intensity_MeanIntensity_DNA - nm) / ns < -0.5, false)"
    profiles = (
        f"profiles AS (SELECT {JOB_STRATA}, {columns('median($f) AS $f', JOB_FEATURES)} "
        f"FROM job_cells GROUP BY {JOB_STRATA})"
    )
    selected = selection("profiles", JOB_FEATURES)
    return (
        with_tables(
            ASSIGN,
            f"located AS ({assigned(everyone)})",
            JOINED,
            "job_cells AS (SELECT j.*, l.* EXCLUDE (Metadata_ImageNumber) FROM joined j "
            "LEFT JOIN located l USING (Metadata_ImageNumber))",
            profiles,
            selected,
        )
        + "SELECT (SELECT count(DISTINCT Metadata_Plate) FROM sites) AS n_plates, "
        "(SELECT count(*) FROM pairs) AS n_wells, count(*) AS n_cells, "
        "count(DISTINCT Metadata_PatientID) AS n_patients, "
        f"count(*) FILTER (WHERE {large} OR {small}) AS n_outlier_cells, "
        f"count(*) FILTER (WHERE {large}) + count(*) FILTER (WHERE {small}) AS n_outlier_flags, "
        "(SELECT count(*) FROM patients) AS n_integrated_rows, "
        f"{len(JOB_FEATURES)} - (SELECT count(*) FROM dropped) AS n_features_selected "
        "FROM job_cells, (SELECT avg(Cells_AreaShape_Area) AS m, "
        "stddev_pop(Cells_AreaShape_Area) AS s, "
        "avg(Nuclei_Intensity_MeanIntensity_DNA) AS nm, "
        "stddev_pop(Nuclei_Intensity_MeanIntensity_DNA) AS ns FROM job_cells)"
    )


ORACLES: dict[str, str] = {
    "csv_roundtrip": (
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, "
        "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders"
    ),
    "parquet_roundtrip": with_tables(CELLS) + "SELECT * FROM cells",
    "validate_schema": (
        "SELECT * FROM (VALUES ('absent', 'c_region'), ('surplus', 'c_mktsegment'), "
        "('retyped', 'c_nationkey'), ('retyped', 'c_acctbal')) AS t(difference, \"column\")"
    ),
    "cast_to_schema": (
        "SELECT CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_quantity AS INTEGER) AS l_quantity, "
        "CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_returnflag FROM lineitem"
    ),
    "metadata_projection": with_tables(CELLS)
    + f"SELECT {STRATA}, Metadata_ImageNumber, Metadata_ObjectNumber FROM cells",
    "feature_projection": with_tables(CELLS)
    + f"SELECT {columns('round($f, 4) + 0.0 AS $f')} FROM cells",
    "feature_pick": with_tables(JOINED) + f"SELECT {JOINED_FEATURES} FROM joined",
    "canonical_sites": with_tables(canonical()) + "SELECT * FROM sites",
    "validate_sites": with_tables(canonical())
    + "SELECT count(*) AS n_rows, "
    + ", ".join(
        f"count(*) FILTER (WHERE Metadata_{c} IS NULL) AS null_Metadata_{c}"
        for c in ("Plate", "Well", "Site", "ImageNumber", "Compound")
    )
    + ", min(Metadata_Site) AS min_site, min(Metadata_Concentration) AS min_concentration FROM sites",
    "dev_subset": with_tables(canonical(plates=2))
    + "SELECT * FROM sites WHERE Metadata_MoA IS NOT NULL",
    "dev_subset_from_csv": with_tables(canonical(plates=2))
    + "SELECT * FROM sites WHERE Metadata_MoA IS NOT NULL",
    "compartment_join": with_tables(JOINED) + "SELECT * FROM joined",
    "attach_sites": with_tables(CANONICAL_CELLS) + "SELECT * FROM canonical",
    "cells_from_csv": with_tables(CANONICAL_CELLS) + "SELECT * FROM canonical",
    "compartment_split": with_tables(CELLS)
    + "SELECT Metadata_ImageNumber AS ImageNumber, Metadata_ObjectNumber AS ObjectNumber, "
    "Nuclei_AreaShape_Area AS AreaShape_Area, Nuclei_Intensity_IntegratedIntensity_DNA AS "
    "Intensity_IntegratedIntensity_DNA, Metadata_ObjectNumber AS Number_Object_Number FROM cells",
    "image_split": with_tables(CELLS, ASSIGNED)
    + "SELECT s.Metadata_ImageNumber AS ImageNumber, Metadata_Plate, Metadata_Well, Metadata_Site, "
    + ", ".join(
        f"Metadata_Plate || '_' || Metadata_Well || '_s' || Metadata_Site || '_{c}.tif' "
        f"AS Image_FileName_{c}"
        for c in ("DNA", "Tubulin", "Actin")
    )
    + ", CAST(coalesce(n, 0) AS INTEGER) AS Count_Cells FROM (SELECT DISTINCT "
    "Metadata_ImageNumber, Metadata_Plate, Metadata_Well, Metadata_Site FROM assigned) s LEFT JOIN "
    "(SELECT Metadata_ImageNumber, count(*) AS n FROM cells GROUP BY 1) USING (Metadata_ImageNumber)",
    "compartment_csv_roundtrip": with_tables(CANONICAL_CELLS)
    + "SELECT CAST(Metadata_ImageNumber AS BIGINT) AS Metadata_ImageNumber, "
    "CAST(Metadata_ObjectNumber AS BIGINT) AS Metadata_ObjectNumber, "
    + ", ".join(
        f"Metadata_Plate || '_' || Metadata_Well || '_s' || Metadata_Site || '_{c}.tif' "
        f"AS Image_FileName_{c}"
        for c in ("DNA", "Tubulin", "Actin")
    )
    + f", {JOINED_FEATURES}, "
    + ", ".join(
        f"CAST(Metadata_ObjectNumber AS BIGINT) AS {c}_Number_Object_Number"
        for c in ("Cells", "Cytoplasm", "Nuclei")
    )
    + " FROM canonical",
    "assign_balanced": with_tables(ASSIGN)
    + assigned(
        "(SELECT Metadata_Plate, Metadata_Well, idx % (SELECT count(*) FROM people) AS person "
        "FROM wells)"
    ),
    "assign_confounded": with_tables(ASSIGN, HOMES) + assigned("chosen"),
    "assign_mixed": with_tables(ASSIGN, HOMES, MIXED) + assigned("mixed"),
    "select_groups": with_tables(CELLS)
    + "SELECT * FROM cells WHERE Metadata_DiseaseGroup IN ('BUILDING', 'MACHINERY')",
    "select_patients": with_tables(CELLS)
    + "SELECT * FROM cells WHERE CAST(Metadata_PatientID AS INTEGER) BETWEEN 1 AND 39",
    "attach_missing_columns": with_tables(CELLS, f"patients AS ({for_oracle(roles.PATIENTS)})")
    + "SELECT c.*, p.Metadata_FailureType, p.Metadata_Age, p.Metadata_Sex FROM cells c "
    "LEFT JOIN patients p USING (Metadata_PatientID)",
    "integrate_patients": with_tables(
        f"p AS ({for_oracle(roles.PATIENTS)})",
        f"c AS ({for_oracle(roles.CLINICAL)})",
        f"s AS ({for_oracle(roles.SNRNA)})",
        f"m AS ({for_oracle(roles.MORPHOLOGY)})",
    )
    + "SELECT p.*, c.* EXCLUDE (Metadata_PatientID), t.total_nuclei, t.fibroblast_fraction, "
    "m.* EXCLUDE (Metadata_PatientID, Metadata_DiseaseGroup, Metadata_FailureType) "
    "FROM p LEFT JOIN c USING (Metadata_PatientID) LEFT JOIN (SELECT Metadata_PatientID, "
    "CAST(sum(n_nuclei) AS BIGINT) AS total_nuclei, sum(CASE WHEN cell_type = 'Fibroblast' "
    "THEN fraction_of_sample ELSE 0.0 END) AS fibroblast_fraction FROM s "
    "GROUP BY Metadata_PatientID) t USING (Metadata_PatientID) "
    "LEFT JOIN m USING (Metadata_PatientID)",
    **{
        f"cell_counts_{level}": with_tables(CELLS)
        + f"SELECT {column}, count(*) AS n_cells FROM cells WHERE {column} IS NOT NULL "
        f"GROUP BY {column}"
        for level, column in (
            ("patient", "Metadata_PatientID"),
            ("sample", "Metadata_SampleID"),
            ("disease", "Metadata_DiseaseGroup"),
            ("plate", "Metadata_Plate"),
            ("well", "Metadata_Well"),
        )
    },
    "hierarchy_summary": with_tables(CELLS)
    + "SELECT count(DISTINCT Metadata_PatientID) AS n_patients, count(DISTINCT Metadata_SampleID) "
    "AS n_samples, count(DISTINCT Metadata_Plate) AS n_plates, (SELECT count(*) FROM (SELECT "
    "DISTINCT Metadata_Plate, Metadata_Well FROM cells)) AS n_wells, count(*) AS n_cells FROM cells",
    "missingness": with_tables(CELLS)
    + "SELECT feature, n_missing, round(fraction_missing, 9) + 0.0 AS fraction_missing "
    f"FROM ({missing('cells')})",
    "feature_parts": with_tables(
        CELLS,
        f"m AS ({missing('cells')})",
        "p AS (SELECT feature, string_split(feature, '_') AS s FROM m)",
    )
    + "SELECT m.* REPLACE (round(fraction_missing, 9) + 0.0 AS fraction_missing), s[1] AS compartment, s[2] AS family, s[3] AS measurement, s[4] AS channel "
    "FROM m JOIN p USING (feature)",
    "feature_drift_batch": with_tables(CELLS)
    + f"SELECT feature, round(drift_score, 9) + 0.0 AS drift_score FROM ({drift('Metadata_Batch')})",
    "plate_effects": with_tables(CELLS)
    + f"SELECT feature, round(drift_score, 9) + 0.0 AS drift_score FROM ({drift('Metadata_Plate')})",
    "top_drift": with_tables(CELLS)
    + f"SELECT feature, round(drift_score, 9) + 0.0 AS drift_score FROM ({drift('Metadata_Batch')}) "
    "ORDER BY drift_score DESC, feature LIMIT 3",
    "outlier_labels": with_tables(f"e AS ({for_oracle(roles.EVENTS)})")
    + "SELECT e.*, coalesce((Nuclei_AreaShape_Area - m) / s > 3.0, false) AS cqc_is_outlier FROM e, "
    "(SELECT avg(Nuclei_AreaShape_Area) AS m, stddev_pop(Nuclei_AreaShape_Area) AS s FROM e)",
    "outlier_summary": with_tables(CELLS)
    + "SELECT feature, threshold, n_outliers, round(fraction_outliers, 9) + 0.0 AS fraction_outliers "
    f"FROM ({outliers('cells', {'Nuclei_AreaShape_Area': 1.5, 'Cells_AreaShape_Area': -1.2})})",
    "qc_report": with_tables(CELLS) + report_rows(),
    "well_profiles_median": with_tables(CELLS, wells())
    + f"SELECT {STRATA}, Metadata_Object_Count, {columns('round($f, 6) + 0.0 AS $f')} FROM wells",
    "well_profiles_mean": with_tables(CELLS, wells("avg"))
    + f"SELECT {STRATA}, Metadata_Object_Count, "
    f"{columns('round($f, 9) + 0.0 AS $f')} FROM wells",
    "well_profiles_hot": with_tables(CELLS)
    + "SELECT Metadata_Plate, Metadata_Well, Metadata_Batch, count(*) AS Metadata_Object_Count, "
    f"{columns('round(median($f), 6) + 0.0 AS $f')} FROM cells "
    "GROUP BY Metadata_Plate, Metadata_Well, Metadata_Batch",
    "well_profiles_mixed": with_tables(CELLS)
    + "SELECT Metadata_PatientID, Metadata_DiseaseGroup, count(*) AS Metadata_Object_Count, "
    f"{columns('round(median($f), 6) + 0.0 AS $f')} FROM cells "
    "GROUP BY Metadata_PatientID, Metadata_DiseaseGroup",
    "normalize_standardize": with_tables(CELLS, wells(), normalized(*STANDARD)) + final_normalized(),
    "normalize_controls": with_tables(
        CELLS,
        wells(),
        "controls AS (SELECT * FROM wells WHERE Metadata_DiseaseGroup = 'BUILDING')",
        normalized(*STANDARD, "controls"),
    )
    + final_normalized(),
    "normalize_controls_constant": with_tables(
        CELLS, wells().replace("wells AS", "raw_wells AS"), flat_controls(), normalized(*STANDARD, "controls")
    )
    + final_normalized(),
    "normalize_controls_constant_mad": with_tables(
        CELLS, wells().replace("wells AS", "raw_wells AS"), flat_controls(), normalized(*ROBUST, "controls")
    )
    + f"SELECT {STRATA}, Metadata_Object_Count, "
    + columns(
        "CASE WHEN abs($f) > 1e9 THEN sign($f) * round(log10(abs($f)), 6) ELSE round($f, 6) + 0.0 END AS $f"
    )
    + " FROM normalized",
    "normalize_spherize_pair": with_tables(CELLS, wells()) + white_pair(*FEATURES[1:3]),
    "normalize_mad": with_tables(CELLS, wells(), normalized(*ROBUST)) + final_normalized(),
    "normalize_mad_hot": with_tables(CELLS, wells(), normalized(*ROBUST)) + final_normalized(),
    "select_variance": with_tables(CELLS, wells()) + frequencies(),
    "select_na": with_tables(CELLS, wells())
    + "SELECT feature, n_missing, round(fraction_missing, 9) + 0.0 AS fraction_missing "
    f"FROM ({missing('wells')})",
    "select_correlation": with_tables(CELLS, wells())
    + f"SELECT a, b, round(r, 6) + 0.0 AS r FROM ({correlations()})",
    "select_correlation_gaps": with_tables(
        CELLS,
        wells(),
        "gappy AS (SELECT *, CAST(NULL AS DOUBLE) AS Cells_Empty, CASE WHEN Metadata_Object_Count > 1 "
        f"THEN {FEATURES[0]} * 2 END AS Cells_Half FROM wells)",
    )
    + "SELECT a, b, round(r, 6) + 0.0 AS r FROM "
    f"({correlations('gappy', [*FEATURES, 'Cells_Empty', 'Cells_Half'])})",
    "selected_features": with_tables(CELLS, wells(), selection())
    + "SELECT operation, feature, max(dropped) AS dropped FROM ("
    + " UNION ALL ".join(
        f"SELECT '{op}' AS operation, '{f}' AS feature, EXISTS (SELECT 1 FROM dropped d "
        f"WHERE d.operation = '{op}' AND d.feature = '{f}') AS dropped"
        for op in ("variance_threshold", "correlation_threshold", "drop_na_columns")
        for f in FEATURES
    )
    + ") GROUP BY operation, feature",
    "consensus_median": with_tables(CELLS, wells()) + consensus("median", "wells"),
    "consensus_mean": with_tables(CELLS, wells(), normalized(*STANDARD))
    + consensus("avg", "normalized"),
    "consensus_modz": with_tables(
        CELLS, wells(), normalized(*STANDARD), MODZ
    ),
    "patient_profiles": with_tables(CELLS, wells(), normalized(*STANDARD), selection())
    + "SELECT * FROM ("
    + union(
        "SELECT Metadata_PatientID, Metadata_DiseaseGroup, '$f' AS feature, "
        "round(median($f), 6) + 0.0 AS value "
        "FROM normalized GROUP BY Metadata_PatientID, Metadata_DiseaseGroup"
    )
    + ") WHERE feature NOT IN (SELECT feature FROM dropped)",
    "replicate_map": with_tables(COSINE) + f"SELECT round(({MAP_VALUE}), 6) AS value",
    "replicate_map_hot": with_tables(COSINE) + f"SELECT round(({MAP_VALUE}), 6) AS value",
    "silhouette_many_labels": with_tables(
        SILHOUETTE.replace(VECTORS, VECTORS.replace("SELECT row_id, label,", "SELECT row_id, row_id // 4 AS label,"))
    )
    + f"SELECT round(({SILHOUETTE_VALUE}), 6) AS value",
    "replicate_map_ranked": with_tables(COSINE) + f"SELECT round(({MAP_VALUE}), 6) AS value",
    "silhouette_cut_labels": with_tables(SILHOUETTE)
    + f"SELECT round(({SILHOUETTE_VALUE}), 6) AS value",
    "silhouette": with_tables(SILHOUETTE) + f"SELECT round(({SILHOUETTE_VALUE}), 6) AS value",
    "label_classifiability": with_tables(VECTORS, classifier("label", "by_label"))
    + "SELECT round(value, 6) + 0.0 AS value FROM by_label",
    "clean_matrix": with_tables(
        VECTORS,
        "width AS (SELECT max(len(e)) AS n FROM v)",
        "entries AS (SELECT row_id, batch, unnest(range(len(e))) AS position, unnest(e) AS x FROM v)",
        "gaps AS (SELECT row_id, batch, position, CASE WHEN x >= 0 THEN x END AS x FROM entries "
        "UNION ALL SELECT row_id, batch, (SELECT n FROM width), NULL FROM v)",
        "middles AS (SELECT position, median(x) AS m FROM gaps GROUP BY position)",
    )
    + "SELECT row_id, batch, position, round(coalesce(x, m, 0.0), 6) AS value FROM gaps JOIN middles USING (position)",
    "scorecard": SCORECARD,
    "scorecard_from_path": SCORECARD,
    "job_summary": job_summary(),
    "batch_mixing": with_tables(VECTORS, mixing("batch", 0, "mix"))
    + "SELECT round(value, 6) AS value FROM mix",
    "batch_mixing_shifted": with_tables(VECTORS, mixing("label", 1, "mix"))
    + "SELECT round(value, 6) AS value FROM mix",
    "chance_level": with_tables(CELLS)
    + "SELECT round(1.0 / count(DISTINCT Metadata_DiseaseGroup), 9) AS value FROM cells",
}
