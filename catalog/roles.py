"""Driver tables in the roles the operators expect.

Each role is one SELECT that Spark and DuckDB both run; ``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: One row per line item as a cell; a zero discount stands for a missing value.
CELLS = """
SELECT CAST(o.o_custkey AS STRING) AS Metadata_PatientID,
       l.l_returnflag || '_' || l.l_linestatus || '_' || o.o_orderpriority AS Metadata_SampleID,
       l.l_returnflag || '_' || l.l_linestatus AS Metadata_Plate,
       o.o_orderpriority AS Metadata_Well,
       l.l_returnflag AS Metadata_Batch,
       c.c_mktsegment AS Metadata_DiseaseGroup,
       CAST(l.l_orderkey AS INT) AS Metadata_ImageNumber,
       CAST(l.l_linenumber AS INT) AS Metadata_ObjectNumber,
       l.l_extendedprice AS Cells_AreaShape_Area,
       l.l_tax AS Cells_Intensity_MeanIntensity_DNA,
       nullif(l.l_discount, CAST(0.0 AS DOUBLE)) AS Cytoplasm_Texture_Contrast_Actin,
       l.l_quantity AS Nuclei_AreaShape_Area,
       l.l_extendedprice * (1.0E0 - l.l_discount) AS Nuclei_Intensity_IntegratedIntensity_DNA
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
"""
FEATURES = [
    "Cells_AreaShape_Area",
    "Cells_Intensity_MeanIntensity_DNA",
    "Cytoplasm_Texture_Contrast_Actin",
    "Nuclei_AreaShape_Area",
    "Nuclei_Intensity_IntegratedIntensity_DNA",
]

#: Raw site table: orders as images, the customer's part as treatment. Urgent orders get a
#: dose that the lookup does not know.
RAW_SITES = """
SELECT o.o_custkey AS TableNumber,
       o.o_orderkey AS ImageNumber,
       o.o_orderstatus AS Image_Metadata_Plate_DAPI,
       o.o_orderpriority AS Image_Metadata_Well_DAPI,
       o.o_custkey AS Replicate,
       p.p_brand AS Image_Metadata_Compound,
       p.p_retailprice + CASE WHEN o.o_orderpriority = '1-URGENT' THEN 0.005E0 ELSE 0.0E0 END
           AS Image_Metadata_Concentration
FROM {orders} o
LEFT JOIN {part} p ON o.o_custkey = p.p_partkey
"""
MOA = """
SELECT p_brand AS compound, p_retailprice + 1.0E-9 AS concentration, p_type AS moa FROM {part}
"""

#: Canonical sites without patients: many wells on five plates.
SITES = """
SELECT CAST(o_custkey AS STRING) AS Metadata_TableNumber,
       CAST(o_orderkey AS INT) AS Metadata_ImageNumber,
       'plate ' || o_orderpriority AS Metadata_Plate,
       'W' || CAST(o_custkey AS STRING) AS Metadata_Well,
       CAST(1 AS INT) AS Metadata_Site,
       CAST(1 AS INT) AS Metadata_Replicate,
       o_orderstatus AS Metadata_Compound,
       CAST(0.5 AS DOUBLE) AS Metadata_Concentration,
       o_orderstatus AS Metadata_MoA
FROM {orders}
"""
PATIENTS = """
SELECT CAST(c_custkey AS STRING) AS Metadata_PatientID,
       c_mktsegment AS Metadata_DiseaseGroup,
       c_name AS Metadata_FailureType,
       CAST(c_nationkey AS INT) AS Metadata_Age,
       CASE WHEN c_acctbal < 0.0 THEN 'F' ELSE 'M' END AS Metadata_Sex
FROM {customer}
"""
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

#: Sites with all sample metadata.
ASSIGNED_SITES = """
SELECT CAST(o.o_orderkey AS INT) AS Metadata_ImageNumber,
       o.o_orderstatus AS Metadata_Plate,
       o.o_orderpriority AS Metadata_Well,
       CAST(2 AS INT) AS Metadata_Site,
       CAST(1 AS INT) AS Metadata_Replicate,
       o.o_orderstatus || '_' || o.o_orderpriority AS Metadata_SampleID,
       o.o_orderstatus AS Metadata_Batch,
       CAST(c.c_custkey AS STRING) AS Metadata_PatientID,
       c.c_mktsegment AS Metadata_DiseaseGroup,
       c.c_name AS Metadata_FailureType,
       CAST(c.c_nationkey AS INT) AS Metadata_Age,
       CASE WHEN c.c_acctbal < 0.0 THEN 'F' ELSE 'M' END AS Metadata_Sex,
       o.o_orderpriority AS Metadata_Compound,
       o.o_totalprice AS Metadata_Concentration,
       CAST(NULL AS STRING) AS Metadata_MoA
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

#: Compartments: line items by unique (order, line number); nuclei exist where some line
#: has a discount.
CYTOPLASM = """
SELECT l_orderkey AS ImageNumber, CAST(l_linenumber AS BIGINT) AS ObjectNumber,
       min(l_quantity) AS AreaShape_Area, max(l_tax) AS Texture_Contrast_Actin,
       CAST(l_linenumber AS BIGINT) AS Number_Object_Number,
       CAST(l_linenumber AS BIGINT) AS Parent_Cells, CAST(l_linenumber AS BIGINT) AS Parent_Nuclei
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""
CELL_TABLE = """
SELECT l_orderkey AS ImageNumber, CAST(l_linenumber AS BIGINT) AS ObjectNumber,
       max(l_extendedprice) AS AreaShape_Area,
       CAST(l_linenumber AS BIGINT) AS Number_Object_Number
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""
NUCLEI = """
SELECT l_orderkey AS ImageNumber, CAST(l_linenumber AS BIGINT) AS ObjectNumber,
       max(l_discount) AS Intensity_MeanIntensity_DNA,
       CAST(l_linenumber AS BIGINT) AS Number_Object_Number
FROM {lineitem} WHERE l_discount > 0.0 GROUP BY l_orderkey, l_linenumber
"""
IMAGES = """
SELECT o_orderkey AS ImageNumber, o_orderpriority || '.tif' AS Image_FileName_DNA,
       o_orderstatus AS Metadata_Plate
FROM {orders}
"""

CLINICAL = """
SELECT CAST(o_custkey AS STRING) AS Metadata_PatientID,
       max(o_totalprice) AS ejection_fraction,
       CAST(count(*) AS INT) AS nyha_class,
       min(o_totalprice) AS bnp_pg_per_ml,
       max(o_orderstatus) = 'P' AS on_beta_blocker,
       CAST(count(*) * 10 AS INT) AS days_since_diagnosis
FROM {orders} GROUP BY o_custkey
"""
SNRNA = """
SELECT CAST(o_custkey AS STRING) AS Metadata_PatientID,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'Fibroblast' ELSE o_orderpriority END AS cell_type,
       CAST(count(*) AS INT) AS n_nuclei,
       CAST(count(*) AS DOUBLE) / 64.0E0 AS fraction_of_sample,
       max(o_totalprice) AS mean_genes_per_nucleus,
       min(o_totalprice) AS marker_score
FROM {orders} GROUP BY o_custkey, o_orderpriority
"""
MORPHOLOGY = """
SELECT CAST(o.o_custkey AS STRING) AS Metadata_PatientID,
       'unused' AS Metadata_DiseaseGroup, 'unused' AS Metadata_FailureType,
       max(l.l_extendedprice) AS Cells_AreaShape_Area, min(l.l_quantity) AS Nuclei_AreaShape_Area
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_custkey
"""

EVENTS = """
SELECT CAST(event_id AS BIGINT) AS Metadata_EventID, event_type AS Metadata_Batch,
       value AS Nuclei_AreaShape_Area
FROM {events}
"""
EMBEDDINGS = """
SELECT vec_id AS row_id, CAST(label AS STRING) AS label,
       CAST(vec_id % 2 AS STRING) AS batch, embedding
FROM {embeddings}
"""


def for_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A role as a DataFrame over the Parquet tables in ``sf_dir``."""
    tables = set(re.findall(r"{(\w+)}", sql))
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(sql, **frames)


def for_oracle(sql: str) -> str:
    """A role as SQL over the registered views."""
    return re.sub(r"{(\w+)}", r"\1", sql).strip()
