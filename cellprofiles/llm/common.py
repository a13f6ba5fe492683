"""What several text operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of ``documents``; pipeline stages return these, in this order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A word in the sense of the size contracts: no ASCII white space in it.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; none for NULL."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def document_columns(docs: DataFrame) -> Sequence[str]:
    """Those columns of ``documents`` that a table has."""
    return [name for name in DOCUMENT_COLUMNS if name in docs.columns]
