"""Token ids of a corpus in compressed files: a wavelet matrix per shard.

Documents are sorted by id over ranges; every task encodes its range, cuts it into shards of a
bounded number of tokens at document ends and writes each as one record with the ids and
lengths of its documents, its place, and the bit-planes of a wavelet matrix. From these
alone a reader gets single tokens, counts and positions of a token, and all ids of a document.
Spark writes the records as Parquet, so they can be in any store it reaches, and a lost
executor costs its own tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import Encoder, EncoderSource
from .wavelet import WaveletMatrix

#: Tokens from which on a shard is full; it ends with the document that fills it.
SHARD_TOKENS = 1 << 19

#: Id after each document.
END_ID = 2

_FORMAT = "before long, doc_ids array<long>, sizes array<long>, n_tokens long, matrix binary"


def _shards(
    batches: Iterator[pd.DataFrame], encoder: Encoder, end_id: int, shard_tokens: int
) -> Iterator[pd.DataFrame]:
    end = np.array([end_id], dtype="<u4").tobytes()
    before, held, ids, parts, sizes = 0, 0, [], [], []

    def record() -> pd.DataFrame:
        symbols = np.frombuffer(b"".join(parts), dtype="<u4")
        if symbols.max(initial=0) < 1 << 16:
            symbols = symbols.astype(np.uint16)
        matrix = WaveletMatrix.build(symbols).to_bytes()
        row = (before, np.array(ids, dtype=object), np.array(sizes), len(symbols), matrix)
        return pd.DataFrame([row], columns=["before", "doc_ids", "sizes", "n_tokens", "matrix"])

    for batch in batches:
        names = [None if pd.isna(x) else int(x) for x in batch.doc_id]
        for name, found in zip(names, encoder.encode(list(batch.text)), strict=True):
            ids.append(name)
            parts.append(found + end)
            sizes.append(len(found) // 4 + 1)
            held += sizes[-1]
            if held >= shard_tokens:
                yield record()
                before, held, ids, parts, sizes = before + held, 0, [], [], []
    if ids:
        yield record()


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
    special: bool = False,
) -> None:
    """Encode ``docs`` (``doc_id`` long, ``text``) to files below ``path``.

    Order is by ``doc_id``, NULL first, then by a hash of the text; repeated rows are written
    each. NULL and empty texts are the end id alone. An empty table writes no record. ``special``
    says whether the tokenizer's added tokens are looked for in texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(EncoderSource(tokenizer, special=special))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _shards(batches, shared.value.encoder(), end_id, shard_tokens)

    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    written = ordered.mapInPandas(encode, _FORMAT).withColumn("part", F.spark_partition_id())
    written.write.option("compression", "zstd").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records with ``start``, the tokens before each in the whole corpus.

    Tokens before a record within its range are stored; the table of ranges has a row per
    task that wrote, so one task adds them up.
    """
    schema = f"{_FORMAT}, part int"
    records = spark.read.schema(schema).parquet(path)
    totals = records.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = F.sum("total").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("total")
    bases = totals.select("part", earlier.alias("base"))
    records = records.join(F.broadcast(bases), "part")
    return records.withColumn("start", F.col("base") + F.col("before")).drop("base")


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            data = memoryview(WaveletMatrix.from_bytes(row.matrix).decode().astype("<u4").tobytes())
            sizes = np.array(row.sizes, dtype=np.int64)
            stops = np.cumsum(sizes)
            ends = zip((4 * (stops - sizes)).tolist(), (4 * stops).tolist(), strict=True)
            yield pd.DataFrame(
                {
                    "doc_id": pd.array(list(row.doc_ids), dtype="Int64"),
                    "start": row.start + stops - sizes,
                    "n_tokens": sizes,
                    "ids_crc32": [zlib.crc32(data[a:b]) for a, b in ends],
                }
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all documents before; the checksum is that of the decoded
    ids as little-endian unsigned 32-bit integers.
    """
    records = read_records(spark, path).select("doc_ids", "sizes", "matrix", "start")
    return records.mapInPandas(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_positions(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``position`` in the corpus of every occurrence of a token, by select in each record."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = WaveletMatrix.from_bytes(row.matrix).occurrences(token)
                yield pd.DataFrame({"position": row.start + found})

    return read_records(spark, path).select("matrix", "start").mapInPandas(find, "position long")


def token_count(spark: SparkSession, path: str, token: int) -> DataFrame:
    """One row with ``n``, the occurrences of a token, by rank in each record."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {"n": [WaveletMatrix.from_bytes(m).count(token) for m in batch.matrix]}
            )

    counted = read_records(spark, path).select("matrix").mapInPandas(count, "n long")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """``position`` and ``token`` for single positions in the corpus, by access."""
    wanted = np.array(sorted(set(positions)), dtype=np.int64)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                inside = wanted[(wanted >= row.start) & (wanted < row.start + row.n_tokens)]
                found = WaveletMatrix.from_bytes(row.matrix).access(inside - row.start)
                yield pd.DataFrame({"position": inside, "token": found})

    records = read_records(spark, path).select("matrix", "start", "n_tokens")
    return records.mapInPandas(look, "position long, token long")
