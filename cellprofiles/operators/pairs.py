"""Pairwise comparison of profiles in tiles, reduced before anything leaves a tile.

Metrics over all pairs of n rows need n * n comparisons but no table of pairs. Rows go to
blocks by a hash of their identity; the comparison matrix falls into tiles of one block
against another (the matrix scheme for theta joins of Okcan and Riedewald, SIGMOD 2011).
A task holds two blocks of bounded size and hands on a reduction of their tile: nearest
rows, sums per label, or counts per similarity. Labels play no part in the blocking, so
one label may hold any share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.median import grouped_median
from ..functions.missing import array_of, clean_features, one_row, quoted
from ..schema import numeric_features
from ..session import materialize

#: Rows and values per block at most (about), i.e. 64 MB of vectors on each side of a tile. Rows are
#: sent once per block of the other side, so large blocks keep the shuffle small.
BLOCK_ROWS = 131_072
BLOCK_VALUES = 1 << 23

#: Query rows, and candidates, compared at a time inside a tile; bounds the scratch matrices, which
#: should fit a core's cache.
_SLICE = 256
_CHUNK = 1024

#: Part of the squared lengths below which a squared distance is taken by differences, because the
#: product leaves too few digits, and values of such pairs at a time.
_CLOSE = 1e-4
_CLOSE_VALUES = 1 << 18

#: Largest distances from the middle, along one feature, for which bounds are made in single precision; and what
#: these are lowered by, as it has nothing much smaller.
_SINGLE = 1e-12, 1e15
_LEAST = 1e-35

_MIN_BLOCK_ROWS = 128


def label_column(name: str) -> str:
    """The name of a label in the prepared table, without the marks that column paths use."""
    return name.replace("%", "%25").replace(".", "%2E").replace("`", "%60")


@dataclass(frozen=True)
class Profiles:
    """Written table ``_row, _tie, labels..., _vec`` with its size; labels are named as
    :func:`label_column` has it."""

    table: DataFrame
    n_rows: int
    n_features: int
    labels: tuple[str, ...]

    def blocks(self, most_rows: int | None = None) -> int:
        """Enough blocks to bound their size (by ``most_rows`` as well) and to give every core a
        tile."""
        cores = self.table.sparkSession.sparkContext.defaultParallelism
        useful = min(math.ceil(math.sqrt(4 * cores)), math.ceil(self.n_rows / _MIN_BLOCK_ROWS))
        rows = max(_MIN_BLOCK_ROWS, min(BLOCK_ROWS, BLOCK_VALUES // max(self.n_features, 1)))
        return max(1, useful, math.ceil(self.n_rows / min(rows, most_rows or rows)))


def prepare_profiles(
    profiles: DataFrame,
    labels: Sequence[str],
    features: Sequence[str] | None = None,
    row_id: str | None = None,
) -> Profiles:
    """Clean vectors with a fixed row identity.

    Features without any value count as 0 everywhere, which neither distance nor cosine
    notices; other gaps get the feature's median. Ties between equally near rows go by
    ``row_id``, a unique integer column. Without one they go by a hash of the row; only
    identical rows can share it, and those are interchangeable.
    """
    names = numeric_features(profiles, features)
    if row_id in names:
        names.remove(row_id)
    labels = tuple(dict.fromkeys(labels))
    if row_id is None:
        tie, row = F.xxhash64(*map(quoted, profiles.columns)), F.monotonically_increasing_id()
    else:
        tie = row = F.col(quoted(row_id)).cast("long")
    rows = clean_features(profiles, names).select(
        row.alias("_row"),
        tie.alias("_tie"),
        *[F.col(quoted(c)).cast("string").alias(label_column(c)) for c in labels],
        *map(quoted, names),
    )
    if names:
        filled = rows.withColumn("_m", one_row(grouped_median(rows.select(*map(quoted, names)), [], names)))
        vector = array_of("coalesce($, _m.$, 0D)", names)
    else:
        filled, vector = rows, F.array().cast("array<double>")
    named = map(label_column, labels)
    table = materialize(filled.select("_row", "_tie", *named, vector.alias("_vec")), "vectors")
    present = array_of("count($)", names) if names else F.array().cast("array<bigint>")
    n_rows, counts = rows.agg(F.count("*"), present).first()
    return Profiles(table, n_rows, sum(n > 0 for n in counts), labels)


def prepare_vectors(
    rows: DataFrame, vector: str, labels: Sequence[str], row_id: str
) -> Profiles:
    """The same from an array column without gaps, e.g. stored embeddings.

    Vectors of different lengths, and missing ones, are an error.
    """
    table = rows.select(
        F.col(row_id).cast("long").alias("_row"),
        F.col(row_id).cast("long").alias("_tie"),
        *[F.col(quoted(c)).cast("string").alias(label_column(c)) for c in dict.fromkeys(labels)],
        F.col(vector).cast("array<double>").alias("_vec"),
    )
    size = F.coalesce(F.size(vector), F.lit(-1))
    n_rows, least, width = rows.agg(F.count("*"), F.min(size), F.max(size)).first()
    if least != width or (width or 0) < 0:
        raise ValueError(f"'{vector}' has vectors of {least} to {width} values")
    return Profiles(table, n_rows, width or 0, tuple(dict.fromkeys(labels)))


class Block:
    """One side of a tile as arrays."""

    def __init__(self, table: pa.Table):
        self.rows = table.column("_row").to_numpy()
        self.ties = table.column("_tie").to_numpy()
        flat = table.column("_vec").combine_chunks()
        values = np.asarray(flat.flatten(), dtype=float)
        self.vectors = values.reshape(len(self.rows), -1)
        self.table = table

    def column(self, name: str) -> pa.Array:
        column = self.table.column(name).combine_chunks()
        return column if isinstance(column, pa.Array) else column.chunk(0)


def label_codes(left: Block, right: Block, name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Integer codes of a label that agree between both sides, and their dictionary.
    A NULL label is a label like any other."""
    both = pa.chunked_array([left.column(name), right.column(name)]).combine_chunks()
    if isinstance(both, pa.ChunkedArray):
        both = both.chunk(0)
    coded = both.dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    cut = len(left.rows)
    return codes[:cut], codes[cut:], coded.dictionary


def slices(n: int) -> Iterator[slice]:
    return (slice(i, min(i + _SLICE, n)) for i in range(0, n, _SLICE))


def paired_squares(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the row at the same place. By differences: exactly 0 for copies, and the
    same number for a pair in whatever tile it is met, as each row is summed up on its own."""
    difference = queries - candidates
    difference *= difference
    return difference.sum(axis=1)


class Squares:
    """Squared distances of queries to a block of candidates by matrix products.

    Vectors are measured from the middle of the block. Two more entries add the squared lengths, so a product is the
    squared distance. It is off by ``error`` times the sum of both squared lengths at most, so callers take what it
    leaves open by differences. Bounds are made in single precision where that holds them: they only pass over what is too far.
    """

    def __init__(self, candidates: np.ndarray):
        self.candidates = candidates
        finite = candidates[np.isfinite(candidates).all(axis=1)]
        self.center = finite.mean(axis=0) if len(finite) else np.zeros(candidates.shape[1])
        with np.errstate(invalid="ignore", over="ignore"):
            moved = candidates - self.center
            self.lengths = (moved * moved).sum(axis=1)
            largest = np.abs(moved[np.isfinite(self.lengths)]).max(initial=0.0)
        self.kind = np.float32 if _SINGLE[0] < largest < _SINGLE[1] else np.float64
        self.error = 4 * (candidates.shape[1] + 8) * float(np.finfo(self.kind).eps)

    @cached_property
    def wide(self) -> np.ndarray:
        return self._table(self.lengths, np.float64)

    @cached_property
    def narrow(self) -> np.ndarray:
        return self._table((1.0 - self.error) * self.lengths, self.kind)

    def _table(self, lengths: np.ndarray, kind: type) -> np.ndarray:
        """A column per candidate: its vector, 1 and its squared length."""
        n, width = self.candidates.shape
        table = np.ones((width + 2, n), dtype=kind)
        with np.errstate(invalid="ignore", over="ignore"):
            for row, values, middle in zip(table, self.candidates.T, self.center):
                row[:] = values - middle
            table[-1] = lengths
        return table

    def chunks(self) -> Iterator[slice]:
        n = len(self.candidates)
        return (slice(i, min(i + _CHUNK, n)) for i in range(0, n, _CHUNK))

    def queries(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors times -2 as seen from the middle, their squared lengths and 1; these lengths; and the first
        as :meth:`at_least` needs it."""
        with np.errstate(invalid="ignore", over="ignore"):
            moved = vectors - self.center
            lengths = (moved * moved).sum(axis=1)[:, None]
            rows = np.hstack([-2.0 * moved, lengths, np.ones_like(lengths)])
            narrow = rows.astype(self.kind)
            narrow[:, -2] = (1.0 - self.error) * lengths[:, 0] - _LEAST
        return rows, lengths, narrow

    def limits(self, squares: np.ndarray) -> np.ndarray:
        """Squared distances, rounded up, in the precision of :meth:`at_least`."""
        with np.errstate(over="ignore"):
            rounded = np.nextafter(squares.astype(self.kind), self.kind(np.inf))
        rounded[squares > np.finfo(self.kind).max / 16] = np.inf
        return rounded

    def at_least(self, queries: tuple[np.ndarray, np.ndarray, np.ndarray], chunk: slice) -> np.ndarray:
        """Lower bounds of the squared distances, NaN where a product has none."""
        with np.errstate(invalid="ignore", over="ignore"):
            return queries[2] @ self.narrow[:, chunk]

    def exact(self, vectors: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """By differences for the pairs of places ``q`` in ``vectors`` and ``c`` in the block."""
        step = max(1, _CLOSE_VALUES // max(vectors.shape[1], 1))
        parts = [
            paired_squares(vectors[q[i : i + step]], self.candidates[c[i : i + step]])
            for i in range(0, len(q), step)
        ]
        return np.concatenate(parts) if parts else np.empty(0)

    def of(
        self, vectors: np.ndarray, queries: tuple[np.ndarray, np.ndarray, np.ndarray], chunk: slice
    ) -> np.ndarray:
        """Squared distances to a chunk; near pairs and such with infinite values by differences."""
        rows, lengths, _ = queries
        with np.errstate(invalid="ignore", over="ignore"):
            squares = rows @ self.wide[:, chunk]
            there = self.lengths[chunk]
            # Most queries are near to no candidate.
            some = np.flatnonzero(~(squares.min(axis=1) > _CLOSE * (lengths[:, 0] + there.max())))
            if len(some):
                q, c = np.nonzero(~(squares[some] > _CLOSE * (lengths[some] + there)))
                q = some[q]
                squares[q, c] = self.exact(vectors, q, c + chunk.start)
        return squares


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    lengths = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return vectors / np.where(lengths > 0, lengths, 1.0)


def tiles(
    profiles: Profiles,
    columns: Sequence[str],
    reduce_tile: Callable[..., pa.Table | Iterator[pa.Table]],
    schema: str,
    *,
    query_columns: Sequence[str] = (),
    queries: Column | None = None,
    candidate_block: tuple[Column, int] | None = None,
    block_rows: int | None = None,
    query_blocks: tuple[int, int] | None = None,
    streamed: bool = False,
) -> DataFrame:
    """Run ``reduce_tile(queries, candidates)`` on every tile.

    Each row is sent once per block of the other side: n / BLOCK_ROWS copies at scale.
    ``query_columns`` travel with the copies that act as queries only, and ``queries``
    says which rows act as queries at all. ``candidate_block`` puts candidates into one of a number
    of blocks (default: by the hash that puts queries into theirs); ``block_rows`` lowers the
    size of blocks. ``query_blocks`` runs the tiles of these blocks of queries only, from the first to
    before the last. ``streamed`` has a task per block of queries, where ``reduce_tile`` gets the batches
    of all its tiles (``_query`` tells the queries) and yields tables.
    """
    n_blocks = profiles.blocks(block_rows)
    own = F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).cast("int").alias("_own")
    column, n_candidate = candidate_block or (F.col("_own"), n_blocks)
    as_candidate = column.cast("int").alias("_as_candidate")
    start, stop = query_blocks or (0, n_blocks)
    every = F.sequence(F.lit(0), F.lit(max(n_blocks, n_candidate) - 1))
    if query_blocks is not None:
        # Rows that ask nothing now are candidates of these blocks alone.
        asked = (F.col("_own") >= start) & (F.col("_own") < stop)
        every = F.when(asked, every).otherwise(F.sequence(F.lit(start), F.lit(stop - 1)))
    other = F.explode(every).alias("_other")

    def place(query: str, candidate: str, is_query: bool) -> Column:
        return F.struct(
            F.col(query).alias("_q"), F.col(candidate).alias("_c"), F.lit(is_query).alias("_query")
        )

    # A row is a query against every candidate block and a candidate for every query block.
    sides = F.filter(
        F.array(place("_own", "_other", True), place("_other", "_as_candidate", False)),
        lambda side: (side["_q"] >= start)
        & (side["_q"] < stop)
        & (~side["_query"] | (side["_c"] < n_candidate)),
    )
    carried = ["_row", "_tie", *columns, "_vec", *query_columns]
    asks = F.lit(True) if queries is None else queries
    rows = (
        profiles.table.select("*", own)
        .select(*carried, "_own", as_candidate, asks.alias("_asks"))
        .select("*", other)
        .select(*carried, "_asks", F.inline(sides))
        .where(~F.col("_query") | F.col("_asks"))
        .withColumns({c: F.when(F.col("_query"), F.col(c)) for c in query_columns})
        .drop("_asks")
    )
    fields = pa.schema(parse_schema(schema))

    def run_streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in reduce_tile(batches):
            yield from table.select(fields.names).to_batches()

    if streamed:
        return rows.repartitionById(n_blocks, F.col("_q")).mapInArrow(run_streamed, schema)

    def run(tile: pa.Table) -> pa.Table:
        query = tile.column("_query")
        asking, candidates = tile.filter(query), tile.filter(pc.invert(query))
        if not len(asking) or not len(candidates):
            return fields.empty_table()
        return reduce_tile(Block(asking), Block(candidates)).select(fields.names)

    return rows.groupBy("_q", "_c").applyInArrow(run, schema)


_ARROW_TYPES = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
}


def parse_schema(schema: str) -> list[pa.Field]:
    pairs = [part.split() for part in schema.split(",")]
    return [pa.field(name, _ARROW_TYPES[kind]) for name, kind in pairs]

