"""One pass over the features of a table that feeds several decisions.

Each task adds up products of its rows (values, squares and presence of every two features) and counts
the different values of each feature. Both are stored as a small table of packed rows: one
per feature and task for the products, one per feature, task and range of value hashes for the
counts. Correlation, means, deviations, presence and value frequencies then come from that table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .missing import array_of, text

_OR_NAN = "coalesce($, CAST('NaN' AS DOUBLE))"

#: Different values that a task keeps before it hands them on, and rows per range of hashes.
HELD_VALUES = 1_000_000
RANGE_ROWS = 500_000

_SLICE = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PART = "kind int, i int, part int, sums array<double>, found binary, counts binary"
_PRODUCTS, _VALUES = 0, 1


@dataclass(frozen=True)
class Correlation:
    """Rows; mean, population deviation (1 where it is 0 or unknown) and number of values per
    feature; and the Pearson correlation of every two features over the rows that have both."""

    n_rows: int
    mean: np.ndarray
    deviation: np.ndarray
    count: np.ndarray
    matrix: np.ndarray


@dataclass(frozen=True)
class Summary:
    table: DataFrame
    names: tuple[str, ...]
    n_rows: int | None

    def correlation(self) -> Correlation:
        """Pairs with fewer than two common rows, and features that are constant in them,
        correlate 0. What comes to the driver is sized by the features alone."""
        width = len(self.names)
        sums = self.table.where(F.col("kind") == _PRODUCTS).select("i", "sums").groupBy("i")
        schema = "i int, n_rows double, mean double, deviation double, n double, r array<double>"
        found = sorted(sums.applyInPandas(_correlate(width), schema).collect())
        mean, deviation, count, matrix = np.zeros(width), np.ones(width), np.zeros(width), np.eye(width)
        n_rows = 0
        for i, rows, *values, r in found:
            n_rows = int(rows)
            mean[i], deviation[i], count[i] = values
            matrix[i] = r
        return Correlation(n_rows, mean, deviation, count, matrix)

    def frequencies(self) -> DataFrame:
        """Per feature: rows, different values, count of the most and second most frequent one."""
        parts = self.table.where(F.col("kind") == _VALUES).select("i", "part", "found", "counts")
        schema = "i int, n_distinct bigint, top array<bigint>"
        top = parts.groupBy("i", "part").applyInPandas(_count_values, schema)
        top = top.groupBy("i").agg(
            F.sum("n_distinct").alias("n_distinct"),
            F.sort_array(F.flatten(F.collect_list("top")), asc=False).alias("top"),
        )
        named = ", ".join(f"named_struct('i', {i}, 'feature', {text(n)})" for i, n in enumerate(self.names))
        names = self.table.sparkSession.range(1).selectExpr(f"inline(array({named}))")
        # One row per feature.
        return names.join(F.broadcast(top), "i", "left").select(
            "feature",
            F.lit(self.n_rows).cast("bigint").alias("n_rows"),
            F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct"),
            F.get("top", F.lit(0)).alias("first"),
            F.get("top", F.lit(1)).alias("second"),
        )


def summarize(
    rows: DataFrame, names: Sequence[str], *, products: bool = True, values: bool = False
) -> Summary:
    """Scan ``rows`` once. ``names`` are double columns in which NULL is missing. Value counts are
    dealt out by the number of rows, which is counted beforehand without reading a column."""
    n_rows = rows.count() if values else None
    n_ranges = max(1, -(-(n_rows or 0) // RANGE_ROWS))
    vectors = rows.select(array_of(_OR_NAN, names).alias("_v"))
    table = vectors.mapInArrow(_scan(len(names), products, values, n_ranges), _PART)
    return Summary(materialize(table, "summary"), tuple(names), n_rows)


def _scan(width: int, products: bool, values: bool, n_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = None
        sums, count, n_rows = np.zeros((width, 6, width)), np.zeros(width), 0
        held: list[list] = [[] for _ in range(width)]
        n_held = 0
        for batch in batches:
            x = np.asarray(batch.column("_v").flatten()).reshape(len(batch), width)
            if products and len(x):
                if shift is None:
                    shift, scale = _frame(x)
                count += (~np.isnan(x)).sum(axis=0)
                n_rows += len(x)
                for at in range(0, len(x), _SLICE):
                    sums += _products((x[at : at + _SLICE] - shift) / scale)
            if values:
                for i in range(width):
                    column = x[:, i]
                    # Adding 0 makes the two zeros one value.
                    counted = np.unique(column[~np.isnan(column)] + 0.0, return_counts=True)
                    held[i].append(counted)
                    n_held += len(counted[0])
                if n_held > HELD_VALUES:
                    yield _packed(held, n_ranges)
                    held, n_held = [[] for _ in range(width)], 0
        if n_held:
            yield _packed(held, n_ranges)
        if shift is not None:
            head = np.stack([shift, scale, count, np.full(width, n_rows)]).ravel()
            rows = [np.concatenate([head, sums[i].ravel()]) for i in range(width)]
            yield _table([_PRODUCTS] * width, list(range(width)), [0] * width, rows, None, None)

    return run


def _table(kinds: list, features: list, parts: list, sums: list | None, found: list | None, counts: list | None):
    n = len(kinds)
    columns = [
        pa.array(kinds, pa.int32()),
        pa.array(features, pa.int32()),
        pa.array(parts, pa.int32()),
        pa.array(sums or [None] * n, pa.list_(pa.float64())),
        pa.array(found or [None] * n, pa.binary()),
        pa.array(counts or [None] * n, pa.binary()),
    ]
    return pa.record_batch(columns, names=["kind", "i", "part", "sums", "found", "counts"])


def _frame(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a task measures from, and in which unit: a middle value and the spread around it. The
    shift is one of the values, so a constant feature has only zeros."""
    shift, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    for i, column in enumerate(x.T):
        there = column[np.isfinite(column)]
        if len(there):
            shift[i] = np.partition(there, len(there) // 2)[len(there) // 2]
            spread = np.sqrt(np.mean((there - shift[i]) ** 2))
            scale[i] = spread if 0 < spread < np.inf else 1.0
    return shift, scale


def _products(z: np.ndarray) -> np.ndarray:
    present = (~np.isnan(z)).astype(float)
    z = np.nan_to_num(z, nan=0.0, posinf=np.inf, neginf=-np.inf)
    square = z * z
    pairs = (
        present.T @ present,
        z.T @ present,
        present.T @ z,
        square.T @ present,
        present.T @ square,
        z.T @ z,
    )
    return np.stack(pairs, axis=1)


def _correlate(width: int):
    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        i = key[0]
        stack = np.stack(list(parts["sums"])).reshape(-1, 10, width)
        shift, scale, count, rows, n, x, y, xx, yy, xy = stack.transpose(1, 0, 2)
        # The tasks' sums are moved to one origin and unit per feature, then added up.
        largest = count.argmax(axis=0)
        origin, unit = shift[largest, np.arange(width)], scale.max(axis=0)
        ratio, move = scale / unit, (shift - origin) / unit
        own_ratio, own_move = ratio[:, [i]], move[:, [i]]
        sx = (own_ratio * x + own_move * n).sum(axis=0)
        sy = (ratio * y + move * n).sum(axis=0)
        sxx = (own_ratio**2 * xx + 2 * own_ratio * own_move * x + own_move**2 * n).sum(axis=0)
        syy = (ratio**2 * yy + 2 * ratio * move * y + move**2 * n).sum(axis=0)
        sxy = own_ratio * ratio * xy + own_ratio * move * x + own_move * ratio * y
        sxy = (sxy + own_move * move * n).sum(axis=0)
        n = n.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            covariance = sxy - sx * sy / n
            spread = np.maximum(sxx - sx * sx / n, 0) * np.maximum(syy - sy * sy / n, 0)
            r = covariance / np.sqrt(spread)
        r[(n < 2) | ~(spread > 1e-24 * np.maximum(n, 1) ** 2)] = 0.0
        r[i] = 1.0
        mean, variance = origin[i], 0.0
        if n[i]:
            mean += unit[i] * sx[i] / n[i]
            variance = max(sxx[i] / n[i] - (sx[i] / n[i]) ** 2, 0.0)
        deviation = unit[i] * np.sqrt(variance) or 1.0
        values = (i, rows[:, i].sum(), mean, deviation, n[i], np.clip(r, -1.0, 1.0))
        return pd.DataFrame([values], columns=["i", "n_rows", "mean", "deviation", "n", "r"])

    return run


def _packed(held: list[list], n_ranges: int) -> pa.RecordBatch:
    features, parts, found, counts = [], [], [], []
    for i, pieces in enumerate(held):
        values, counted = _added(pieces)
        with np.errstate(over="ignore"):
            mixed = values.view(np.uint64) * _MIX
            part = ((mixed ^ (mixed >> np.uint64(32))) * _MIX >> np.uint64(33)) % np.uint64(n_ranges)
        order = np.argsort(part, kind="stable")
        names, starts = np.unique(part[order], return_index=True)
        for p, mine in zip(names.tolist(), np.split(order, starts[1:])):
            features.append(i)
            parts.append(p)
            found.append(values[mine].tobytes())
            counts.append(counted[mine].tobytes())
    return _table([_VALUES] * len(features), features, parts, None, found, counts)


def _added(pieces: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different values of all pieces and their summed counts."""
    values = np.concatenate([np.empty(0), *[v for v, _ in pieces]])
    counts = np.concatenate([np.empty(0, np.int64), *[c for _, c in pieces]])
    values, place = np.unique(values, return_inverse=True)
    total = np.zeros(len(values), dtype=np.int64)
    np.add.at(total, place, counts)
    return values, total


def _count_values(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    pieces = [
        (np.frombuffer(v, dtype=float), np.frombuffer(c, dtype=np.int64))
        for v, c in zip(parts["found"], parts["counts"])
    ]
    values, counts = _added(pieces)
    return pd.DataFrame({"i": [key[0]], "n_distinct": [len(values)], "top": [np.sort(counts)[::-1][:2]]})
