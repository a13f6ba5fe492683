"""Whitening of embeddings by spectral divide and conquer.

Embeddings are put on a grid of whole numbers, each different vector is counted once, and the
covariance of these is decomposed into components, along which every row is then projected and scaled
to variance 1.

The decomposition uses polar factors only (QDWH, Nakatsukasa and Higham 2013). The unitary polar factor of a
shifted symmetric matrix is its matrix sign, so half of (identity + sign) projects on
the subspace of the eigenvalues above the shift. Bases of that subspace and of its complement
cut the matrix into two smaller ones, which are divided in the same way until a block is
a multiple of the identity. Only blocks that hold wanted components are divided further.

The matrix is sized by the dimension of the vectors alone, ``MAX_DIMENSION`` at most. Sums and
products over vectors are added up by the tasks, and what is broadcast is one matrix of
components by dimensions.

Rows whose vector is NULL or has NULL, NaN or infinite entries are left out. Shorter vectors count as
zero in the dimensions that they lack. Repeated rows keep their own result, and count once. An
empty table, or one without usable vectors, gives no rows. Directions without any variance
(the vectors are alike, or too few) have whitened NULL and explain 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Steps of the grid per unit.
GRID = 256

#: Components that are returned.
COMPONENTS = 4

#: Largest dimension whose covariance a task may hold, 128 MB.
MAX_DIMENSION = 4096

#: Steps of a polar decomposition at most, shifts tried for a block, and accuracy.
_POLAR_STEPS, _SHIFTS = 30, 8
_EPS = float(np.finfo(float).eps)

_SLICE = 1024


# --- spectral divide and conquer ----------------------------------------------------


def polar_factor(matrix: np.ndarray) -> np.ndarray:
    """Unitary polar factor by the dynamically weighted Halley iteration, in its QR form."""
    n = len(matrix)
    x = matrix / max(np.linalg.norm(matrix, 1), np.finfo(float).tiny)
    # A lower bound of the least singular value, from the triangular factor.
    r = np.linalg.qr(x, mode="r")
    try:
        low = 1.0 / (np.abs(np.linalg.inv(r)).sum(axis=0).max() * np.sqrt(n))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, _EPS), 1.0)
    for _ in range(_POLAR_STEPS):
        square = low * low
        d = np.cbrt(4.0 * (1.0 - square) / square**2)
        root = np.sqrt(1.0 + d)
        a = root + 0.5 * np.sqrt(8.0 - 4.0 * d + 8.0 * (2.0 - square) / (square * root))
        b = (a - 1.0) ** 2 / 4.0
        c = a + b - 1.0
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        better = (b / c) * x + (a - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        better = (better + better.T) / 2.0
        low = min(low * (a + b * square) / (1.0 + c * square), 1.0)
        change = np.linalg.norm(better - x)
        x = better
        if abs(low - 1.0) < 10 * _EPS and change < np.cbrt(5 * _EPS):
            break
    return x


def _orthonormal_range(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Bases of a projector's range and of its complement: QR of the columns that stick out most,
    then one step of subspace iteration."""
    left, picked = projector.copy(), []
    for _ in range(rank):
        at = int(np.argmax((left**2).sum(axis=0)))
        unit = left[:, at] / np.linalg.norm(left[:, at])
        left -= np.outer(unit, unit @ left)
        picked.append(at)
    basis, _ = np.linalg.qr(projector[:, picked])
    full, _ = np.linalg.qr(projector @ basis, mode="complete")
    return full[:, :rank], full[:, rank:]


def _divide(matrix: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift, upper one first; None if the
    matrix is a multiple of the identity as far as can be told."""
    n = len(matrix)
    if n < 2:
        return None
    diagonal = np.diag(matrix)
    rest = matrix - np.diag(diagonal)
    if np.ptp(diagonal) + np.linalg.norm(rest) <= 4 * n * _EPS * scale:
        return None
    # Eigenvalues lie on both sides of the mean unless all agree. The median of the diagonal
    # parts most matrices into halves; the others help where an eigenvalue is too close to it.
    mean = float(np.trace(matrix)) / n
    deviation = np.linalg.norm(matrix - mean * np.eye(n)) / np.sqrt(n)
    shifts = [float(np.median(diagonal)), mean]
    shifts += [mean + deviation * t for t in np.linspace(-0.61, 0.57, _SHIFTS)]
    best = None
    for shift in shifts:
        sign = polar_factor(matrix - shift * np.eye(n))
        projector = (np.eye(n) + sign) / 2.0
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        upper, lower = _orthonormal_range(projector, rank)
        coupling = float(np.linalg.norm(lower.T @ matrix @ upper))
        if best is None or coupling < best[0]:
            best = coupling, upper, lower
        if coupling <= 4 * n * _EPS * scale:
            break
    return None if best is None else (best[1], best[2])


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their eigenvectors as
    columns."""
    matrix = (matrix + matrix.T) / 2.0
    n = len(matrix)
    scale = float(np.linalg.norm(matrix))
    found: list[tuple[float, np.ndarray]] = []
    todo = [np.eye(n)] if n else []
    while todo and len(found) < count:
        basis = todo.pop()
        block = basis.T @ matrix @ basis
        halves = _divide((block + block.T) / 2.0, scale)
        if halves is None:
            found += [(float(v @ matrix @ v), v) for v in basis.T]
        else:
            # The last one is taken first.
            todo += [np.linalg.qr(basis @ half)[0] for half in reversed(halves)]
    found.sort(key=lambda pair: -pair[0])
    found = found[:count]
    values = np.array([value for value, _ in found])
    return values, np.stack([v for _, v in found], axis=1) if found else np.zeros((n, 0))


# --- statistics ---------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What whitening needs to know: number of different vectors, sums per dimension, eigenvalues and
    eigenvectors, the share of the variance that each explains, and the largest absolute
    entry of the whitened vectors' covariance minus the identity."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def grid_vector(vector: Column) -> Column:
    """Entries as whole grid steps; NULL if the vector or an entry is missing or not finite."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    steps = F.transform(entries, lambda c: F.floor(c * F.lit(float(GRID))).cast("long"))
    return F.when(~F.coalesce(bad, F.lit(True)), steps)


def _matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    """Vectors of whole numbers as rows, short ones filled up with zeros."""
    lists = list(column)
    out = np.zeros((len(lists), width), dtype=np.int64)
    lengths = np.array([len(x) for x in lists])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        if length:
            out[rows, :length] = np.stack([lists[i] for i in rows])
    return out


def fit_whitening(vectors: DataFrame, column: str, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the different vectors of a column of whole numbers; None without any vector."""
    distinct = vectors.select(F.col(column).alias("x")).where("x IS NOT NULL").distinct()
    distinct = materialize(distinct, "different-vectors")
    n, width = distinct.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return None
    if width > MAX_DIMENSION:
        raise ValueError(f"vectors of {width} dimensions; {MAX_DIMENSION} at most")

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of the upper and lower halves of the numbers, which cannot overflow."""
        high, low = np.zeros((2, width), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch["x"], width)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pd.DataFrame({"i": range(width), "high": high, "low": low})

    parts = distinct.mapInPandas(add_up, "i int, high bigint, low bigint").groupBy("i")
    halves = parts.agg(F.sum(F.col("high").cast("decimal(38,0)")), F.sum(F.col("low").cast("decimal(38,0)")))
    by_dimension = {i: (int(high) << 32) + int(low) for i, high, low in halves.collect()}
    sums = tuple(by_dimension.get(i, 0) for i in range(width))
    mean = np.array([s / n for s in sums])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                x = _matrix(batch["x"].iloc[at : at + _SLICE], width) - mean
                total += x.T @ x
        yield pd.DataFrame({"i": range(width), "row": list(total)})

    def add_rows(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.stack(list(parts["row"])), axis=0)]})

    rows = distinct.mapInPandas(products, "i int, row array<double>")
    rows = rows.groupBy("i").applyInPandas(add_rows, "i int, row array<double>").collect()
    covariance = np.zeros((width, width))
    for i, row in rows:
        covariance[i] = np.array(row) / n
    values, axes = leading_components(covariance, components)
    trace = float(np.trace(covariance))
    real = values > max(trace, 0.0) * width * 16 * _EPS
    explained = np.where(real, values, 0.0) / trace if trace > 0 else np.zeros(len(values))
    fitted = Whitening(n, sums, np.where(real, values, 0.0), axes, explained)

    k = int(real.sum())
    if not k:
        return fitted
    white = distinct.select(_whitened("x", fitted).alias("w"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    error = max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))
    return Whitening(n, sums, fitted.values, axes, explained, float(error))


def _whitened(column: str, fitted: Whitening) -> Column:
    """Array of a vector's whitened components; NULL where a component has no variance."""
    mean = np.array([s / fitted.n for s in fitted.sums])
    roots = np.sqrt(fitted.values)
    with np.errstate(divide="ignore"):
        weights = fitted.vectors * np.where(roots > 0, 1.0 / roots, np.nan)

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.empty((len(batch), weights.shape[1]))
            for at in range(0, len(batch), _SLICE):
                x = _matrix(batch.iloc[at : at + _SLICE], len(mean))
                out[at : at + _SLICE] = (x - mean) @ weights
            yield pd.Series(list(out))

    return F.transform(project(F.col(column)), lambda v: F.nanvl(v, F.lit(None).cast("double")))


def _deviation(column: str, fitted: Whitening) -> Column:
    """Sum over dimensions of (n * x - S)^2, exact; NULL if it does not fit a long."""
    n, sums = fitted.n, fitted.sums
    width = len(sums)
    largest_sum = max((abs(s) for s in sums), default=0)

    @F.pandas_udf("bigint")
    def exact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[int | None] = []
            for at in range(0, len(batch), _SLICE):
                x = _matrix(batch.iloc[at : at + _SLICE], width)
                most = max((abs(int(x.max())), abs(int(x.min()))) if x.size else (0,))
                if (n * most + largest_sum) ** 2 * max(width, 1) < 1 << 63:
                    out += ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    whole = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
                    out += [v if v < 1 << 63 else None for v in whole]
            yield pd.Series(out, dtype="Int64")

    return exact(F.col(column))


def whiten(
    rows: DataFrame, vector: str, keep: Sequence[str], components: int = COMPONENTS
) -> DataFrame:
    """One row per usable row: struct ``row`` with the columns ``keep``, ``n``, ``deviation``,
    arrays ``whitened`` and ``explained`` by component, and ``identity_error``."""
    usable = rows.select(F.struct(*keep).alias("row"), grid_vector(F.col(vector)).alias("x"))
    usable = usable.where("x IS NOT NULL")
    fitted = fit_whitening(usable, "x", components)
    if fitted is None:
        empty = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
        fields = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in empty.split(", ")]
        return usable.select("row", *fields).where(F.lit(False))
    return usable.select(
        "row",
        F.lit(fitted.n).cast("long").alias("n"),
        _deviation("x", fitted).alias("deviation"),
        _whitened("x", fitted).alias("whitened"),
        F.array(*[F.lit(float(e)) for e in fitted.explained]).cast("array<double>").alias("explained"),
        F.lit(fitted.identity_error).cast("double").alias("identity_error"),
    )
