from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellprofiles.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=4):
    """Integers in Python, eigenvectors by NumPy's symmetric solver."""
    kept = {}
    vectors = []
    for name, vector in rows:
        if vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        x = tuple(math.floor(256 * float(np.float32(v))) for v in vector)
        vectors.append((name, x))
        kept[x] = None
    if not vectors:
        return []
    x = np.array(list(kept), dtype=float)
    n, sums = len(kept), [sum(column) for column in zip(*kept)]
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = []
    for name, row in vectors:
        deviation = sum((n * v - s) ** 2 for v, s in zip(row, sums))
        white = (np.array(row) - x.mean(axis=0)) @ axes / np.sqrt(np.abs(values))
        out.append((name, n, deviation, white, values / centred.var(axis=0).sum()))
    return out


def found_of(df, **options):
    return whitening.whiten(df, "embedding", ["vec_id"], **options).collect()


def same(found, expected):
    assert len(found) == len(expected)
    a = np.array([r.whitened for r in sorted(found, key=lambda r: r.row.vec_id)])
    expected = sorted(expected, key=lambda r: r[0])
    b = np.array([r[3] for r in expected])
    signs = np.sign((a * b).sum(axis=0))
    np.testing.assert_allclose(a * signs, b, rtol=1e-8, atol=1e-8)
    for r, e in zip(sorted(found, key=lambda r: r.row.vec_id), expected):
        assert (r.row.vec_id, r.n, r.deviation) == e[:3]
        assert r.explained == pytest.approx(list(e[4]), rel=1e-9)
        assert r.identity_error < 1e-9


@pytest.mark.parametrize("n, d", [(60, 5), (300, 32), (40, 64)])
def test_equals_brute_force(spark, n, d):
    draw = np.random.default_rng(n)
    data = draw.normal(size=(n, d)) * draw.uniform(0.2, 2, size=d)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(data)]
    rows += [(n + i, rows[0][1]) for i in range(25)]  # copies count once
    rows += [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("-inf")] * d)]
    same(found_of(spark.createDataFrame(rows, SCHEMA).repartition(3)), brute(rows))


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2.0**40 * (i % 7) + i), float(-(i * i)), 0.5]) for i in range(50)]
    found = {r.row.vec_id: r for r in found_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))}
    xs = {i: tuple(math.floor(256 * v) for v in x) for i, x in rows}
    sums = [sum(c) for c in zip(*xs.values())]
    for i, x in xs.items():
        exact = sum((50 * v - s) ** 2 for v, s in zip(x, sums))
        assert found[i].deviation == (exact if exact < 1 << 63 else None)


def test_without_variance(spark):
    same_vector = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], SCHEMA)
    for r in found_of(same_vector):
        assert (r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, [None, None], [0.0, 0.0], None)
    line = spark.createDataFrame([(i, [float(i), float(i), 0.0]) for i in range(9)], SCHEMA)
    for r in found_of(line):
        assert r.whitened[0] is not None and r.whitened[1:] == [None, None]
        assert r.explained == pytest.approx([1.0, 0.0, 0.0])


def test_short_and_empty_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, [0.0, 3.0]), (None, [2.0, 2.0])]
    found = {r.row.vec_id: r for r in found_of(spark.createDataFrame(rows, SCHEMA))}
    full = [(name if name is not None else 9, (v + [0.0, 0.0])[:2]) for name, v in rows]
    expected = {e[0]: e for e in brute(full)}
    assert {k if k is not None else 9: r.deviation for k, r in found.items()} == {k: e[2] for k, e in expected.items()}


def test_empty_tables_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found_of(empty) == []
    assert found_of(spark.createDataFrame([(1, None)], SCHEMA)) == []
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA).withColumn("x", F.lit("y"))
    found = whitening.whiten(rows, "embedding", ["vec_id", "x"]).collect()
    assert {r.row.x for r in found} == {"y"}


@pytest.mark.parametrize("n", [1, 2, 7, 50, 130])
def test_components_of_a_matrix(n):
    draw = np.random.default_rng(n)
    half = draw.normal(size=(n, n + 2))
    matrix = half @ half.T
    values, axes = whitening.leading_components(matrix, n)
    expected, _ = np.linalg.eigh(matrix)
    np.testing.assert_allclose(values, expected[::-1], rtol=1e-12, atol=1e-12 * expected[-1])
    np.testing.assert_allclose(axes.T @ axes, np.eye(n), atol=1e-12)
    np.testing.assert_allclose(matrix @ axes, axes * values, atol=1e-11 * expected[-1])


def test_equal_and_clustered_eigenvalues():
    basis, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(12, 12)))
    for spectrum in ([3] * 12, [5] * 4 + [1] * 8, [1 + 1e-13 * i for i in range(12)], [0] * 11 + [7], [2, *[0.0] * 11]):
        matrix = basis @ np.diag(np.array(spectrum, dtype=float)) @ basis.T
        values, axes = whitening.leading_components(matrix, 12)
        np.testing.assert_allclose(values, sorted(spectrum, reverse=True), atol=1e-12 * max(spectrum))
        np.testing.assert_allclose(axes.T @ axes, np.eye(12), atol=1e-12)


def test_polar_factor():
    matrix = np.random.default_rng(1).normal(size=(30, 30))
    matrix = matrix + matrix.T
    left, _, right = np.linalg.svd(matrix)
    np.testing.assert_allclose(whitening.polar_factor(matrix), left @ right, atol=1e-12)


def test_whole_table(spark):
    rows = queries.op13_whitening(spark, "/root/testdata/sf0.001").collect()
    assert {r.component for r in rows} == {1, 2, 3, 4}
    assert all(r.identity_error < 1e-4 for r in rows)
