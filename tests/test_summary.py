from __future__ import annotations

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellprofiles.functions import summary

NAMES = ["a", "b.c", "constant", "empty", "few"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 500
    a = 1e6 + rng.normal(size=n)
    columns = [a, 3 * a + rng.normal(size=n) * 0.1, np.full(n, 0.1), np.full(n, np.nan), rng.integers(0, 4, n) * 1.0]
    x = np.stack(columns, axis=1)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[0, 4], x[1, 4] = 0.0, -0.0
    return x


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in data]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in NAMES)).repartition(5)


def test_correlation_over_common_rows(frame, data):
    found = summary.summarize(frame, NAMES).correlation()
    assert found.n_rows == len(data)
    assert found.count.tolist() == (~np.isnan(data)).sum(axis=0).tolist()
    for i in (0, 1, 4):
        values = data[~np.isnan(data[:, i]), i]
        assert found.mean[i] == pytest.approx(values.mean(), rel=1e-12)
        assert found.deviation[i] == pytest.approx(values.std(), rel=1e-9)
        for j in (0, 1, 4):
            both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            r = np.corrcoef(data[both, i], data[both, j])[0, 1]
            assert found.matrix[i, j] == pytest.approx(r, abs=1e-9)
    assert found.deviation[[2, 3]].tolist() == [1.0, 1.0]
    assert found.matrix[2].tolist() == [0, 0, 1, 0, 0]


@pytest.mark.parametrize("held, range_rows", [(4_000_000, 2_000_000), (100, 64)])
def test_value_counts(frame, data, monkeypatch, held, range_rows):
    monkeypatch.setattr(summary, "HELD_VALUES", held)
    monkeypatch.setattr(summary, "RANGE_ROWS", range_rows)
    seen = summary.summarize(frame, NAMES, products=False, values=True)
    found = {r.feature: r for r in seen.frequencies().collect()}
    for i, name in enumerate(NAMES):
        counts = Counter(float(v) + 0.0 for v in data[:, i] if not np.isnan(v))
        top = [c for _, c in counts.most_common(2)] + [None, None]
        row = found[name]
        assert (row.n_rows, row.n_distinct, row.first, row.second) == (len(data), len(counts), *top[:2])
    # What is shuffled: a row per feature, task (or flush of it) and range.
    if held > len(data):
        assert seen.table.count() <= len(NAMES) * 5


def test_empty_table(frame):
    seen = summary.summarize(frame.limit(0), NAMES, values=True)
    assert [r.n_distinct for r in seen.frequencies().collect()] == [0] * len(NAMES)
    assert seen.correlation().n_rows == 0


def test_a_task_holds_little_whatever_it_scans():
    """Peak of a task over three million different values, and the values it hands on."""
    draw, seen = np.random.default_rng(5), [0, 0]

    def batches():
        for _ in range(60):
            values = pa.array(draw.random(50_000))
            yield pa.record_batch([pa.ListArray.from_arrays(np.arange(0, 50_001, 5, dtype=np.int32), values)], ["_v"])

    tracemalloc.start()
    for found in summary._scan(5, False, True, 7)(batches()):
        counts = [np.frombuffer(c, dtype=np.int64) for c in found.column("counts").to_pylist()]
        seen = [seen[0] + sum(map(len, counts)), seen[1] + sum(c.sum() for c in counts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [3_000_000, 3_000_000]
    assert peak < 100e6
