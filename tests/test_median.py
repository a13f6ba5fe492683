from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellprofiles.functions import median
from cellprofiles.functions.median import grouped_median
from cellprofiles.functions.missing import clean_features, one_row, tidy


@pytest.fixture(scope="module")
def data():
    """One group with most rows, ties, gaps, a NULL key and a group without any value."""
    rng = np.random.default_rng(3)
    rows = [("hot", "x", float(v), float(int(v * 3))) for v in rng.normal(0, 100, 3001)]
    rows += [("hot", "x", None, 1.0e300), ("hot", "x", -1.0e300, None)]
    rows += [("copies", "x", 7.0, 7.0)] * 500 + [("copies", "x", 8.0, 1.0)] * 500
    rows += [(None, "y", float(v), None) for v in range(6)]
    rows += [("small", None, 1.0, 4.0), ("small", None, 2.0, None)]
    return rows


@pytest.fixture(scope="module")
def expected(data):
    groups = {}
    for a, b, x, y in data:
        groups.setdefault((a, b), []).append((x, y))

    def median(values):
        kept = [v for v in values if v is not None]
        return float(np.median(kept)) if kept else None

    return {
        k: (len(v), median([x for x, _ in v]), median([y for _, y in v]))
        for k, v in groups.items()
    }


@pytest.fixture(params=["collected", "by interval"])
def inside(request, monkeypatch):
    """Both treatments of what lies inside a bracket."""
    if request.param == "by interval":
        monkeypatch.setattr(median, "_INSIDE", 1e9)


@pytest.mark.parametrize(
    "limits",
    [
        {},  # all groups collected
        {"hot_rows": 1500},  # one hot group split off
        {"hot_rows": 100},  # two of them
        {"hot_rows": 1},  # all groups hot
        {"hot_rows": 1, "max_hot": 1},  # too many hot groups to list
    ],
)
def test_median_is_exact_however_groups_are_treated(spark, data, expected, limits):
    df = spark.createDataFrame(data, "a string, b string, x double, y double").repartition(7)
    out = grouped_median(df, ["a", "b"], ["x", "y"], [F.count("*").alias("n")], **limits)
    assert out.columns == ["a", "b", "n", "x", "y"]
    found = {(r.a, r.b): (r.n, r.x, r.y) for r in out.collect()}
    assert found.keys() == expected.keys()
    for key, (n, x, y) in expected.items():
        assert found[key][0] == n
        assert found[key][1] == pytest.approx(x, rel=1e-12) if x is not None else found[key][1] is None
        assert found[key][2] == pytest.approx(y, rel=1e-12) if y is not None else found[key][2] is None


def test_both_ways_agree_to_the_last_digit(spark, inside):
    inf = float("inf")
    rng = np.random.default_rng(5)
    groups = {
        "infinite": [1.0, inf, inf, inf],
        "both ends": [-inf, -inf, inf, inf, 3.0],
        "halves": [-inf, inf, 1.0, 2.0],
        "zeros": [0.0, -0.0, -0.0, 0.0],
        "one": [0.1] * 7,
        "thirds": [1 / 3, 2 / 3, 0.1, 0.7],
        "large": [1.0e308, 1.5e308],
        "many": [float(v) for v in rng.normal(0, 1, 4000).round(2)],
        "wide": [float(v) for v in np.exp(rng.normal(0, 20, 3001))],
        "none": [None, None],
    }
    df = spark.createDataFrame([(k, v) for k, own in groups.items() for v in own], "k string, v double")
    cold = grouped_median(df, ["k"], ["v"]).collect()
    hot = grouped_median(df, ["k"], ["v"], hot_rows=1).collect()
    assert len(hot) == len(groups)
    assert sorted(map(str, cold)) == sorted(map(str, hot))


def test_hot_groups_of_every_kind(spark, data, expected, inside):
    df = spark.createDataFrame(data, "a string, b string, x double, y double").repartition(7)
    out = grouped_median(df, ["a", "b"], ["x", "y"], [F.count("*").alias("n")], hot_rows=100)
    found = {(r.a, r.b): (r.n, r.x, r.y) for r in out.collect()}
    assert found.keys() == expected.keys()
    for key, want in expected.items():
        assert found[key] == pytest.approx(want, rel=1e-12) if None not in want else found[key] == want


def test_median_in_a_gap_and_in_heavy_ties(spark, inside):
    """Two far groups of values with the median between them; and values that are mostly equal."""
    rng = np.random.default_rng(8)
    two = np.concatenate([rng.normal(-1e9, 1, 2500), rng.normal(1e9, 1, 2500)])
    odd = np.append(two, 5.0)
    ties = np.concatenate([np.full(3000, 1.5), rng.normal(1.5, 1e-9, 3001)])
    named = {"two": two, "odd": odd, "ties": ties}
    rows = [(k, float(v)) for k, own in named.items() for v in own]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for r in grouped_median(df, ["k"], ["v"], hot_rows=10).collect():
        assert r.v == float(np.median(named[r.k]))


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_global_median(spark, data, hot_rows, inside):
    df = spark.createDataFrame(data, "a string, b string, x double, y double")
    df = df.withColumn("nothing", F.lit(None).cast("double"))
    row = grouped_median(df, [], ["x", "y", "nothing"], hot_rows=hot_rows).collect()
    assert len(row) == 1
    for place in (0, 1):
        kept = [r[2 + place] for r in data if r[2 + place] is not None]
        assert row[0][place] == pytest.approx(float(np.median(kept)), rel=1e-12)
    assert row[0][2] is None
    extra = grouped_median(df, [], ["x"], [F.count("*").alias("n")], hot_rows=hot_rows).first()
    assert extra.n == len(data)


def test_global_median_of_nothing(spark):
    empty = spark.createDataFrame([], "x double")
    assert grouped_median(empty, [], ["x"]).collect() == [(None,)]
    gaps = spark.createDataFrame([(None,)] * 5, "x double")
    assert grouped_median(gaps, [], ["x"], hot_rows=2).collect() == [(None,)]


def test_nan_becomes_null_and_helpers_compose(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int")
    cleaned = clean_features(df, ["x"])
    assert cleaned.columns == ["x", "k"]
    assert cleaned.agg(F.avg("x"), F.count("x")).collect() == [(2.0, 1)]
    stats = one_row(cleaned.agg(F.max("x").alias("m")))
    assert df.select("k", stats["m"].alias("m")).collect() == [(1, 2.0), (2, 2.0)]
    rows = df.limit(1).select(tidy([("'a'", "1"), ("'b'", "2")], ["n", "v"]))
    assert rows.collect() == [("a", 1), ("b", 2)]
