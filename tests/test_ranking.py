from __future__ import annotations

from pyspark.sql import functions as F

from cellprofiles.functions.ranking import bucketed_row_number, global_row_index


def test_bucketed_numbers_equal_plain_row_numbers(spark):
    rows = [("hot" if i % 3 else None, (i * 7919) % 1000, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(5)
    bucket = F.floor(F.col("o") / 50)
    out = bucketed_row_number(df, ["g"], bucket, [F.col("o"), F.col("i")], "n").collect()
    assert len(out) == 500
    for group in ("hot", None):
        ordered = sorted((r for r in out if r.g == group), key=lambda r: (r.o, r.i))
        assert [r.n for r in ordered] == list(range(1, len(ordered) + 1))


def test_global_index_follows_the_sort(spark):
    rows = [(f"k{(i * 37) % 301:03d}", i) for i in range(301)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(6)
    out = global_row_index(df, ["k"], "n")
    assert out.columns == ["k", "i", "n"]
    assert [r.k for r in sorted(out.collect(), key=lambda r: r.n)] == sorted(k for k, _ in rows)
    assert sorted(r.n for r in out.collect()) == list(range(301))
    assert global_row_index(df.limit(0), ["k"], "n").count() == 0
