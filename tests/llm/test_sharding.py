from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cellprofiles.llm import sharding


def least_largest(sizes, shards):
    """Smallest possible largest run over all contiguous cuts."""
    best = None
    for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        edges = [0, *cuts, len(sizes)]
        largest = max(sum(sizes[a:b]) for a, b in itertools.pairwise(edges))
        best = largest if best is None else min(best, largest)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_minimal(spark, seed):
    draw = random.Random(seed)
    keys = [draw.getrandbits(64) - 2**63 for _ in range(9)]
    groups = sorted((key, draw.randint(10, 14)) for key in keys)
    plan = sharding.plan_shards(spark.createDataFrame(groups, "key long, bytes long"), 3)
    assert plan.alone == []
    shard = [sum(key >= cut for cut in plan.cuts) for key, _ in groups]
    sizes = [sum(b for s, (_, b) in zip(shard, groups, strict=True) if s == n) for n in range(3)]
    assert max(sizes) == plan.capacity == least_largest([b for _, b in groups], 3)


def test_refined_atoms_give_the_same_capacity(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 1)
    monkeypatch.setattr(sharding, "REFINE_BITS", 3)
    draw = random.Random(1)
    groups = sorted((draw.getrandbits(40), draw.randint(1, 9)) for _ in range(12))
    groups = list(dict(groups).items())
    plan = sharding.plan_shards(spark.createDataFrame(groups, "key long, bytes long"), 3)
    if not plan.alone:
        assert plan.capacity == least_largest([b for _, b in groups], 3)


def test_copies_stay_together_and_a_hot_text_has_its_own_shard(documents):
    rows = [(i, f"text {i} " + "x" * (i % 7)) for i in range(300)] + [(300 + i, "y" * 40) for i in range(150)]
    out = sharding.shard_documents(documents(*rows), 4).toPandas()
    assert len(out) == len(rows) and set(out.shard) == {0, 1, 2, 3}
    hot = out[out.text == "y" * 40].shard
    assert hot.nunique() == 1 and (out.shard == hot.iloc[0]).sum() == 150
    rest = out[out.shard != hot.iloc[0]].groupby("shard").text.apply(lambda t: sum(map(len, t)))
    assert rest.max() < 1.1 * rest.min()


def test_slots_nulls_and_repeated_rows(documents):
    rows = [(1, None), (2, ""), (3, "ä"), (3, "ä"), (None, "b"), (None, "b")]
    docs = documents(*rows).withColumn("shard", F.lit("mine")).withColumn("key", F.lit(1))
    out = sharding.shard_slots(docs, 3).toPandas()
    assert sorted(out["size"]) == [1, 1, 2, 2, 3, 3]
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert out[out["size"] == 1].shard.nunique() == 1
    assert out[out["size"] == 1].text_crc32.tolist() == [0, 0]
    whole = sharding.shard_documents(docs, 3)
    assert whole.columns == docs.columns and dict(whole.dtypes)["shard"] == "int"


def test_empty_table(documents):
    assert sharding.shard_slots(documents(), 16).count() == 0
    assert sharding.shard_documents(documents(), 16).count() == 0
