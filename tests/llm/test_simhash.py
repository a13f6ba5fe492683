from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from cellprofiles.llm import simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Component of each fingerprint as the set of its positions, by comparing all pairs."""
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(prints))]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("nodes", [1024, 3])
def test_links_connect_what_the_radius_connects(spark, monkeypatch, nodes):
    monkeypatch.setattr(simhash, "SHARD_NODES", nodes)
    draw = random.Random(nodes)
    prints = set()
    for _ in range(25):
        own = draw.getrandbits(64)
        for _ in range(draw.randint(1, 12)):
            prints.add(own)
            for _ in range(draw.randint(1, 4)):
                own ^= 1 << draw.randrange(64)
    prints = sorted(prints)
    links = simhash.similar_links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
    found = {r.node: r.root for r in simhash.connected_components(links).collect()}
    got = [found.get(signed(p), signed(p)) for p in prints]
    want = groups(prints)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_documents_copies_and_nulls(documents):
    draw = random.Random(2)
    base = " ".join(f"Word{draw.randrange(999)}" for _ in range(300))
    near = base.replace("Word", "word") + " tail"
    rows = [(5, base), (3, base), (9, near), (1, None), (2, ""), (4, " \t"), (7, "One two"), (8, "one TWO"),
            (None, "alone here"), (6, "É é " * 3), (6, "É é " * 3)]
    out = simhash.near_duplicates(documents(*rows))
    got = {(r.doc_id, r.fp, r.component_id) for r in out.collect()}
    prints = [fingerprint(text) for _, text in rows]
    want = groups(prints)
    for (doc, _), fp, group in zip(rows, prints, want, strict=True):
        ids = [d for (d, _), g in zip(rows, want, strict=True) if g == group and d is not None]
        assert (doc, signed(fp), min(ids, default=None)) in got
    docs = documents(*rows).withColumn("fp", F.lit(1)).withColumn("_id", F.lit(2))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7]


def test_tree_finds_all_neighbours():
    draw = random.Random(7)
    values = [draw.getrandbits(12) for _ in range(200)]
    tree = simhash.BKTree(2)
    for value in values:
        tree.add(value)
    for value in values[:40]:
        near = {i for i, other in enumerate(values) if (value ^ other).bit_count() <= 2}
        got = set(tree.find(value))
        assert {values[i] for i in got} == {values[i] for i in near}


def test_empty_table(documents):
    assert simhash.near_duplicates(documents()).count() == 0
    assert simhash.drop_near_duplicates(documents()).count() == 0
