from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cellprofiles.llm import merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def lowered(text):
    return text and text.translate({c: c + 32 for c in range(65, 91)})


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def brute(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) per row."""
    langs = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for lang in langs:
        own = [(r[0], leaf_of(r, r[1]), r) for r in rows if r[2] == lang]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((own, levels_of([x[1] for x in own])))
    top = levels_of([levels[-1][0] for _, levels in trees])
    out = []
    for t, (own, levels) in enumerate(trees):
        for i, (doc, leaf, row) in enumerate(own):
            tampered = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
            digest = leaf_of(row, lowered(row[1])) if tampered else leaf
            proof = ""
            for way, at in ((levels, i), (top, t)):
                for level in way[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    left, right = run[: at % 8], run[at % 8 + 1 :]
                    proof += "".join(left + right)
                    digest = sha(*left, digest, *right)
                    at //= 8
            out.append((doc, leaf, levels[-1][0], top[-1][0], sha(proof), digest, digest == top[-1][0]))
    return out


def proved(docs, **options):
    fields = [F.col(c) for c in FIELDS]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    other = merkle.digest_of([*fields[:-1], F.translate("text", upper, upper.lower())])
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, other)
    manifest = merkle.build_manifest(docs, F.col("lang"), F.col("doc_id"), fields, ["doc_id"], shown)
    return manifest, merkle.prove(manifest, **options)


def rows_of(found):
    return sorted(
        ((r.row.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect()),
        key=str,
    )


def made(sizes, seed=0):
    draw = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = draw.choice(["Some Text", "no capitals", "Ünï Ö", "", None, "x" * draw.randint(0, 50)])
            doc = draw.choice([len(rows), len(rows), draw.randint(0, 20)])
            rows.append((doc, text, lang, draw.choice(["web", "a:b", None])))
    full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    return full


@pytest.mark.parametrize(
    "sizes",
    [
        {"en": 1},
        {"en": 8},
        {"en": 9, None: 1},
        {"en": 700, "de": 64, "é": 65, "zz": 1, None: 3},
        {f"l{i}": 1 + i % 3 for i in range(70)},
    ],
)
def test_equals_brute_force(documents, sizes):
    rows = made(sizes)
    # Equal ids and texts from the same source are interchangeable: compare as multisets.
    _, found = proved(documents(*[r[:4] for r in rows]))
    assert rows_of(found) == sorted(brute(rows), key=str)


def test_partitions_of_any_size(documents, monkeypatch):
    """Small rounds, so that partitions lack nodes on many levels."""
    rows = made({"en": 900, "fr": 77}, 3)
    monkeypatch.setattr(merkle, "ROUND_LEVELS", 1)
    monkeypatch.setattr(merkle, "_ROUND_BITS", 3)
    _, found = proved(documents(*[r[:4] for r in rows]))
    assert rows_of(found) == sorted(brute(rows), key=str)


def test_proofs_of_some_leaves_only(documents):
    rows = [(i, f"T{i}", "en", "web", len(f"T{i}")) for i in range(600)]
    manifest, _ = proved(documents(*[r[:4] for r in rows]))
    some = manifest.leaves.where("row.doc_id % 37 = 5")
    found = merkle.prove(manifest, some, siblings=True)
    expected = {r[0]: r for r in brute(rows)}
    got = found.collect()
    assert len(got) == len([i for i in range(600) if i % 37 == 5])
    for r in got:
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) == expected[r.row.doc_id][1:6]
        assert sha(*r.siblings) == r.proof_sha256


def test_missing_coordinates_are_least():
    """Every asked node is needed, and together they are enough."""
    draw = random.Random(4)
    for size in (1, 2, 8, 9, 64, 65, 200, 513):
        for _ in range(20):
            own = draw.sample(range(size), draw.randint(1, min(size, 9)))
            known, need = set(own), set()
            for level in range(merkle.height(size)):
                width = -(-size // 8**level)
                for run in {i // 8 for i in known}:
                    need |= {(level, i) for i in range(run * 8, min(run * 8 + 8, width)) if i not in known}
                known = {i // 8 for i in known}
            assert sorted(merkle.missing_coordinates(own, size)) == sorted(need)


def test_many_equal_rows(documents):
    rows = [(7, "Same", "en", "web", 4)] * 500 + [(8, "other", "en", "web", 5)]
    _, found = proved(documents(*[r[:4] for r in rows]))
    assert rows_of(found) == sorted(brute(rows), key=str)


def test_empty_table_long_text_and_clashing_names(documents):
    _, found = proved(documents((1, "x")).limit(0))
    assert found.collect() == []
    rows = [(1, "Ab " * 700_000, "en", None, 2_100_000), (2, None, None, None, None)]
    docs = documents(*[r[:4] for r in rows]).withColumns({"leaf": F.lit(1), "tree": F.lit("t")})
    _, found = proved(docs)
    assert rows_of(found) == sorted(brute(rows), key=str)


def test_tampered_rows_of_the_table_fail(spark):
    rows = queries.op12_merkle(spark, "/root/testdata/sf0.001").collect()
    assert len({r.root for r in rows}) == 1
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3:
            assert r.verified
    assert not all(r.verified for r in rows)
