from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellprofiles.llm import decontamination as dec


def brute(text, items, window):
    words = dec.words_of(text)
    hit, named = [False] * len(words), set()
    for item, own in items:
        size = min(window, len(own))
        for a in range(len(own) - size + 1 if size else 0):
            for b in range(len(words) - size + 1):
                if words[b : b + size] == own[a : a + size]:
                    hit[b : b + size] = [True] * size
                    named |= set() if item is None else {item}
    return len(words), sum(hit), sorted(named), hit


@pytest.mark.parametrize("seed", range(40))
def test_shard_equals_brute_force(seed):
    draw = random.Random(seed)
    alphabet = [b"a", b"b", b"c", b"\xc3\xa9", b"7"][: draw.randint(1, 5)]
    window = draw.randint(2, 6)
    items = [
        (i if draw.random() < 0.9 else None, [draw.choice(alphabet) for _ in range(draw.randint(0, 12))])
        for i in range(draw.randint(0, 5))
    ]
    items += items[:1]  # an item twice
    half = len(items) // 2
    blocks = [dec.WindowBlock.build(part, window) for part in (items[:half], items[half:])]
    texts = [
        b" ".join(draw.choice([*alphabet, b"zz"]) for _ in range(draw.randint(0, 40)))
        if draw.random() < 0.9
        else None
        for _ in range(draw.randint(0, 6))
    ]
    out = dec.scan_shard(texts, blocks)
    for text, got in zip(texts, out.itertuples(), strict=True):
        n_words, n_hit, named, hit = brute(text, items, window)
        spans = np.zeros(n_words, dtype=bool)
        for span in got.spans:
            spans[span["start"] : span["stop"]] = True
        assert (got.n_words, got.n_hit, list(got.items)) == (n_words, n_hit, named)
        assert spans.tolist() == hit


def test_index_finds_and_locates():
    draw = np.random.default_rng(1)
    text = np.append(draw.integers(0, 4, 500), 0)
    index = dec.FMIndex(text)
    phrases = draw.integers(1, 5, (30, 3))
    which, low, high = index.search(phrases)
    found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
    for i, phrase in enumerate(phrases):
        at = [p for p in range(len(text) - 2) if (text[p : p + 3] == phrase).all()]
        assert found.get(i, []) == at


def test_documents(spark, documents):
    passage = " ".join(f"w{i}" for i in range(20))
    benchmark = spark.createDataFrame(
        [(1, passage), (2, "Short ITEM"), (3, None), (4, ""), (None, "no id here")], "item_id long, text string"
    )
    rows = [
        (1, f"before {passage.upper()} after"),
        (2, "a short-item, here"),
        (3, " ".join(f"w{i}" for i in range(12))),
        (4, None),
        (5, ""),
        (6, "it has no id here"),
        (7, "filler " * 300 + passage[:60]),
        (7, "filler " * 300 + passage[:60]),
        (None, passage),
        (8, "filler " * 300 + "short item"),
    ]
    docs = documents(*rows).withColumn("_found", F.lit(1)).withColumn("items", F.lit(2))
    found = dec.overlap(docs, benchmark).collect()
    got = {r.row.doc_id: (r.found.n_words, r.found.n_hit, list(r.found["items"])) for r in found}
    passes = dec.overlap(docs, benchmark, block_words=7).collect()  # items in pieces, several blocks
    assert sorted(map(str, passes)) == sorted(map(str, found))
    assert got[1] == (22, 20, [1]) and got[2] == (4, 2, [2]) and got[3] == (12, 0, [])
    assert got[4] == got[5] == (0, 0, []) and got[6] == (5, 3, []) and got[None] == (20, 20, [1])
    assert got[7][1] == 17 and got[8] == (302, 2, [2])
    clean = dec.remove_contaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 8]


def test_batches_are_cut_by_bytes(monkeypatch):
    draw = random.Random(5)
    alphabet = [b"a", b"b", b"c", b"\xc3\xa9"]
    items = [(i, [draw.choice(alphabet) for _ in range(6)]) for i in range(4)]
    texts = [b" ".join(draw.choice(alphabet) for _ in range(draw.randint(0, 300))) for _ in range(20)] + [None, b""]
    block = dec.WindowBlock.build(items, 4)
    whole = dec.scan_shard(texts, [block])
    monkeypatch.setattr(dec, "SHARD_BYTES", 700)
    monkeypatch.setattr(dec, "CHUNK", 11)
    cut = dec.scan_batch(texts, block, [((), (), ())] * len(texts))
    assert str(cut.to_dict()) == str(whole.to_dict())


def test_long_texts_in_bounded_batches():
    passage = " ".join(f"w{i}" for i in range(20)).encode()
    block = dec.WindowBlock.build([(1, dec.words_of(passage))], dec.WINDOW)
    long = b"filler word " * 80_000 + passage
    out = dec.scan_batch([long, long], block, [((), (), ())] * 2)
    assert out.n_hit.tolist() == [20, 20] and out.n_words.tolist() == [160_020] * 2


def test_empty_tables(spark, documents):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert dec.remove_contaminated(documents(), nothing).count() == 0
    assert dec.remove_contaminated(documents((1, "a b"), (2, None)), nothing).count() == 2
