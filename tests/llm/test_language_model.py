from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cellprofiles.llm import language_model, queries

COLUMNS = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def scored(docs, **options):
    learn = language_model.trained_on(F.col("doc_id"))
    found = language_model.score_documents(docs, learn, ["doc_id"], **options)
    return found.select("row.doc_id", *COLUMNS[1:]).collect()


def tokens_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w.encode() for w in lower.encode().decode().split()] + [None]


def signed(text):
    value = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return value - (1 << 64) if value >> 63 else value


def brute(rows, order):
    """Counts in dictionaries, expectation-maximisation token by token."""
    docs = []
    for doc, text in rows:
        learn = doc is None or zlib.crc32(str(doc).encode()) % 10 != 0
        role = 0 if not learn else 2 if signed(text) % 10 == 0 else 1
        docs.append((doc, ["<s>"] * (order - 1) + tokens_of(text), role))

    def counts(roles):
        grams, contexts, n = Counter(), Counter(), 0
        for _, seq, role in docs:
            if role in roles:
                for t in range(order - 1, len(seq)):
                    n += 1
                    for k in range(1, order + 1):
                        grams[tuple(seq[t - k + 1 : t + 1])] += 1
                        contexts[tuple(seq[t - k + 1 : t])] += 1
        return grams, contexts, n

    everything, rest = counts({1, 2}), counts({1})
    types = sum(1 for g in everything[0] if len(g) == 1)

    def chain(seq, t, weights, table):
        grams, contexts, n = table
        p, parts = 1 / (types + 1), []
        for k in range(1, order + 1):
            c = grams[tuple(seq[t - k + 1 : t + 1])]
            h = contexts[tuple(seq[t - k + 1 : t])] if k > 1 else n
            bucket = h.bit_length()
            w = weights.get((k, bucket), 0.5) if h else 0.0
            seen, left = (w * c / h if h else 0.0), (1 - w) * p
            p = seen + left
            parts.append(((k, bucket), seen, left))
        return p, parts

    weights = {}
    for _ in range(language_model.STEPS):
        reached, ended = Counter(), Counter()
        for _, seq, role in docs:
            if role == 2:
                for t in range(order - 1, len(seq)):
                    _, parts = chain(seq, t, weights, rest)
                    share = 1.0
                    for key, seen, left in reversed(parts):
                        reached[key] += share
                        here = share * seen / (seen + left)
                        ended[key] += here
                        share -= here
        better = {k: (ended[k] + 0.5) / (reached[k] + 1) for k in reached if k[1]}
        change = max((abs(better[k] - weights.get(k, 0.5)) for k in better), default=0)
        weights = better
        if change < language_model.TOLERANCE:
            break
    grams, _, n = everything
    out = []
    for doc, seq, _ in docs:
        own = seq[order - 1 :]
        base = sum(math.log10((grams[(w,)] + 0.1) / (n + 0.1 * (types + 1))) for w in own)
        score = sum(
            math.log10(chain(seq, t, weights, everything)[0]) for t in range(order - 1, len(seq))
        )
        out.append((doc, len(own), sum(grams[(w,)] > 0 for w in own), n, base, score))
    return out


def same(found, expected):
    def key(r):
        return (r[0] is None, r[0] or 0, r[1], round(r[5], 6))

    assert len(found) == len(expected)
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key)):
        assert tuple(a[:4]) == tuple(b[:4])
        assert tuple(a[4:]) == pytest.approx(tuple(b[4:]), rel=1e-9, abs=1e-9)


def made(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Über", "ÜBER", "The", "THE"]
    rows = [
        (i, " ".join(draw.choice(words[: draw.choice((3, 10, 34))]) for _ in range(draw.randint(0, 40))))
        for i in range(n)
    ]
    return rows + [(n, None), (n + 1, ""), (None, "the w1 \t\n w2"), (5, rows[5][1]), (5, "other text")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(documents, order):
    rows = made(order, 120)
    same(scored(documents(*rows), order=order), brute(rows, order))


def test_blocks_and_ranges_change_nothing(documents, monkeypatch):
    rows = made(9, 100)
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 300)
    monkeypatch.setattr(language_model, "RANGE_TOKENS", 64)
    same(scored(documents(*rows).repartition(3)), brute(rows, 2))


def test_long_text_and_copies(documents):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    rows = [(1, long), *[(i, "the same words") for i in range(2, 200)]]
    found = {r.doc_id: r for r in scored(documents(*rows))}
    assert found[1].n_tokens == 300_001
    assert len({round(found[i].score, 9) for i in range(2, 200)}) == 1
    assert all(r.score > r.base_score for r in found.values())


def test_no_training_text_and_empty_table(documents):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = scored(documents((held, "a b")))
    assert tuple(row) == (held, 3, 0, 0, 0.0, 0.0)
    assert scored(documents((1, "x")).limit(0)) == []


def test_probabilities_add_up_to_one():
    weights = np.full((2, language_model.BUCKETS), 0.3)
    weights[:, 0] = 0.0
    # Five types with their unigram counts, after a context seen 4 times, and an unknown type.
    counts = np.array([[5, 3, 1, 1, 0, 0], [2, 1, 1, 0, 0, 0], [4] * 6])
    probability, _ = language_model._mixed(counts, weights, 10, 5)
    assert probability.sum() == pytest.approx(1.0)


def test_other_columns_do_not_clash(documents):
    docs = documents((1, "a b"), (2, "b c")).withColumns({"score": F.lit("x"), "block": F.lit(3)})
    found = language_model.score_documents(docs, F.lit(True), ["doc_id", "score", "block"])
    assert {(r.row.doc_id, r.row.score, r.row.block) for r in found.collect()} == {(1, "x", 3), (2, "x", 3)}


def test_held_out_texts_of_the_table_gain(spark):
    rows = queries.op11_language_model(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    assert any(r.held_out for r in rows)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
