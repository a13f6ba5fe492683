from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cellprofiles.llm import mixing


def brute(rows):
    """Targets by sharing out again and again, then each source in order of its keys."""
    sizes: dict = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, list(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        open_ = [s for s in open_ if s not in full]
    taken: dict = {}
    for s in names:
        own = sorted((key_of(doc, text), len((text or "").split())) for doc, text, _, source in rows if source == s)
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        budget, at = target[s] - epochs * sizes[s], 0
        for key, size in own:
            at += size
            more = budget > 0 and at - size / 2 <= budget
            taken.setdefault((s, key), []).append(epochs + more)
    return target, taken


def key_of(doc, text):
    parts = f"mix:{'null' if doc is None else int(doc)}", text or ""
    return "".join(hashlib.md5(part.encode()).hexdigest() for part in parts)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(documents, seed):
    draw = random.Random(seed)
    sources = ["a", "b", "c", "d", None]
    rows = [
        (i // 2 if i % 9 == 0 else i, " ".join("w" * draw.randint(0, 30)), "en", draw.choice(sources[: 2 + seed]))
        for i in range(120)
    ] + [(None, "one two", None, None), (7, None, None, "a"), (8, "x y", None, "tiny")]
    target, taken = brute(rows)
    out = mixing.mix_counts(documents(*rows)).toPandas()
    assert len(out) == len(rows)
    out = out.astype(object).where(out.notna(), None)
    assert sorted(out.times) == sorted(t for times in taken.values() for t in times)
    found: dict = {}
    for row in out.itertuples():
        assert row.taken == row.times * row.size
        assert abs(row.target - target[row.source]) < 1e-6
        found.setdefault((row.source, row.doc_id), []).append((row.size, row.times))
    want: dict = {}
    for place, (doc, text, _, source) in enumerate(rows):
        same = [i for i, r in enumerate(rows) if (r[0], r[1] or "", r[3]) == (doc, text or "", source)]
        times = taken[source, key_of(doc, text)][same.index(place)]
        want.setdefault((source, doc), []).append((len((text or "").split()), times))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    mixed = mixing.mix_documents(documents(*rows).withColumn("cut", F.lit(1)).withColumn("key", F.lit("k")))
    assert mixed.columns[-2:] == ["cut", "key"]
    assert mixed.count() == out.times.sum()


def test_small_sources_repeat_three_times_at_most(documents):
    rows = [(1, "a b", "en", "a")] + [(i, "c d e", "en", "b") for i in range(2, 40)]
    out = mixing.mix_counts(documents(*rows)).toPandas().set_index("doc_id")
    assert out.times[1] == 3 and out.times.max() == 3
    assert out[out.source == "b"].taken.sum() == pytest.approx(out.target[2], abs=3)


def test_empty_table_and_texts(documents):
    assert mixing.mix_counts(documents()).count() == 0
    assert mixing.mix_documents(documents()).count() == 0
    out = mixing.mix_counts(documents((1, None, None, "a"), (2, "", None, None))).toPandas()
    assert out.taken.tolist() == [0, 0] and out.target.tolist() == [0.0, 0.0]


@pytest.mark.parametrize(("doc_id", "source"), [(7, "a"), (None, None)])
@pytest.mark.parametrize("text", ["one two three", None], ids=["equal", "different"])
def test_rows_of_one_id_are_cut_at_the_target(documents, doc_id, text, source):
    """A source that is one id: with equal texts, and with texts of its own, cut within a document."""
    rows = [(doc_id, text or f"w{i} two three", "en", source) for i in range(1000)]
    rows += [(10 + i, "four more words here", "en", "b") for i in range(300)]
    rows += [(500 + i, "and five more words here", "en", "c") for i in range(400)]
    docs = documents(*rows)
    out = mixing.mix_counts(docs).toPandas()
    for _, own in out.groupby("source", dropna=False):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
    times = out[out["size"] == 3].times
    assert times.max() - times.min() == 1
    mixed = mixing.mix_documents(docs).toPandas()
    assert mixed.columns.tolist() == docs.columns
    assert len(mixed) == out.times.sum() and (mixed.text.str.count(" ") == 2).sum() == times.sum()
