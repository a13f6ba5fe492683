from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellprofiles.llm import attribution, token_output
from cellprofiles.llm.tokens import EncoderSource
from cellprofiles.llm.wavelet import WaveletMatrix

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["don't <|endoftext|> we'll\n\nx  y \n z", None, "", " ", "one  two\tthree\nfour.\nFive, 6½ 日本\x1c\x00 🙂 fin",
         "Zwei Wörter. Und ÉTÉ,\nencore! " * 30]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_parts_encode_like_the_whole(library):
    draw = random.Random(3)
    letters = "aaaBBé éø'sé    1²½\n\n \t\xa0_-,日\x1c<|endoftext|>🙂ا\0"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 25))) for _ in range(3000)] + TEXTS
    encoder = EncoderSource(PATH, offsets=True).encoder()
    of_text = []
    for spans, bases in encoder.encode_spans(texts):
        cuts = np.searchsorted(spans[:, 0], bases)
        of_text += [s - b for s, b in zip(np.split(spans, cuts[1:]), bases, strict=True)]
    for text, ids, spans in zip(texts, encoder.encode(texts), of_text, strict=True):
        whole = library.encode(text or "", add_special_tokens=False)
        assert np.frombuffer(ids, dtype="<u4").tolist() == whole.ids
        assert list(map(tuple, spans.tolist())) == whole.offsets


@pytest.mark.parametrize(("length", "most"), [(0, 5), (1, 1), (63, 9), (64, 3), (1000, 70000), (900, 7)])
def test_wavelet_matrix(length, most):
    draw = np.random.default_rng(length)
    symbols = draw.integers(0, most, length).astype(np.uint32)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.build(symbols).to_bytes())
    assert (matrix.decode() == symbols).all()
    assert (matrix.access(np.arange(length)) == symbols).all()
    for symbol in {0, 1, most, *symbols[:20].tolist()}:
        assert matrix.occurrences(symbol).tolist() == np.flatnonzero(symbols == symbol).tolist()
        assert matrix.count(symbol) == (symbols == symbol).sum()
    for at in draw.integers(0, length + 1, 20):
        symbol = int(symbols[at - 1]) if length else 0
        assert matrix.rank(np.array([symbol]), np.array([at]))[0] == (symbols[:at] == symbol).sum()


def test_files_round_trip(spark, documents, library, tmp_path):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40, 0, -1)] + [(7, "again"), (7, "again"), (None, "no id")]
    docs = documents(*rows).withColumn("part", F.lit(1)).withColumn("start", F.lit(2))
    path = str(tmp_path / "tokens")
    token_output.write_tokens(docs, path, PATH, shard_tokens=300)
    assert spark.read.parquet(path).count() > 3
    ids = {t: library.encode(t or "", add_special_tokens=False).ids + [2] for t in {t for _, t in rows}}
    out = token_output.read_documents(spark, path).toPandas()
    assert len(out) == len(rows)
    out = out.sort_values("start", ignore_index=True)
    assert out.doc_id.fillna(-1).tolist() == sorted(-1 if i is None else i for i, _ in rows)
    assert (out.start == out.n_tokens.cumsum() - out.n_tokens).all()
    checksum = {zlib.crc32(np.array(i, dtype="<u4").tobytes()): len(i) for i in ids.values()}
    assert all(checksum[c] == n for c, n in zip(out.ids_crc32, out.n_tokens, strict=True))
    of = {}
    for doc, text in rows:
        of.setdefault(-1 if doc is None else doc, []).append(ids[text])
    order = sorted(of)
    corpus = [token for doc in order if doc != 7 for token in of[doc][0]]
    everything = sum((sum(of[d], []) for d in order), [])
    assert token_output.token_count(spark, path, 2).head().n == everything.count(2) > corpus.count(2)
    at = sorted(r.position for r in token_output.token_positions(spark, path, 2).collect())
    assert at == [s + n - 1 for s, n in zip(out.start, out.n_tokens, strict=True)]
    some = token_output.tokens_at(spark, path, [0, 5, 10**9]).collect()
    assert {r.position: r.token for r in some} == {0: everything[0], 5: everything[5]}


def test_no_documents(spark, documents, tmp_path):
    path = str(tmp_path / "tokens")
    token_output.write_tokens(documents(), path, PATH)
    assert token_output.read_documents(spark, path).count() == 0
    assert token_output.token_count(spark, path, 2).head().n == 0
    assert attribution.attribute_tokens(documents(), PATH).count() == 0


def test_lines_share_out_the_tokens(documents, library):
    docs = documents(*enumerate(TEXTS), (1, None), (None, "a\nb")).withColumn("section", F.lit("x"))
    out = attribution.attribute_tokens(docs, PATH).toPandas()
    for doc, text in enumerate(TEXTS):
        own = out[out.doc_id == doc].drop_duplicates().sort_values("section")
        text = text or ""
        assert own.start.tolist() == [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
        assert own.stop.tolist()[:-1] == own.start.tolist()[1:] and own.stop.iloc[-1] == len(text)
        spans = library.encode(text, add_special_tokens=False).offsets
        assert own.n_tokens.sum() == len(spans)
        for row in own.itertuples():
            mine = 0
            for a, b in spans:
                held = [max(0, min(b, y) - max(a, x)) for x, y in zip(own.start, own.stop, strict=True)]
                at = next((i for i, (x, y) in enumerate(zip(own.start, own.stop, strict=True)) if x <= a < y), 0)
                mine += (held.index(max(held)) if max(held) else at) == row.section
            assert mine == row.n_tokens
    assert (out.doc_id == 1).sum() == 2


def test_given_sections(documents):
    docs = documents((1, "alpha beta gamma"), (2, None))
    starts = F.array(F.lit(0), F.lit(7), F.lit(9)).cast("array<long>")
    out = docs.select("doc_id", attribution.section_tokens(F.col("text"), docs, PATH, starts).alias("s"))
    got = {r.doc_id: list(zip(r.s.start, r.s.stop, r.s.n_tokens, strict=True)) for r in out.collect()}
    assert [g[:2] for g in got[1]] == [(0, 7), (7, 9), (9, 16)]
    assert sum(g[2] for g in got[1]) == len(Tokenizer.from_file(PATH).encode("alpha beta gamma").ids)


def test_added_tokens_like_the_library_call(spark, documents, tmp_path):
    from cellprofiles.llm.queries import op9_token_counts, op10_token_output

    plain = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", " <|endoftext|>é  z", "none <|endof text|>"]
    encoder = EncoderSource(PATH, offsets=True, special=True).encoder()
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        spans, _ = next(encoder.encode_spans([text]))
        assert list(map(tuple, spans.tolist())) == plain.encode(text, add_special_tokens=False).offsets
    documents(*enumerate(texts)).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in op10_token_output(spark, str(tmp_path)).collect()}
    lines = op9_token_counts(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    for doc, text in enumerate(texts):
        ids = plain.encode(text, add_special_tokens=False).ids
        assert out[doc].ids_crc32 == zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes())
        assert {r.doc_id: r.n for r in lines}[doc] == len(ids)


def test_cache_holds_ids_alone(monkeypatch):
    """Characters of tokens come from the bytes of their ids, for groups of any size; only added
    tokens have theirs in the cache."""
    texts = [*TEXTS, "ein <|endoftext|>zwei"] * 3
    found = []
    for together in (1, 1 << 21):
        monkeypatch.setattr("cellprofiles.llm.tokens.TOGETHER_SPANS", together, raising=False)
        encoder = EncoderSource(PATH, offsets=True, special=True).encoder()
        found.append(attribution.count_sections(encoder, texts, [attribution.line_starts(t) for t in texts]))
        assert set(encoder.spans) == {"<|endoftext|>"} and len(encoder.ids) > 10
    assert found[0].map(list).equals(found[1].map(list))
