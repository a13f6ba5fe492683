from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from cellprofiles.llm import language
from cellprofiles.llm.queries import op6_language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = op6_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    out = out.select("doc_id", "held_out", "lang", "lang_pred", "score").toPandas()
    assert len(out) == 1000
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    held = out[out.held_out & out.lang.notna()]
    assert (held.lang == held.lang_pred).mean() >= 0.97
    assert out.score.between(0, 1).all()


def test_undetermined_and_rejected(spark, documents):
    english = [(i, f"the cat and the dog went to the house number{i} of the king", "en") for i in range(40)]
    german = [(100 + i, f"der hund und die katze gehen in das haus{i} von dem mann", "de") for i in range(40)]
    odd = [(201, None, "en"), (202, "", None), (203, "12 %% 7", "en"), (None, "the king and the dog", None),
           (204, "привет как дела сегодня", None), (205, "the dog and the king " * 4000, None)]
    docs = documents(*english, *german, *odd).withColumn("_found", F.lit(1)).withColumn("score", F.lit(2))
    model = language.fit_documents(docs.filter(language.learnable(F.col("doc_id"))))
    found = docs.select("doc_id", language.predict(F.col("text"), model, docs).alias("f"))
    found = {r.doc_id: r.f for r in found.collect()}
    for doc in (201, 202, 203):
        assert (found[doc].lang_pred, found[doc].score) == ("und", 0.0)
    assert found[205].lang_pred == "en" and found[None].lang_pred == "en"
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {201, 202, 203} & ids == set() and {None, 205, 0, 100} <= ids


def test_long_texts_are_read_in_chunks(monkeypatch):
    letters = language.letters_of("alpha beta gamma délta " * 50)
    model = language.fit(["alpha beta", "gamma délta"] * 20, ["x", "y"] * 20)
    whole = model.text_logits(letters)
    monkeypatch.setattr(language, "CHUNK", 37)
    assert abs(whole - model.text_logits(letters)).max() < 1e-9


def test_empty_and_unlabelled_tables(documents):
    assert language.keep_identified(documents()).count() == 0
    out = language.keep_identified(documents((1, "words", None), (2, "77", None), (3, None, None)))
    assert [r.doc_id for r in out.collect()] == [1]


def test_copies_and_long_texts_are_learnt(spark, documents, monkeypatch):
    rows = [(i, f"the cat number{i % 3} and the dog", "en") for i in range(3000)]
    rows += [(5000 + i, f"der hund und die katze gehen {'ab'[i % 2]}{chr(97 + i % 26)}{i} haus", "de") for i in range(300)]
    long = "el perro y la casa del rey con una mesa " * 25_000
    rows += [(9000 + i, f"{long} {i}", "es") for i in range(5)]
    docs = documents(*rows, (1, None, "en"), (2, "", "de"), (None, "no label", None))
    sample = language.training_sample(docs, per_language=60)
    counts = sample.groupby("lang").size().to_dict()
    assert counts["en"] == 3 and counts["es"] == 5 and 30 <= counts["de"] <= 90
    assert sample[sample.lang == "es"].text.str.len().max() <= language.PIECES * (language.PIECE + 1)
    assert len(language.training_sample(docs, texts=3)) < 15
    model = language.fit(sample.text.tolist(), sample.lang.tolist())
    assert model.predict([long]).lang_pred.tolist() == ["es"]
    assert model.predict(["the dog and the cat"] * 2).lang_pred.tolist() == ["en"] * 2


def test_many_languages_make_no_larger_model(documents):
    names = [f"l{k:03d}" for k in range(500)]
    rows = [(k * 10 + i, f"{chr(97 + k % 26)}{chr(97 + k // 26)}xo qua{chr(97 + i)}", name) for k, name in enumerate(names) for i in range(8)]
    sample = language.training_sample(documents(*rows), texts=1500)
    assert 1000 <= len(sample) <= 2000
    model = language.fit([r[1] for r in rows], [r[2] for r in rows])
    assert len(model.languages) == 500 and model.logits.size <= language.TABLE_ENTRIES
    assert model.shares is None or model.shares.size <= language.TABLE_ENTRIES


FOREIGN = {
    301: "kissa istuu ikkunalla ja katselee lintuja kun lumi sataa hiljaa metsan ylle ja jarvi jaatyy yon aikana ",
    302: "kucing itu duduk di dekat jendela sambil melihat burung yang terbang di atas rumah kami setiap pagi hari ",
    303: "xqzj wvkpt qqhx zzkf jwvx bqpd kxzq vvjh wqxz pfkq zjxw hqvk ",
}


def test_foreign_texts_and_junk_are_rejected(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = documents(*[(10**9 + i, text * 4) for i, text in FOREIGN.items()])
    both = docs.select(planted.columns).unionByName(planted)
    kept = {r.doc_id for r in language.keep_identified(both).select("doc_id").collect()}
    assert not kept & {10**9 + i for i in FOREIGN}
    assert len(kept) >= 0.995 * docs.count()
    assert "rejected" in op6_language(spark, "/root/testdata/sf0.001").columns


def test_a_language_left_out_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    docs = docs[docs.lang.notna()].drop_duplicates("text")
    other = docs[docs.lang != "fr"]
    model = language.fit(other.text.tolist(), other.lang.tolist())
    assert model.rates["clean"] <= 0.01 and model.rates["foreign"] >= 0.9 and model.rates["random"] >= 0.9
    assert model.predict(docs[docs.lang == "fr"].text.tolist()).rejected.mean() >= 0.9
    assert model.predict(other.text.tolist()).rejected.mean() <= 0.005
