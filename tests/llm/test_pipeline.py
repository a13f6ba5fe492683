from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from cellprofiles.llm import decontamination, language, mixing, simhash
from cellprofiles.llm.oracles import ORACLES
from cellprofiles.llm.queries import QUERIES
from cellprofiles.session import materialize
from check_oracles import normal

SF = "/root/testdata/sf0.001"


def test_stages_on_the_small_table(spark):
    docs = corpus_pipeline.read_table(spark, SF, "documents")
    columns, tables = docs.columns, [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        tables.append(docs.toPandas())
    assert all(list(t.columns) == columns for t in tables[:5])
    read, known, single, clean, mixed, sharded = tables
    assert len(known) == len(read)  # every text is in one of the languages
    prints = {d: simhash._fingerprint(t.encode(), 4, __import__("xxhash").xxh64_intdigest) for d, t in zip(known.doc_id, known.text, strict=True)}
    parent = {d: d for d in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 4:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    assert sorted(single.doc_id) == [d for d in ids if top(d) == d]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    items = [(i, decontamination.words_of(t.encode())) for i, t in zip(benchmark.item_id, benchmark.text, strict=True)]
    block = decontamination.WindowBlock.build(items, 13)
    found = decontamination.scan_shard([t.encode() for t in single.text], [block])
    dirty = (found.n_hit > 0) & (20 * found.n_hit >= found.n_words)
    assert sorted(clean.doc_id) == sorted(single.doc_id[~dirty.to_numpy()])
    times = mixing.mix_counts(spark.createDataFrame(clean)).toPandas().set_index("doc_id").times
    assert mixed.doc_id.value_counts().to_dict() == times[times > 0].to_dict()
    assert sorted(sharded.doc_id) == sorted(mixed.doc_id) and sharded.groupby("text").shard.nunique().max() == 1
    assert sharded.shard.between(0, 15).all()
    whole = corpus_pipeline.run(spark, SF).toPandas()
    pd.testing.assert_frame_equal(normal(whole), normal(sharded))


def test_stages_on_odd_rows(spark, documents):
    docs = documents((1, None), (2, ""), (None, "the only words here"), (3, "x " * 9000, "en", None), (3, "x " * 9000, "en", None))
    extra = docs.selectExpr("*", "1 AS shard", "2 AS key", "'k' AS fp", "map('a', 1) AS m")
    for table in (docs, extra, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns, name
            out.collect()
        assert "shard" in corpus_pipeline.STAGES[-1][1](spark, table, SF).columns


def test_pass_through_columns(spark, documents):
    docs = documents((1, "some words in here", "en", "a")).selectExpr("*", "1 AS _row", "map('a', 1) AS m", "3 AS `odd.name`")
    nothing = spark.createDataFrame([], "item_id long, text string")
    for out in (language.keep_identified(docs), simhash.drop_near_duplicates(docs),
                decontamination.remove_contaminated(docs, nothing), mixing.mix_documents(docs)):
        assert out.columns == docs.columns
        out.collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours = normal(QUERIES[name](spark, SF).toPandas())
    pd.testing.assert_frame_equal(ours, normal(con.execute(ORACLES[name]).df()), check_dtype=False)


def test_every_query_runs(spark):
    for name in ("op1_secrets", "op2_sharding", "op9_token_counts", "op10_token_output"):
        assert QUERIES[name](spark, SF).count() > 0
