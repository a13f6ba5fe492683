"""The text operators on the driver's tables; every query reads its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (
    attribution,
    decontamination,
    extraction,
    language,
    language_model,
    merkle,
    mixing,
    search,
    secrets,
    sharding,
    simhash,
    token_output,
    whitening,
)
from .common import read_table

#: Shards that the corpus is written to.
N_SHARDS = 16

#: File of the installed package of public tokenizers.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document, with the forest's verdict."""
    found = secrets.scan_secrets(read_table(spark, sf_dir, "documents"), F.col("source"))
    digest = F.sha2("value", 256).alias("value_sha256")
    return found.select("doc_id", "start", "n_chars", digest, "score", "secret")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to one of 16 shards of nearly equal bytes."""
    return sharding.shard_slots(read_table(spark, sf_dir, "documents"), N_SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every twentieth document as a query."""
    docs = read_table(spark, sf_dir, "documents")
    queries = docs.filter(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "query_id")
    return search.top_k(docs, queries)


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article text of every page."""
    pages = read_table(spark, sf_dir, "pages")
    text = F.coalesce(extraction.main_text(F.col("html"), pages), F.lit("")).alias("text")
    found = pages.select("page_id", "url", text)
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights takes of every document."""
    counts = mixing.mix_counts(read_table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", "taken")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    learnable = language.learnable(F.col("doc_id"))
    model = language.fit_documents(docs.filter(learnable))
    return docs.select(
        "doc_id",
        (~learnable).alias("held_out"),
        language.predict(F.col("text"), model, docs).alias("found"),
    ).select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in passages of the benchmark."""
    docs, benchmark = (read_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = decontamination.overlap(docs.select("doc_id", "text"), benchmark)
    named = F.array_join(F.array_sort(F.col("found.items").cast("array<string>")), ",")
    return found.select(
        "row.doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(named, 256).alias("items_sha256"),
        decontamination.contaminated(F.col("found")).alias("contaminated"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from the encoding of the whole document."""
    docs = read_table(spark, sf_dir, "documents")
    return attribution.attribute_tokens(docs, tokenizer_path(), special=True)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and checksum of the ids of every document, read back from the token files."""
    path = scratch_path(spark, "tokens")
    docs = read_table(spark, sf_dir, "documents")
    token_output.write_tokens(docs, path, tokenizer_path(), special=True)
    return token_output.read_documents(spark, path)


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under unigrams and under the interpolated model."""
    docs = read_table(spark, sf_dir, "documents")
    learn = language_model.trained_on(F.col("doc_id"))
    found = language_model.score_documents(docs, learn, ["doc_id"]).withColumn(
        "doc_id", F.col("row.doc_id")
    )
    held_out = (~language_model.trained_on(F.col("doc_id"))).alias("held_out")
    return found.select(
        "doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in the dataset's manifest, checked against texts of which a third
    has been tampered with."""
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    shown = F.when(tampered, merkle.digest_of([*fields[:-1], lowered]))
    manifest = merkle.build_manifest(
        docs, F.col("lang"), F.col("doc_id"), fields, ["doc_id"], shown
    )
    found = merkle.prove(manifest)
    return found.select(F.col("row.doc_id"), *found.columns[1:])


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of every embedding, whitened."""
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    found = found.select("*", F.posexplode("whitened").alias("at", "value"))
    return found.select(
        F.col("row.vec_id"),
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("value").alias("whitened"),
        F.col("explained")[F.col("at")].alias("explained"),
        "identity_error",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_sharding": op2_sharding,
    "op3_search": op3_search,
    "op4_extraction": op4_extraction,
    "op5_mixing": op5_mixing,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_token_output": op10_token_output,
    "op11_language_model": op11_language_model,
    "op12_merkle": op12_merkle,
    "op13_whitening": op13_whitening,
}
