"""The registered queries of the operators in this folder: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import conversations, decontamination, embeddings, fingerprints, langid, minhash, oracles, packing, pitmanyor, sharding, suffixarray, suffixtree, toxicity, whitening
from driftmark.llm.tables import read, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {
    "op1_embeddings": oracles.EMBEDDINGS,
    "op3_suffix_array": oracles.SUBSTRINGS,
    "op4_decontamination": oracles.DECONTAMINATION,
    "op5_suffix_tree": oracles.PASSAGES,
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, folder, "embeddings"))


@query
def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "n_class", "kept")


@query
def op3_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return suffixarray.remove_repeats(read(spark, folder, "documents")).drop("kept")


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


@query
def op5_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffixtree.remove_passages(read(spark, folder, "documents")).drop("kept")


@query
def op6_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 1
    return pitmanyor.score(docs, pitmanyor.fit(docs.where(~held_out)), held_out)


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    weights = toxicity.train(docs, read(spark, folder, "labels").where(~held_out))
    return toxicity.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"))


@query
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(read(spark, folder, "documents"))


@query
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    dictionaries = langid.train(docs.where(remainder(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs, dictionaries)
    return found.withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)


@query
def op11_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_pairs(read(spark, folder, "documents"))


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"))


@query
def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.audit(conversations.damage(read(spark, folder, "conversations")), dropped_col="dropped")
