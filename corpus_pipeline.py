"""A training-data pipeline over ``documents``: language, near copies, repeated passages, benchmark text, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import decontamination, langid, minhash, packing, suffixtree
from driftmark.llm.tables import read, remainder, sieve, sifted, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin, with the language found; the rest go."""
    dictionaries = langid.train(docs.where(remainder(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs, dictionaries, keep=("text", "source", "n_chars"))
    return found.where("not rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest id; of rows that repeat it wholly, one.

    Only rows that may have to go travel: those whose text a sieve knows as dropped or repeated.  Null texts count as
    empty; a null id comes after all others; texts without words are only copies of their like.
    """
    found = stored(minhash.near_duplicates(docs).groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("rows"), F.bool_and("kept").alias("stays")).where("rows > 1 or not stays"), "near-copies")
    marked = sifted(docs.select(*COLUMNS, *minhash.fingerprint(F.col("text"))), "h1", sieve(found, "h1"))
    gone = found.where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    tested = marked.where("let_through").join(gone, same, "left_anti").dropDuplicates(["doc_id", "h1", "h2"])
    return marked.where("not let_through").unionByName(tested).select(*COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier; texts that lose nothing stay as they are."""
    found = suffixtree.remove_passages(docs, keep=("text", "lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return found.select(
        "doc_id", F.when(changed, F.col("kept")).otherwise(F.col("rest.text")).alias("text"), "rest.lang", "rest.source",
        F.when(changed, F.length("kept").cast("long")).otherwise(F.col("rest.n_chars")).alias("n_chars"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    key = F.struct(F.col("doc_id"), F.xxhash64(F.col("text"), F.col("text").isNull()).alias("h"))
    found = decontamination.contamination(docs.withColumn("key", key), read(spark, sf_dir, "benchmark"), id_col="key", slop=-1)
    hit = found.where("n_hit > 0").select(F.col("doc_id.doc_id").alias("hit_id"), F.col("doc_id.h").alias("hit_h"))
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (key["h"] == F.col("hit_h")), "left_anti").select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("passages", remove_repeated_passages),
    ("benchmark", drop_contaminated),
    ("packing", pack_windows),
]

#: SQL has no tokenizer, compressor or signatures; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
