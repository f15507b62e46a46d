"""Tables that operators write on the way, and small Spark helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.session import checkpoint_root


#: Rows and bytes of an Arrow batch where whole texts travel: many long texts at once would fill an executor and its workers.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches to ``BATCH_ROWS`` and about ``BATCH_BYTES``."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) not in range(1, BATCH_ROWS + 1):
        conf.set(key, str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def tidied(work: Callable) -> Callable:
    """``work`` over Arrow batches, after which the worker gives freed memory back; workers live on between stages."""
    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return run


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once into the shared folder of ``spark.checkpoint.dir`` and read again.

    What follows starts from these files, so a lost executor costs no more than its own tasks.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SIEVE_WORDS = 1 << 18


def sieve(keys: DataFrame, h: str) -> DataFrame:
    """A bit set of 2**24 bits over the hashes in column ``h``: at most ``SIEVE_WORDS`` rows (word, bits), whatever the keys.

    So it may be broadcast.  It lets all keys through and few others while keys are fewer than bits; past that it only
    lets more through.
    """
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(`{h}`, 18) & 63 AS INT))")
    return keys.groupBy(F.pmod(F.col(h), F.lit(SIEVE_WORDS)).alias("sieve_word")).agg(F.bit_or(bit).alias("sieve_bits"))


def sifted(df: DataFrame, h: str, through: DataFrame, name: str = "let_through") -> DataFrame:
    """``df`` with a column that is true for all rows whose hash ``h`` is a key of the sieve, and few others."""
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(`{h}`, 18) & 63 AS INT))")
    met = df.join(F.broadcast(through), F.pmod(F.col(h), F.lit(SIEVE_WORDS)) == F.col("sieve_word"), "left")
    return met.withColumn(name, F.coalesce(F.col("sieve_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("sieve_word", "sieve_bits")


def parts_for(total: int, each: int, spark: SparkSession) -> int:
    """How many parts of about ``each`` make up ``total``; no fewer than the shuffle partitions set."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total or 0) // each))


def remainder(doc_id, modulus: int):
    """crc32 of the id as text modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))
