"""Row identity, bucket counts and checkpoints for the operators of this subpackage.

A document is identified by (doc_id, CRC-32 of its text), so rows that share a doc_id but not the
text stay apart, and rows that share both are one document and get one result each. A null doc_id
counts as the smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.checkpoints import checkpointed  # noqa: F401
from millrace.functions.joins import fresh, matched  # noqa: F401

LEAST = -(1 << 63)
#: A partition holds some buckets, which its task takes one after another, so it keeps one bucket in memory.
BUCKETS_PER_PARTITION = 4
#: Bytes of text that a block of documents has for each bucket at least, and at most in all.
BYTES_PER_BUCKET = 32 << 10
MOST_BLOCK_BYTES = 64 << 20


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id and text (and `more`), with the key columns _id and _crc; the text as bytes-safe string."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("_id"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_crc"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *more,
    )


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession) -> int:
    """Buckets follow the number of shuffle partitions, which a deployment sizes by its input."""
    return BUCKETS_PER_PARTITION * partitions(spark)


def block_bytes(n_buckets: int, least: int) -> int:
    """Text of a block of documents. It grows with the buckets, so a packed row of block and bucket keeps
    its size, and there are as many packed rows as the input has bytes, not blocks times buckets."""
    return max(least, min(MOST_BLOCK_BYTES, n_buckets * BYTES_PER_BUCKET))


def dealt(packed: DataFrame) -> DataFrame:
    """(bucket, ...) rows, each bucket in one partition and a partition's buckets in order."""
    n = partitions(packed.sparkSession)
    return packed.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n))).sortWithinPartitions("bucket")
