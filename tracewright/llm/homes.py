"""Dealing documents to *homes*, and hashes to *buckets*.

A home is a group of whole documents that one Python call holds, dealt by the
hash of the document id; a bucket is a range of the 64-bit hash space. What a
home tells a bucket is packed into one binary cell per (home, bucket), already
deduplicated, so that no key, however common, sends more than one entry a home.
Counts of both follow from Spark's own size estimate and the session's shuffle
partitions, never from a constant for the input at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: text bytes a home should hold; Parquet text is taken to unpack twofold
HOME_BYTES = 16 << 20
#: stands for a null document id: later than all others
NO_ID = (1 << 63) - 1


def counts(spark: SparkSession, docs: DataFrame) -> tuple[int, int]:
    """Numbers of homes and of buckets for these documents."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = min(size, 1 << 57)  # an unknown size is reported as a huge number
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    by_size = -(-2 * size // HOME_BYTES) if size < 1 << 50 else 0
    homes = max(3 * parts, by_size)
    return homes, max(parts, homes // 3)


def home(ids: Column, homes: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(homes)).cast("int")


def housed(docs: DataFrame, id_col: str, text_col: str, homes: int) -> DataFrame:
    """(home, doc_id, text) of every row; a null id becomes NO_ID, a null text empty."""
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(home(ids, homes).alias("home"), ids.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def named(ids: Column) -> Column:
    """Back from NO_ID to null."""
    return F.when(ids == F.lit(NO_ID), F.lit(None).cast("long")).otherwise(ids)
