"""Written tables that cut lineage, in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The session's shared folder; in local mode alone, and only if it is unset, a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later readers survive the loss of any executor."""
    spark = df.sparkSession
    path = f"{folder(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(clear)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """``df`` written, with a broadcast hint if it turns out to have at most ``most`` rows, or rows of that weight together."""
    df = settle(df)
    size = df.count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def clear() -> None:
    """Delete what ``settle`` wrote; call it once no DataFrame built on it is in use."""
    while _written:
        path, spark = _written.popitem()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone, and with it the way to the store
            continue
