"""Written tables of the engine, in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: list[tuple[SparkSession, str]] = []


def _delete() -> None:
    while _temporary:
        spark, path = _temporary.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone, and with it the way to the store
            continue


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names (in local mode alone, if unset, one of this machine)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="store-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not _temporary:
        atexit.register(_delete)
    path = f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"
    _temporary.append((spark, path))
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df`` written and read back: numbers in it are fixed from here on."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
