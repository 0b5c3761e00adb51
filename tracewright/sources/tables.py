"""Views over stored tables, in the canonical shape: an order column and a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_lines(events: DataFrame) -> DataFrame:
    """(line_no, line): agent-trace lines, one per event, in the order of event_id."""
    digest = F.md5(F.col("event_id").cast("string"))
    rid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    tags = F.concat(F.lit('["'), "event_type", F.lit('",'), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(",null]"))
    payload = F.concat(F.lit('{"p":'), "props", F.lit(',"user":{"id":'), F.col("user_id").cast("string"), F.lit(',"tags":'), tags, F.lit("}}"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    line = F.concat(F.lit("["), stamp, F.lit("+00:00] tool_call::"), "event_type", F.lit(" rid="), rid, F.lit(" payload="), payload)
    return events.select(F.col("event_id").alias("line_no"), line.alias("line"))


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): texts cut at line feeds."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


#: splits of text files whose places may be broadcast (24 bytes each)
BROADCAST_SPLITS = 2_000_000


def read_lines(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(line_no, line) of text files, in order of file and place; the first ``first`` only if asked.

    Lines are written once with the split they come from; a split's lines are numbered after a
    count of all splits before it, by file and offset, so there is no global sort.
    """
    split = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    named = [split.alias("split"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    raw = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), *named, F.monotonically_increasing_id().alias("at"))
    raw = settled(raw)
    splits = raw.groupBy("split", "file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    before = F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")  # one row a split
    splits = settled(splits.select("split", (before - F.col("low")).alias("shift")))
    count = splits.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("distinct")).first()
    if count["n"] != count["distinct"]:
        raise RuntimeError("two splits share a hash")
    out = raw.join(F.broadcast(splits) if count["n"] <= BROADCAST_SPLITS else splits, "split").select((F.col("at") + F.col("shift")).alias("line_no"), "line")
    return out if first is None else out.where(F.col("line_no") < first)


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(EventId, EventTemplate) rows of a template file, as text."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path).select("EventId", "EventTemplate").collect()
    return [(r["EventId"], r["EventTemplate"].strip()) for r in rows if (r["EventId"] or "").strip() and (r["EventTemplate"] or "").strip()]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Data sets by name with their log and template paths."""
    return spark.read.schema(StructType.fromDDL("name string, log string, tpl string")).option("header", True).csv(path)
