"""A lossless event store: Parquet with zstd, in order, with indexes as further tables.

Layout of a store: ``events`` (line_no, event_id, tpl, params, raw line where no
template fits, packet_id, block_id), ``templates``, ``meta`` (format, kind) and,
in kind ``hot`` or after ``upgrade``, ``tokens`` (distinct packet and token).
Kind ``dict`` has, instead of events and templates, ``packets`` (whole packets,
compressed with a trained dictionary) and that ``dictionary`` itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forms
from ..operators import index as I
from ..operators import templates as M
from .scratch import scratch_path, settled

__all__ = ["scratch_path", "settled"]

FORMAT = 2
KINDS = ("lite", "cold", "hot", "dict")
#: packets that a dictionary is trained on
TRAINED = 32


def write(lines: DataFrame, bank: list[M.Template], path: str, kind: str = "lite", packet: int = I.PACKET, group: int = I.GROUP) -> None:
    """Write (line_no, line) as a store of kind ``lite`` (events), ``cold`` (strongest compression), ``hot`` (with a token index) or ``dict``."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    spark = lines.sparkSession
    if kind == "dict":
        _write_packets(I.packets(lines, packet, group), path)
        spark.createDataFrame([(FORMAT, kind)], "format int, kind string").coalesce(1).write.parquet(f"{path}/meta")
        return
    matched = I.packets(M.match(lines, bank), packet, group)
    events = matched.select("line_no", "event_id", "tpl", "params", F.when(F.col("event_id").isNull(), F.col("line")).alias("raw"), "packet_id", "block_id")
    out = events.repartitionByRange("line_no").sortWithinPartitions("line_no").write.option("compression", "zstd")
    if kind == "cold":
        out = out.option("parquet.compression.codec.zstd.level", "19")
    out.parquet(f"{path}/events")
    M.bank_table(spark, bank).coalesce(1).write.parquet(f"{path}/templates")
    spark.createDataFrame([(FORMAT, kind)], "format int, kind string").coalesce(1).write.parquet(f"{path}/meta")
    if kind == "hot":
        upgrade(spark, path)


def _write_packets(packed: DataFrame, path: str) -> None:
    """Packets compressed each on its own with a dictionary learnt from the first TRAINED of them."""
    book = forms.train(packed.where(F.col("packet_id") < TRAINED), "line_no")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("line_no")
        raw = forms.plain(t.column("line_no").to_pylist(), t.column("line").to_pylist())
        return pa.table({"packet_id": [key[0].as_py()], "block_id": [t.column("block_id")[0].as_py()], "n_lines": [t.num_rows], "raw_bytes": [len(raw)], "packed": [forms.squeezed(raw, book)]})

    made = packed.select("packet_id", "block_id", "line_no", "line").groupBy("packet_id").applyInArrow(run, "packet_id long, block_id long, n_lines long, raw_bytes long, packed binary")
    made.repartitionByRange("packet_id").sortWithinPartitions("packet_id").write.parquet(f"{path}/packets")
    packed.sparkSession.createDataFrame([(bytearray(book),)], "book binary").coalesce(1).write.parquet(f"{path}/dictionary")


def _read_packets(spark: SparkSession, path: str) -> DataFrame:
    book = bytes(spark.read.parquet(f"{path}/dictionary").first()["book"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packet, block, packed in zip(*(b.column(c).to_pylist() for c in ("packet_id", "block_id", "packed")), strict=True):
                places, lines = forms.unplain(forms.unsqueezed(packed, book))
                yield pa.RecordBatch.from_pydict({"line_no": places, "line": lines, "packet_id": [packet] * len(places), "block_id": [block] * len(places)}, pa.schema([("line_no", pa.int64()), ("line", pa.string()), ("packet_id", pa.int64()), ("block_id", pa.int64())]))

    out = spark.read.parquet(f"{path}/packets").select("packet_id", "block_id", "packed").mapInArrow(run, "line_no long, line string, packet_id long, block_id long")
    return out.select("line_no", "line", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("array<string>").alias("params"), "packet_id", "block_id")


def templates(spark: SparkSession, path: str) -> list[M.Template]:
    rows = spark.read.parquet(f"{path}/templates").orderBy("prio").collect()
    return [M.Template(r["event_id"], r["template"], tuple(r["literals"])) for r in rows]


def upgrade(spark: SparkSession, path: str) -> None:
    """Add the token index to a store that lacks it."""
    tokens = I.token_index(read(spark, path), ["block_id", "packet_id"])
    tokens.repartitionByRange("token").sortWithinPartitions("token").write.mode("ignore").option("compression", "zstd").parquet(f"{path}/tokens")


def kind_of(spark: SparkSession, path: str) -> str:
    """The kind of the store at a path; an error if there is none or its format is unknown."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None or meta["format"] != FORMAT:
        raise ValueError(f"not a store of format {FORMAT}: {path}")
    return meta["kind"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """All lines, restored: line_no, line, event_id, params, packet_id, block_id."""
    if kind_of(spark, path) == "dict":
        return _read_packets(spark, path)
    events = M.render(spark.read.parquet(f"{path}/events"), templates(spark, path))
    return events.select("line_no", F.coalesce("rendered", "raw").alias("line"), "event_id", "params", "packet_id", "block_id")


def read_packets(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    return I.packet_range(read(spark, path), start, stop)


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token index, built first if the store has none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/tokens")
    except AnalysisException:
        upgrade(spark, path)
        return spark.read.parquet(f"{path}/tokens")


def commit(spark: SparkSession, path: str, records: DataFrame) -> None:
    """Append commit records (seq, packet_version, used_tier, confidence, text)."""
    records.withColumn("text_fingerprint", F.substring(F.sha2("text", 256), 1, 12)).write.mode("append").parquet(path)


def last_commit(commits: DataFrame) -> DataFrame:
    """The record of the highest sequence number, as one row; of several with that number the greatest by their other columns."""
    others = [c for c in commits.columns if c != "seq"]
    return commits.agg(F.max(F.struct("seq", *others)).alias("r")).select(*[F.col(f"r.{c}") for c in commits.columns])
