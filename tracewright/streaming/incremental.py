"""The same parsing on streams: stateless matching, and state per template.

A stream here is an ordered sequence of lines in files or batches. What a codec
would keep in memory is Spark state: which templates were seen, and the last
value of each slot. Results equal those of the batch functions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import templates as M
from ..sources.scratch import scratch_path

#: state processors travel whole: their workers do not see files added to the application
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """A stream of the files of a stored table, be it a folder or one file, with its schema."""
    stored = spark.read.parquet(path)
    reader = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.rstrip("/").endswith(f"/{name}") for f in stored.inputFiles()[:1]):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def matched(lines: DataFrame, bank: list[M.Template]) -> DataFrame:
    return M.match(lines, bank)


class _FirstSeen(StatefulProcessor):
    """Emits a key once, with the least place of the batch that brought it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        first = min(int(b["line_no"].min()) for b in rows)
        if not self.seen.exists():
            self.seen.update((first,))
            yield pd.DataFrame({"template": [key[0]], "first": [first]})

    def close(self) -> None:
        pass


class _LastValue(StatefulProcessor):
    """Emits each value less the one before it under the same key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("line_no")
        before = self.last.get()[0] if self.last.exists() else 0
        value = batch["value"].astype("int64")
        steps = value - value.shift(1, fill_value=before)
        self.last.update((int(value.iloc[-1]),))
        yield pd.DataFrame({"line_no": batch["line_no"], "template": key[0], "delta": steps})

    def close(self) -> None:
        pass


def new_templates(lines: DataFrame) -> DataFrame:
    """(template, first) of each template when it first appears; wants template and line_no."""
    return lines.groupBy("template").transformWithStateInPandas(_FirstSeen(), "template string, first long", "append", "none")


def slot_deltas(lines: DataFrame) -> DataFrame:
    """(line_no, template, delta) of one integer slot per template; wants template, line_no, value."""
    return lines.groupBy("template").transformWithStateInPandas(_LastValue(), "line_no long, template string, delta long", "append", "none")


def drained(stream: DataFrame, least: int = 0) -> DataFrame:
    """Run a stream over all that is available now, into a written table, and read that.

    ``least`` partitions of state at least, for few and long groups: by their hash, several fall on one of a few partitions.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark), scratch_path(spark)
    key, parts = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before, dealt = spark.conf.get(key), spark.conf.get(parts)
    spark.conf.set(key, ROCKS)
    spark.conf.set(parts, str(max(int(dealt), least)))
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
        spark.conf.set(parts, dealt)
    return spark.read.schema(stream.schema).parquet(out)
