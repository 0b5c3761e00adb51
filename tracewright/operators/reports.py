"""Reports: compressed sizes, selectivity, frequent words, occurrences."""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forms

# Words that are no probe.
STOP = ("could", "from", "have", "that", "then", "this", "when", "where", "will", "with")


def compressed(lines: DataFrame, block: str, line: str = "line", order: list[str] | None = None) -> DataFrame:
    """(method, raw_bytes, bytes): each block's lines compressed on its own by general methods."""
    order = order or ["line_no"]

    def sizes(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        raw = "\n".join(pdf.sort_values(order)[line]).encode()
        methods = {
            "raw": lambda x: x,
            "gzip-9": lambda x: gzip.compress(x, 9, mtime=0),
            "bzip2-9": lambda x: bz2.compress(x, 9),
            "xz-6": lambda x: lzma.compress(x, preset=6),
            "zstd-10": zstandard.ZstdCompressor(level=10).compress,
            "zstd-19": zstandard.ZstdCompressor(level=19).compress,
        }
        return pd.DataFrame({"method": list(methods), "raw_bytes": len(raw), "bytes": [len(f(raw)) for f in methods.values()]})

    each = lines.select(block, *order, line).groupBy(block).applyInPandas(sizes, "method string, raw_bytes long, bytes long")
    return each.groupBy("method").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("bytes").alias("bytes")).withColumn("ratio", F.round(F.col("raw_bytes") / F.col("bytes"), 3)).orderBy("bytes", "method")


def trained(lines: DataFrame, block: str, first: int, line: str = "line", size: int = 16_384, order: str = "line_no") -> DataFrame:
    """(block, raw_bytes, bytes): zstd with a dictionary trained once on the ``first`` lowest blocks, all lines in order."""
    book = forms.train(lines.where(F.col(block) < first), order, line, size)

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [x.encode() for x in b["text"]]
            yield pd.DataFrame({block: b[block], "raw_bytes": [len(x) for x in raw], "bytes": [len(forms.squeezed(x, book)) for x in raw]})

    in_order = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(line), F.lit("")).alias("x")))), lambda r: r["x"])
    whole = lines.groupBy(block).agg(F.array_join(in_order, "\n").alias("text"))
    return whole.mapInPandas(sizes, f"{block} long, raw_bytes long, bytes long")


def selectivity(lines: DataFrame, units: DataFrame | None, unit: str) -> DataFrame:
    """One row: all units, units selected, lines read."""
    kept = lines if units is None else lines.join(units, unit, "left_semi")
    every = lines.agg(F.count_distinct(unit).alias("n_units"), F.count(F.lit(1)).alias("n_lines"))
    return every.crossJoin(kept.agg(F.count_distinct(unit).alias("n_selected"), F.count(F.lit(1)).alias("n_read")))  # one row each


def probe_words(lines: DataFrame, line: str = "line") -> DataFrame:
    """(word, n) of words of four letters or more outside the stop list, most frequent first."""
    words = lines.select(F.explode(F.regexp_extract_all(F.lower(line), F.lit("[a-z_]{4,}"), F.lit(0))).alias("word"))
    return words.where(~F.col("word").isin(*STOP)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word")


def occurrences(lines: DataFrame, term: str, line: str = "line") -> DataFrame:
    """How often the term occurs, whatever its case, without overlaps."""
    text = F.lower(line)
    n = (F.length(text) - F.length(F.replace(text, F.lit(term.lower()), F.lit("")))) / len(term)
    return lines.agg(F.coalesce(F.sum(n.cast("long")), F.lit(0)).cast("long").alias("n_occurrences"), F.coalesce(F.sum((n > 0).cast("long")), F.lit(0)).alias("n_lines"))
