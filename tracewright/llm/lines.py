"""Line deduplication by site-relative frequency, in DataFrame operations only.

Pages are grouped by host. A line is what stands between ``\\n``; lines without
a character other than ASCII white space are never judged. For each host and
distinct line, the pages of the host with that line, divided by all pages of
the host, is the line's ratio. A line goes from every page of the host if the
ratio exceeds ``ratio`` and at least ``min_pages`` of its pages have it.

Plan. Pages explode into distinct line hashes; counting combines on the map
side, so a host or line with a third of all rows sends one row a task. A host
has at most (mean lines a page / ratio) such lines, so the list of a host is
short whatever the input. If all lists together are small (checked by a count)
they are broadcast and pages are filtered in one scan, without a shuffle of
text; beyond that, the distinct hashes are joined (Spark splits skewed join
partitions) and only page ids with the hashes to drop meet the text again.

Lines are compared by a 64-bit hash: a line can be taken for another only if it
collides with one of the host's few boilerplate lines.

Defined cases: a null text stays null and has no lines; an empty one has one
blank line. A null host is a host of its own. Null or repeated ids are kept as
they are: every row is a page. Columns pass through unchanged; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle

RATIO = 0.05
MIN_PAGES = 8
#: rows of (host, line hash) that may be broadcast: 16 bytes each and the host's name
BROADCAST_ROWS = 200_000
_BLANK = " \t\r\x0b\f"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _solid(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(_BLANK))) > 0


def boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash, pages) of each line whose share of its host's pages exceeds ``ratio``."""
    of = pages.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = of.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _solid), lambda x: F.xxhash64(x)))
    found = of.select("host", F.explode(hashes).alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    return found.join(totals, found["host"].eqNullSafe(totals["host"])).where(F.col("pages") > F.col("total") * F.lit(ratio)).select(found["host"], "hash", "pages")


def _judged(pages: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int, broadcast_rows: int) -> tuple[DataFrame, Column]:
    """Pages with a column ``__tw_drop``, the line hashes to drop (null: none), and its use as a test of a line."""
    listed = settle(boilerplate(pages, host_col, text_col, ratio, min_pages))
    if listed.count() <= broadcast_rows:
        by_host = listed.groupBy(F.col("host").alias("__tw_host")).agg(F.collect_list("hash").alias("__tw_drop"))
        return pages.join(F.broadcast(by_host), pages[host_col].eqNullSafe(F.col("__tw_host")), "left").drop("__tw_host"), F.col("__tw_drop")
    row = F.xxhash64(*[F.col(c) for c in (host_col, text_col)])  # pages with the same host and text have the same lines to drop
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), _solid), lambda x: F.xxhash64(x)))
    keyed = pages.select(F.col(host_col).alias("h"), row.alias("__tw_row"), F.explode(hashes).alias("hash")).distinct()
    drops = keyed.join(listed.select(F.col("host"), F.col("hash").alias("hash2")), F.col("h").eqNullSafe(F.col("host")) & (F.col("hash") == F.col("hash2"))).groupBy("__tw_row").agg(F.collect_list("hash").alias("__tw_drop"))
    return pages.withColumn("__tw_key", row).join(drops, F.col("__tw_key") == F.col("__tw_row"), "left").drop("__tw_key", "__tw_row"), F.col("__tw_drop")


def line_dedup(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS, counts: bool = False) -> DataFrame:
    """The pages with boilerplate lines cut out of the text; with ``counts`` also n_lines and n_removed."""
    judged, drop = _judged(pages, host_col, text_col, ratio, min_pages, broadcast_rows)
    text = F.col(text_col)
    kept = F.filter(_lines(text), lambda x: ~(_solid(x) & F.array_contains(drop, F.xxhash64(x))))
    judged = judged.withColumn("__tw_kept", F.when(drop.isNotNull(), kept).otherwise(_lines(text)))
    if counts:
        judged = judged.withColumn("n_lines", F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long")).withColumn("n_removed", F.coalesce(F.size(_lines(text)) - F.size("__tw_kept"), F.lit(0)).cast("long"))
    return judged.withColumn(text_col, F.when(drop.isNotNull() & text.isNotNull(), F.array_join("__tw_kept", "\n")).otherwise(text)).drop("__tw_kept", "__tw_drop")


def oracle(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    return f"""
WITH p AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM p),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
  SELECT s.source, s.line FROM (SELECT DISTINCT rid, source, line FROM l WHERE length(trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) > 0) s
  JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
  GROUP BY s.source, s.line, t.total HAVING count(*) >= {min_pages} AND count(*) > t.total * {ratio})
SELECT p.doc_id, count(l.k)::BIGINT AS n_lines, count(bad.line)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE bad.line IS NULL), '')) AS kept_sha256
FROM p LEFT JOIN l ON p.rid = l.rid LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.line = bad.line
GROUP BY p.rid, p.doc_id"""
