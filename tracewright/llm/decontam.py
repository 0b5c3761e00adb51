"""Benchmark decontamination with lossless seeds, in DataFrame operations only.

Texts become lower-case tokens, cut at ASCII white space and punctuation. A
document leaks an item if, along aligned tokens (a diagonal: document place minus
item place), a window of n = min(``window``, item length) tokens agrees in at
least ``similarity`` of them.

Seeds are runs of equal tokens, and miss no such window: m equal tokens and n - m
others make at most n - m + 1 runs, of which the longest has m / (n - m + 1)
tokens, rounded up. That is an item's seed width q (3 for the default rule and
items of 9 tokens or more; 1 to 3 below), at most WIDEST. Each token that differs
spoils at most q of the n - q + 1 seeds of a window, so a diagonal with fewer than
n - q + 1 - q (n - m) hits is no candidate. Each candidate is verified in full.

Plan. The widths that occur are collected (at most WIDEST numbers). The
benchmark's seeds are broadcast after a count of them, else joined by a shuffle.
Documents explode into (place, hash) without their text, in generated code; hits
reduce to one row per (document, item, diagonal) on the map side. Only documents
with candidates are tokenised again. Their texts are not moved while the hits are
few enough to be broadcast (counted) and so are the items (their bytes summed);
beyond that they are joined by a shuffle.

Defined cases: null and empty texts have no tokens and no hits; items of fewer
than ``least_item`` tokens match nothing (the registered query and the pipeline
take every item: least_item=1; an item of up to 3 tokens must then occur
verbatim); null ids match nothing; rows that repeat an id are judged each and
reported once per id and item (the best window). Other columns are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle, small

#: tokens of the widest seed
WIDEST = 8
#: items below are left out unless the caller says otherwise
LEAST_ITEM = 11
WINDOW = 20
SIMILARITY = 0.75
#: benchmark seeds (about 24 bytes each) and hits that may be broadcast
BROADCAST_SEEDS = 1_000_000
BROADCAST_HITS = 200_000
#: the items' tokens may be broadcast if they take at most as many bytes as that many hits
HIT_BYTES = 160
_CUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _CUT), "")


def _hash(words: Column, i: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(words, i + j) for j in range(width)])


def _runs(words: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: _hash(words, i, width))


def _items(benchmark: DataFrame, window: int, similarity: float, least_item: int, item_col: str, item_text: str) -> DataFrame:
    """item, tokens b, window n, seed width q and the least number of hits on a diagonal."""
    cut = benchmark.select(F.col(item_col).cast("long").alias("item"), tokens(F.col(item_text)).alias("b")).where(F.col("item").isNotNull()).distinct()
    cut = cut.where(F.size("b") >= max(least_item, 1)).withColumn("n", F.least(F.lit(window), F.size("b")))
    cut = cut.withColumn("m", F.ceil(F.col("n") * F.lit(similarity)).cast("int"))
    cut = cut.withColumn("q", F.least(F.lit(WIDEST), F.greatest(F.lit(1), F.ceil(F.col("m") / (F.col("n") - F.col("m") + 1)).cast("int"))))
    return cut.withColumn("least", F.greatest(F.lit(1), F.expr("n - q + 1 - q * (n - m)"))).drop("m")


def _item_seeds(items: DataFrame, widths: list[int]) -> DataFrame:
    seeds = F.lit(None)
    for k in widths:
        seeds = F.when(F.col("q") == k, _runs(F.col("b"), k)).otherwise(seeds)
    return items.select("item", "least", F.posexplode(seeds).alias("item_at", "seed"))


def _doc_seeds(docs: DataFrame, widths: list[int], id_col: str, text_col: str) -> DataFrame:
    """Seeds of all widths at each place where they fit; tokens are laid beside their successors, so that no lambda runs over them."""
    cut = docs.select(F.col(id_col).cast("long").alias("doc"), tokens(F.col(text_col)).alias("w")).where(F.col("doc").isNotNull())
    beside = F.arrays_zip(*[(F.slice("w", k + 1, F.size("w")) if k else F.col("w")).alias(f"t{k}") for k in range(max(widths))])
    places = cut.select("doc", F.posexplode(beside).alias("doc_at", "t"))
    seeds = [F.when(F.col(f"t.t{k - 1}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"t.t{j}") for j in range(k)])) for k in widths]
    found = places.select("doc", "doc_at", seeds[0].alias("seed") if len(seeds) == 1 else F.explode(F.array(*seeds)).alias("seed"))
    return found.where(F.col("seed").isNotNull())


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS, broadcast_hits: int = BROADCAST_HITS, least_item: int = LEAST_ITEM) -> DataFrame:
    """doc_id, item_id, n_window, n_equal: the best window of each contaminated (document, item)."""
    known = settle(_items(benchmark, window, similarity, least_item, item_col, item_text))
    widths = sorted(r[0] for r in known.select("q").distinct().collect()) or [1]
    seeds = small(_item_seeds(known, widths), broadcast_seeds)
    place = _doc_seeds(docs, widths, id_col, text_col)
    hits = place.join(seeds, "seed").groupBy("doc", "item", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("met"), F.min("least").alias("least"))
    hits = small(hits.where(F.col("met") >= F.col("least")).drop("met", "least"), broadcast_hits)
    items = small(known.select("item", "b", F.col("n").alias("n_window")), broadcast_hits * HIT_BYTES, 48 + F.length(F.array_join("b", " ")) + 32 * F.size("b"))
    words = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    # texts stay where they are read: hits, then items, come to them
    # written: an expression over ``w`` would else cut the text again at every place it looks at
    met = settle(words.join(hits, "doc").join(items, "item").withColumn("w", tokens(F.col("text"))).drop("text"))
    first = F.greatest(F.lit(0), -F.col("diagonal"))
    last = F.least(F.size("b"), F.size("w") - F.col("diagonal")) - 1
    equal = F.transform(F.sequence(first, last), lambda i: (F.get("b", i) == F.get("w", i + F.col("diagonal"))).cast("int"))
    met = met.where(last >= first).withColumn("eq", equal).where(F.size("eq") >= F.col("n_window"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("eq") - F.col("n_window") + 1), lambda i: F.aggregate(F.slice("eq", i, F.col("n_window")), F.lit(0), lambda a, x: a + x)))
    found = met.select("doc", "item", "n_window", best.alias("n_equal")).where(F.col("n_equal") >= F.ceil(F.col("n_window") * F.lit(similarity)))
    return found.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("n_window").cast("long").alias("n_window"), F.max("n_equal").cast("long").alias("n_equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_hits: int = BROADCAST_HITS, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without the contaminated ones; rows with a null id stay."""
    bad = small(contaminated(docs, benchmark, id_col=id_col, broadcast_hits=broadcast_hits, **options).select(F.col("doc_id").alias("__tw_bad")).distinct(), broadcast_hits)
    return docs.join(bad, F.col(id_col).cast("long") == F.col("__tw_bad"), "left_anti")
