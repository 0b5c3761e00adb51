"""Value-level encodings: dictionaries, deltas, runs, move-to-front, bit widths, code lengths.

A dictionary here always holds every value: nothing is capped or mapped to a
stand-in. Values keep their text; derived types stand beside them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..sources.scratch import settled

INT_HITS = 50
DICT_SAVES = 12
#: places of the order column that one task holds of a stream
STRETCH = 100_000


def dictionary(values: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(value, id, n): dense ids in order of first appearance. ``order`` must tell all rows apart.

    Ids come from a range sort of the distinct values and a count of each range,
    so that no single task numbers the dictionary.
    """
    first = values.groupBy(value).agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n"))
    return number(first, ["first"], "id").drop("first")


def number(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds a dense number from 0 in the given order, without a window over all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND((1 << 33) - 1))
    ranged = settled(ranged)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).select("__part", "__before")  # one row a partition
    return ranged.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__row")).drop("__at", "__part", "__row", "__before")


def dictionary_by_count(values: DataFrame, value: str, order: list[str], partition: str) -> DataFrame:
    """(partition, value, n, code): codes by falling frequency, then first appearance, within each channel.

    All channels are numbered together by a range sort, and a channel's codes count from its first number.
    """
    found = values.groupBy(partition, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    numbered = number(found, [F.col(partition), F.desc("n"), F.asc("first")], "__id")
    starts = numbered.groupBy(F.col(partition).alias("__channel")).agg(F.min("__id").alias("__start"))
    return numbered.join(starts, F.col(partition).eqNullSafe(F.col("__channel"))).withColumn("code", F.col("__id") - F.col("__start")).drop("first", "__id", "__channel", "__start")


def channels(matched: DataFrame, keys: list[str]) -> DataFrame:
    """One row per parameter: keys, event_id, channel, value."""
    return matched.where(F.col("event_id").isNotNull()).select(*keys, "event_id", F.posexplode("params").alias("channel", "value"))


def channel_types(found: DataFrame) -> DataFrame:
    """Per channel: raw, int, hex, ip or dict, with counts. Empty values do not vote."""
    v = F.when(F.col("value") != "", F.col("value"))
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    each = found.withColumn("v", v).groupBy("event_id", "channel").agg(
        F.count("v").alias("n"),
        F.count_distinct("v").alias("n_distinct"),
        F.bool_and(F.col("v").rlike("^[+-]?[0-9]+$")).alias("i"),
        F.bool_and(F.col("v").rlike(rf"^{octet}(\.{octet}){{3}}$")).alias("p"),
        F.bool_and(F.col("v").rlike("^(0x)?[0-9a-fA-F]{6,}$")).alias("x"),
    )
    kind = F.when(F.col("n") == 0, "raw").when(F.col("i"), "int").when(F.col("p"), "ip").when(F.col("x"), "hex").when(F.col("n") - F.col("n_distinct") >= DICT_SAVES, "dict").otherwise("raw")
    return each.select("event_id", "channel", "n", "n_distinct", kind.alias("kind"))


def slot_types(found: DataFrame) -> DataFrame:
    """Per slot: int if enough values parse as integers, else dict."""
    hits = F.count(F.expr("try_cast(value AS bigint)"))
    return found.groupBy("event_id", "channel").agg(hits.alias("n_int"), F.count(F.lit(1)).alias("n")).withColumn("kind", F.when(F.col("n_int") >= INT_HITS, "int").otherwise("dict"))


def delta(value: str, by: list[str], order: list[str]) -> Column:
    """The value less the one before it in its stream; the first counts from 0."""
    return F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*by).orderBy(*order)), F.lit(0))


def _stretches(df: DataFrame, by: list[str], order: list[str], carried: Column, name: str, value: Column, size: int) -> tuple[DataFrame, WindowSpec]:
    """Rows with a column ``name``, cut into stretches of ``size`` places, each led by a row that carries ``carried`` of those before.

    ``carried`` is an expression over the sums of earlier stretches: see the callers. Streams are groups of
    ``by``; only rows of one stretch of one stream share a window, and one row a stretch is ordered by stream.
    """
    cut = df.withColumn("__s", F.floor(F.col(order[0]) / size)).withColumn("__row", F.lit(1)).withColumn(name, value)
    heads = cut.groupBy(*by, "__s").agg(F.max_by(name, F.struct(*order)).alias("__last"), F.sum(name).alias("__sum") if name != "__held" else F.lit(None).alias("__sum"))
    heads = heads.withColumn(name, carried).withColumn("__row", F.lit(0)).drop("__last", "__sum")
    return cut.unionByName(heads, allowMissingColumns=True), Window.partitionBy(*by, "__s").orderBy("__row", *order)


def deltas(df: DataFrame, value: str, by: list[str], order: list[str], name: str = "delta", size: int = STRETCH) -> DataFrame:
    """``delta`` for streams of any length: adds it as ``name``. The first of ``order`` must be an integer place."""
    before = F.lag("__last").over(Window.partitionBy(*by).orderBy("__s"))
    every, w = _stretches(df, by, order, before, "__held", F.col(value), size)
    return every.withColumn(name, F.col(value) - F.coalesce(F.lag("__held").over(w), F.lit(0))).where("__row = 1").drop("__s", "__row", "__held")


def adaptive(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds delta, abs_bytes, delta_bytes and the shorter choice (the value itself, if equal)."""
    out = deltas(df, value, by, order).withColumn("abs_bytes", N.uvarint_bytes(N.zigzag(F.col(value)))).withColumn("delta_bytes", N.uvarint_bytes(N.zigzag(F.col("delta"))))
    return out.withColumn("choice", F.when(F.col("delta_bytes") < F.col("abs_bytes"), "delta").otherwise("abs"))


def restore(df: DataFrame, step: str, by: list[str], order: list[str]) -> DataFrame:
    """Inverse of ``delta``: running sums, for streams of any length."""
    return _sums(df, step, by, order, "restored", STRETCH)


def _sums(df: DataFrame, step: str, by: list[str], order: list[str], name: str, size: int) -> DataFrame:
    before = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    every, w = _stretches(df, by, order, before, "__step", F.col(step), size)
    return every.withColumn(name, F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__row = 1").drop("__s", "__row", "__step")


def runs(df: DataFrame, value: str, by: list[str], order: list[str], size: int = STRETCH) -> DataFrame:
    """Run-length form: by, run, value, length, first place."""
    before = F.lag("__last").over(Window.partitionBy(*by).orderBy("__s"))
    every, w = _stretches(df, by, order, before, "__held", F.struct(F.col(value).alias("v")), size)
    change = ~F.struct(F.col(value).alias("v")).eqNullSafe(F.lag("__held").over(w))  # the first row of a stream has nothing before it
    marked = every.withColumn("__c", change.cast("int")).where("__row = 1").drop("__s", "__row", "__held")
    marked = _sums(marked, "__c", by, order, "run", size)
    return marked.groupBy(*by, "run").agg(F.first(value).alias("value"), F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("first"))


def move_to_front(df: DataFrame, symbol: str, by: str, order: str, size: int = STRETCH) -> DataFrame:
    """Adds ``position``: how many other symbols of the stream came since this one's last use.

    A new symbol stands behind all seen so far. Streams are groups of ``by``, cut into stretches of
    ``size`` places; a stretch starts with the symbols of all before it, latest first.
    """
    cut = df.withColumn("__s", F.floor(F.col(order) / size))
    last = cut.groupBy(F.col(by).alias("__by"), "__s", F.col(symbol).alias("__x")).agg(F.max(order).alias("__at"))
    there = last.select("__by", "__s").distinct().withColumn("__n", F.row_number().over(Window.partitionBy("__by").orderBy("__s")))  # one row a stretch
    last = last.join(there.withColumnsRenamed({"__by": "__b2", "__s": "__s2"}), F.col("__by").eqNullSafe(F.col("__b2")) & (F.col("__s") == F.col("__s2"))).drop("__b2", "__s2", "__s")
    ends = there.groupBy(F.col("__by").alias("__b3")).agg(F.max("__n").alias("__end"))
    used = Window.partitionBy("__by", "__x").orderBy("__n")
    held = last.join(ends, F.col("__by").eqNullSafe(F.col("__b3"))).withColumn("__to", F.least(F.coalesce(F.lead("__n").over(used), F.col("__end")), F.col("__end")))
    held = held.where(F.col("__to") > F.col("__n")).select("__by", F.explode(F.sequence(F.col("__n") + 1, F.col("__to"))).alias("__n"), "__at", "__x")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def encode(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        front = state.sort_values("__at", ascending=False)["__x"].tolist()
        pdf, out = pdf.sort_values(order, kind="stable"), []
        for s in pdf[symbol]:
            at = front.index(s) if s in front else len(front)
            if at < len(front):
                front.pop(at)
            front.insert(0, s)
            out.append(at)
        return pdf.drop(columns=["__n"]).assign(position=out)

    numbered = cut.join(there.withColumnsRenamed({"__by": "__b2", "__s": "__s2"}), F.col(by).eqNullSafe(F.col("__b2")) & (F.col("__s") == F.col("__s2"))).select(*df.columns, "__n")
    return numbered.groupBy(by, "__n").cogroup(held.groupBy("__by", "__n")).applyInPandas(encode, f"{fields}, position long")


def front_widths(df: DataFrame, symbol: str, by: str, order: str) -> DataFrame:
    """Per group: rows, bits of the largest move-to-front position and bytes of all positions packed at that width."""
    return bit_widths(move_to_front(df, symbol, by, order), "position", [by])


def bit_widths(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per group: bits of the largest value and bytes of all values packed at that width."""
    width = N.bits(F.max(value))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("largest"), width.cast("long").alias("bits"), F.ceil(F.count(F.lit(1)) * width / 8).cast("long").alias("packed_bytes"))


def _rank(symbol: object) -> tuple:
    """Order of symbols: null first."""
    return symbol is not None, 0 if symbol is None else symbol


def code_lengths(counts: dict) -> dict:
    """Huffman code length of each symbol; one symbol alone takes one bit. Ties go by symbol, null first."""
    heap = [(n, _rank(s), (s,)) for s, n in counts.items()]
    lengths = dict.fromkeys(counts, 0 if len(counts) > 1 else 1)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, s, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for symbol in x + y:
            lengths[symbol] += 1
        heapq.heappush(heap, (a + b, s, x + y))
    return lengths


def canonical(lengths: dict) -> dict:
    """Code of each symbol as a string of bits: shorter first, then by symbol."""
    codes, code, last = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], _rank(s))):
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = format(code, f"0{last}b")
        code += 1
    return codes


def huffman(df: DataFrame, symbol: str, most: int = 65_536) -> DataFrame:
    """(symbol, n, bits, code): canonical codes. A null is a symbol. The alphabet is a codebook and must be small; a larger one is an error, not cut."""
    counted = df.groupBy(symbol).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(counted) > most:
        raise ValueError(f"over {most} symbols: use dictionary ids")
    counts = {r[symbol]: r["n"] for r in counted}
    codes = canonical(code_lengths(counts))
    rows = [(s, counts[s], len(c), c) for s, c in codes.items()]
    return df.sparkSession.createDataFrame(rows, f"`{symbol}` string, n long, bits int, code string")


def chunk_delta(lines: DataFrame, chunk: str, place: str, line: str, by: list[str]) -> DataFrame:
    """Each place of a chunk against the same place of the chunk before: same, changed, added, removed."""
    now = lines.select(*by, F.col(chunk).alias("c"), F.col(place).alias("p"), F.col(line).alias("now"))
    last = lines.groupBy(*by).agg(F.max(chunk).alias("last"))
    before = lines.join(last, by).where(F.col(chunk) < F.col("last")).select(*by, (F.col(chunk) + 1).alias("c"), F.col(place).alias("p"), F.col(line).alias("before"))
    met = now.join(before, [*by, "c", "p"], "full")
    op = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("before"), "same").otherwise("changed")
    return met.withColumn("op", op)


def hybrid(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds template and mode: ``template`` where at least two lines share the template, else ``line``."""
    with_template = lines.withColumn("template", T.number_template(F.col(line)))
    shared = with_template.groupBy("template").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("template", F.lit("template").alias("mode"))
    return with_template.join(shared, "template", "left").withColumn("mode", F.coalesce("mode", F.lit("line")))


def smallest(sizes: DataFrame, by: list[str], method: str = "method", size: str = "size") -> DataFrame:
    """The smallest alternative of each group; names break ties."""
    best = F.min(F.struct(size, method))
    return sizes.groupBy(*by).agg(best.alias("b")).select(*by, f"b.{method}", f"b.{size}")


def json_keys(lines: DataFrame, payload: str, k: int) -> DataFrame:
    """The k most frequent JSON keys: by count, then key."""
    key = F.explode(F.regexp_extract_all(F.col(payload), F.lit(r'"([^"\\]+)"\s*:'), F.lit(1)))
    return lines.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(k)


def substitute(payload: Column, tokens: list[str]) -> Column:
    """Each of the tokens in quotes, longest first, as ``\\x01t`` and its number; inverse: ``unsubstitute``.

    A ``\\x01`` of the text itself is written ``\\x01e``, so that the letter behind one always tells what it is.
    """
    out = F.replace(payload, F.lit("\x01"), F.lit("\x01e"))
    for i, t in sorted(enumerate(tokens), key=lambda it: (-len(it[1]), it[1])):
        out = F.replace(out, F.lit(_quoted(t)), F.lit(f"\x01t{i};"))
    return out


def unsubstitute(packed: Column, tokens: list[str]) -> Column:
    out = packed
    for i, t in enumerate(tokens):
        out = F.replace(out, F.lit(f"\x01t{i};"), F.lit(_quoted(t)))
    return F.replace(out, F.lit("\x01e"), F.lit("\x01"))


def _quoted(token: str) -> str:
    return '"' + token.replace("\x01", "\x01e") + '"'


def typed_channels(found: DataFrame, types: DataFrame, bank_channels: int) -> DataFrame:
    """Values in the form of their channel's type: ``number`` (int, ip), ``raw`` (hex) or ``text``.

    A value that its short form would not give back exactly stays text. ``types`` is what ``channel_types``
    found; it has one row a channel, at most ``bank_channels`` (the bank's), and is broadcast.
    """
    kinds = types.select(F.col("event_id").alias("__e"), F.col("channel").alias("__c"), F.col("kind"))
    if kinds.limit(bank_channels + 1).count() > bank_channels:
        raise ValueError("more channels than the bank has")
    met = found.join(F.broadcast(kinds), (F.col("event_id") == F.col("__e")) & (F.col("channel") == F.col("__c")), "left").drop("__e", "__c")
    v, part = F.col("value"), lambda i: F.get(F.split("value", r"\."), F.lit(i)).try_cast("long")
    number = F.when(F.col("kind") == "int", F.expr("try_cast(value AS bigint)")).when((F.col("kind") == "ip") & v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * 256 + part(3))
    raw = F.when((F.col("kind") == "hex") & v.rlike("^([0-9a-f]{2})+$"), F.unhex("value"))
    met = met.withColumn("number", number).withColumn("raw", raw)
    exact = untyped(met) == v
    met = met.withColumn("number", F.when(exact, F.col("number"))).withColumn("raw", F.when(exact, F.col("raw")))
    return met.withColumn("text", F.when(F.col("number").isNull() & F.col("raw").isNull(), v)).drop("value")


def untyped(typed: DataFrame) -> Column:
    """The values again."""
    n = F.col("number")
    octets = [F.pmod(F.floor(n / (1 << s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
    text = F.when(F.col("kind") == "ip", F.concat_ws(".", *octets)).otherwise(n.cast("string"))
    short = F.coalesce(F.when(n.isNotNull(), text), F.lower(F.hex("raw")))
    return F.coalesce(short, F.col("text")) if "text" in typed.columns else short


def slot_choice(values: DataFrame, value: str, slot: list[str], order: list[str]) -> DataFrame:
    """Per slot the shorter of values and deltas over all of its rows, by bytes of the variable-length form."""
    sizes = adaptive(values, value, slot, order).groupBy(*slot).agg(F.count(F.lit(1)).alias("n"), F.sum("abs_bytes").alias("abs_bytes"), F.sum("delta_bytes").alias("delta_bytes"))
    return sizes.withColumn("choice", F.when(F.col("delta_bytes") < F.col("abs_bytes"), "delta").otherwise("abs"))
