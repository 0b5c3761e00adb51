"""Packets, blocks and what they hold: exact indexes as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import settled
from . import trace

PACKET = 60
GROUP = 8
#: units that a search may name one by one (8 bytes each); beyond, units are joined
NAMED = 10_000


def packets(lines: DataFrame, size: int = PACKET, group: int = GROUP, order: str = "line_no") -> DataFrame:
    """Adds packet_id and block_id: ``size`` rows a packet, ``group`` packets a block."""
    packet = F.floor(F.col(order) / size).cast("long")
    return lines.withColumn("packet_id", packet).withColumn("block_id", F.floor(packet / group).cast("long"))


def token_index(lines: DataFrame, unit: list[str] | None = None, line: str = "line", holding: list[str] | None = None) -> DataFrame:
    """Distinct (unit, token); of all tokens, or of those that hold one of the texts ``holding``."""
    found = lines.select(*(unit or ["packet_id"]), F.explode(T.tokens_a(F.col(line))).alias("token"))
    if holding is not None:
        found = found.where(F.col("token").rlike("|".join(r"\Q" + t.lower() + r"\E" for t in holding)))
    return found.distinct()


def token_df(index: DataFrame) -> DataFrame:
    """Document frequency: units that hold a token."""
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def keyword_index(lines: DataFrame, unit: str = "packet_id", line: str = "line") -> DataFrame:
    """Distinct (unit, entry) with words, stems and marked prefixes."""
    return lines.select(unit, F.explode(F.array_distinct(T.tokens_b(F.col(line)))).alias("w")).select(unit, F.explode(T.variants(F.col("w"))).alias("entry")).distinct()


def keyword_units(index: DataFrame, words: list[str], mode: str = "and", unit: str = "packet_id") -> DataFrame:
    """Units that hold, for all (or any) words, one of the word's entries."""
    groups = [_entries(w) for w in words]
    found = F.array(*[F.when(F.col("entry").isin(g), F.lit(i)) for i, g in enumerate(groups)])
    hit = index.where(F.col("entry").isin(sorted({e for g in groups for e in g}))).select(unit, F.explode(F.array_compact(found)).alias("g"))
    n = hit.groupBy(unit).agg(F.count_distinct("g").alias("n"))
    return n.where(F.col("n") >= (len(groups) if mode == "and" else 1)).select(unit)


def _entries(word: str) -> list[str]:
    w, s = word.strip().lower(), T.stem_word(word.strip())
    return sorted({w, s} | {f"pref:{x[: T.PREFIX]}" for x in (w, s) if len(x) >= T.PREFIX})


def tool_index(lines: DataFrame, line: str = "line") -> DataFrame:
    """Per tool: lines, packets, first packet."""
    tool = F.coalesce(trace.loose_tool(F.col(line)), F.lit("UNKNOWN"))
    return lines.select(tool.alias("tool"), "packet_id").groupBy("tool").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("packet_id").alias("n_packets"), F.min("packet_id").alias("first_packet"))


def event_sets(matched: DataFrame) -> DataFrame:
    """Distinct (packet_id, event_id) with the number of rows: the exact id set of each packet."""
    return matched.where(F.col("event_id").isNotNull()).groupBy("packet_id", "event_id").agg(F.count(F.lit(1)).alias("n"))


def packet_range(lines: DataFrame, start: int, stop: int) -> DataFrame:
    """Packets [start, stop); a negative start counts as 0, an empty range gives nothing."""
    return lines.where((F.col("packet_id") >= max(0, start)) & (F.col("packet_id") < stop))


def selected(lines: DataFrame, ids: list[int], unit: str = "packet_id") -> DataFrame:
    return lines.where(F.col(unit).isin([int(i) for i in ids])) if ids else lines.limit(0)


def two_level(lines: DataFrame, terms: list[str], mode: str = "and", line: str = "line") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, blocks, packets): blocks are pruned first, then packets inside them, then lines are tested.

    For a single search over lines without an index; ``Context`` keeps the index for many.
    """
    from . import search

    sound = [t for t in terms if search.prunable(t)]
    index = token_index(lines, ["block_id", "packet_id"], line, sound or None)
    blocks = search.pruned_units(index.select("block_id", "token").distinct(), terms, mode, ["block_id"])
    if blocks is None:
        every = lines.select("block_id", "packet_id").distinct()
        return search.keywords(lines, terms, mode, line), every.select("block_id").distinct(), every.select("packet_id")
    inside = search.pruned_units(index.join(blocks, "block_id", "left_semi"), terms, mode, ["packet_id"])
    return search.keywords(lines.join(inside, "packet_id", "left_semi"), terms, mode, line), blocks, inside


def within(lines: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """The lines of some units: named one by one if they are few (counted), which prunes files too, else joined."""
    named = [r[0] for r in units.select(unit).limit(NAMED + 1).collect()]
    return lines.where(F.col(unit).isin(named)) if len(named) <= NAMED else lines.join(units, unit, "left_semi")


@dataclass(frozen=True)
class Context:
    """Lines in order of their packets and an index of their tokens at two resolutions, written once and searched often."""

    lines: DataFrame
    tokens: DataFrame  # distinct (block_id, packet_id, token), by token
    blocks: DataFrame  # distinct (block_id, token), by token
    line: str = "line"

    @classmethod
    def of(cls, lines: DataFrame, line: str = "line") -> Context:
        stored = settled(lines.repartitionByRange("packet_id").sortWithinPartitions("packet_id"))
        tokens = settled(token_index(stored, ["block_id", "packet_id"], line).repartitionByRange("token").sortWithinPartitions("token", "packet_id"))
        blocks = tokens.select("block_id", "token").distinct().repartitionByRange("token").sortWithinPartitions("token", "block_id")
        return cls(stored, tokens, settled(blocks), line)

    def _found(self, units: DataFrame | None, unit: str, terms: list[str], mode: str) -> DataFrame:
        from . import search

        return search.keywords(self.lines if units is None else within(self.lines, units, unit), terms, mode, self.line)

    def hits(self, terms: list[str], mode: str = "and") -> DataFrame:
        """Lines that match, of the packets that the index leaves."""
        from . import search

        return self._found(search.pruned_units(self.tokens, terms, mode, ["packet_id"]), "packet_id", terms, mode)

    def block_hits(self, terms: list[str], mode: str = "and") -> DataFrame:
        """Lines that match, of whole blocks that the block index leaves."""
        from . import search

        return self._found(search.pruned_units(self.blocks, terms, mode, ["block_id"]), "block_id", terms, mode)

    def two_level(self, terms: list[str], mode: str = "and", packet_mode: str | None = None) -> DataFrame:
        """Blocks are pruned by the block index, then packets inside them, then lines are tested.

        With ``packet_mode`` packets are pruned by another rule than blocks: blocks that hold all terms and in
        them packets that hold any, say. The rule must be no stricter than ``mode``: hits are those of ``mode``.
        """
        from . import search

        if mode == "or" and packet_mode == "and":
            raise ValueError("packets would be pruned more strictly than lines are tested")
        blocks = search.pruned_units(self.blocks, terms, mode, ["block_id"])
        if blocks is None:
            return self.hits(terms, mode)
        packets = search.pruned_units(within(self.tokens, blocks, "block_id"), terms, packet_mode or mode, ["packet_id"])
        return self._found(blocks, "block_id", terms, mode) if packets is None else self._found(packets, "packet_id", terms, mode)

    def units_with(self, token: str, unit: str = "packet_id") -> DataFrame:
        """Units that hold a whole token: an equality, which file statistics and their order prune."""
        return (self.blocks if unit == "block_id" else self.tokens).where(F.col("token") == token.lower()).select(unit).distinct()
