"""Memory packets: skeleton, witnesses, checksum, confidence and tiers as expressions over a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CONFIDENCE = {3: 0.95, 0: 0.70}
OTHER_CONFIDENCE = 0.50


def _solid(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")


def _first(lines: Column, start: str) -> Column:
    return F.get(F.filter(lines, lambda x: F.startswith(x, F.lit(start))), F.lit(0))


def skeleton(text: Column) -> tuple[Column, Column]:
    """Header and goal: the marked lines, else the first two lines with content."""
    lines = _solid(text)
    header = F.coalesce(_first(lines, "Project:"), F.get(lines, F.lit(0)), F.lit("Chunk:"))
    goal = F.coalesce(_first(lines, "Goal:"), F.get(lines, F.lit(1)), F.get(lines, F.lit(0)), F.lit("Chunk:"))
    return header, goal


def witnesses(text: Column) -> Column:
    """Trimmed lines that state a decision or a note."""
    return F.filter(F.transform(F.split(text, "\n", -1), F.trim), lambda x: F.startswith(x, F.lit("Decision:")) | F.startswith(x, F.lit("Note:")))


def packets(df: DataFrame, text: str = "text", tier: int = 3) -> DataFrame:
    """Adds header, goal, witness, residual, checksum, fingerprint, probe and confidence.

    Tier 3 keeps the whole text, so restoring does not depend on where header and goal stood.
    """
    header, goal = skeleton(F.col(text))
    out = df.withColumn("header", header).withColumn("goal", goal).withColumn("witness", F.array_join(witnesses(F.col(text)), "\n"))
    spine = F.array_join(F.array_compact(F.array("header", "goal", F.when(F.col("witness") != "", F.col("witness")))), "\n")
    lead = F.concat("header", F.lit("\n"), "goal", F.lit("\n"))
    rest = F.when(F.startswith(F.col(text), lead), F.substr(F.col(text), F.length(lead) + 1)).otherwise(F.col(text))
    out = out.withColumn("residual", rest if tier == 3 else F.lit("")).withColumn("checksum", T.checksum(spine, 10)).withColumn("fingerprint", T.checksum(spine, 12))
    probe = (F.trim("header") != "") & (F.trim("goal") != "")
    return out.withColumn("probe", probe).withColumn("confidence", F.when(probe, F.lit(CONFIDENCE.get(tier, OTHER_CONFIDENCE))).otherwise(0.0))


def restore(df: DataFrame) -> Column:
    """The text out of residual and spine."""
    lead = F.concat("header", F.lit("\n"), "goal", F.lit("\n"))
    return F.when(F.col("led"), F.concat(lead, "residual")).otherwise(F.col("residual"))


def needed(text: Column) -> Column:
    """Least confidence asked for: more where a decision or note stands."""
    return F.when(F.contains(text, F.lit("Decision:")) | F.contains(text, F.lit("Note:")), 0.80).otherwise(0.60)


def tier_for(text: Column, probe: Column) -> Column:
    """The smallest tier whose confidence suffices, else 3."""
    cheap = F.when(probe, F.lit(CONFIDENCE[0])).otherwise(0.0)
    return F.when(cheap >= needed(text), 0).otherwise(3)


def paragraphs(lines: DataFrame, by: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """Adds chunk_id: lines between blank ones share a chunk, blank lines end it and stay with it."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    blank = F.trim(line) == ""
    starts = (~blank & F.coalesce(F.lag(F.trim(line) == "").over(w), F.lit(False))).cast("int")
    return lines.withColumn("chunk_id", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
