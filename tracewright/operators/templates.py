"""Template banks: compile on the driver, match, render and search as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

WILDCARD = re.compile(r"<\*>|\[\*\]")
#: literal dates in a template stand for any date
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?")
#: banks above this size are matched in Arrow batches by compiled expressions
CHAIN = 128
CANDIDATES = 32


@dataclass(frozen=True)
class Template:
    event_id: int
    text: str
    literals: tuple[str, ...]  # one more than there are parameters

    @property
    def n_params(self) -> int:
        return len(self.literals) - 1

    @property
    def anchor(self) -> str:
        return max((x.strip() for x in self.literals), key=len, default="")

    def pattern(self, quote=lambda s: r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E", end: str = r"\z") -> str:
        """An anchored expression with one lazy group per parameter; ``end`` is the dialect's very end of the text."""
        return "^" + "(.*?)".join(quote(x) if x else "" for x in self.literals) + end


def event_id(raw: str) -> int | None:
    """``12``, ``E12`` or ``0xff`` as a number."""
    raw = raw.strip()
    if m := re.fullmatch(r"[Ee]?(\d+)|([+-]\d+)", raw):
        return int(m[1] or m[2])
    return int(raw, 16) if re.fullmatch(r"0[xX][0-9a-fA-F]+", raw) else None


def compile_bank(rows: list[tuple[str, str]]) -> list[Template]:
    """Templates in the order in which they win: fewest wildcards, longest anchor, as listed."""
    bank = []
    for raw, text in rows:
        number = event_id(raw)
        if number is not None and text.strip():
            text = _DATE.sub("<*>", text.strip())
            bank.append(Template(number, text, tuple(WILDCARD.split(text))))
    return sorted(bank, key=lambda t: (t.n_params, -len(t.anchor)))


def match(lines: DataFrame, bank: list[Template], line: str = "line") -> DataFrame:
    """Adds event_id, params and tpl of the first template that fits, nulls where none does.

    ``tpl`` is the template's place in the bank: an event id may stand for several templates.
    """
    if len(bank) > CHAIN:
        return _match_batches(lines, bank, line)
    out = F.lit(None).cast("struct<event_id:bigint,params:array<string>,tpl:int>")
    text = F.col(line)
    for i, t in reversed(list(enumerate(bank))):
        p = "(?s)" + t.pattern()
        params = [F.regexp_extract(text, p, k + 1) for k in range(t.n_params)]
        hit = F.struct(F.lit(t.event_id).cast("long").alias("event_id"), (F.array(*params) if params else F.array().cast("array<string>")).alias("params"), F.lit(i).alias("tpl"))
        out = F.when(F.contains(text, F.lit(t.anchor)) & text.rlike(p), hit).otherwise(out)
    return lines.withColumn("m", out).select("*", "m.event_id", "m.params", "m.tpl").drop("m")


def _match_batches(lines: DataFrame, bank: list[Template], line: str) -> DataFrame:
    """The same by compiled expressions, for banks too large for one expression chain.

    One automaton finds the templates whose longest literal stands in a line; only their expressions are tried.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(t.event_id, re.compile(t.pattern(re.escape, r"\Z"), re.S)) for t in bank]
        near = _anchored(bank)

        def first(s: str | None) -> tuple[int | None, list[str] | None, int | None]:
            for i in near(s) if s is not None else ():
                if m := compiled[i][1].match(s):
                    return compiled[i][0], list(m.groups()), i
            return None, None, None

        for b in batches:
            found = [first(s) for s in b[line]]
            yield b.assign(event_id=pd.array([e for e, _, _ in found], dtype="Int64"), params=[p for _, p, _ in found], tpl=pd.array([i for *_, i in found], dtype="Int32"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
    return lines.mapInPandas(run, f"{fields}, event_id bigint, params array<string>, tpl int")


def _anchored(bank: list[Template]) -> Callable[[str], list[int]]:
    """Places of the templates whose anchor a text holds, in order."""
    import ahocorasick

    always, by_anchor = [], {}
    for i, t in enumerate(bank):
        by_anchor.setdefault(t.anchor, []).append(i) if t.anchor else always.append(i)
    words = ahocorasick.Automaton()
    for anchor, places in by_anchor.items():
        words.add_word(anchor, places)
    if not by_anchor:
        return lambda text: always
    words.make_automaton()
    return lambda text: sorted({*always, *(i for _, places in words.iter(text) for i in places)})


def bank_table(spark: SparkSession, bank: list[Template]) -> DataFrame:
    rows = [(t.event_id, t.text, t.n_params, t.anchor, i, list(t.literals)) for i, t in enumerate(bank)]
    return spark.createDataFrame(rows, "event_id long, template string, n_params int, anchor string, prio int, literals array<string>")


def render(matched: DataFrame, bank: list[Template]) -> DataFrame:
    """Adds ``rendered``: literals and parameters in turn; unmatched lines are null. Wants ``tpl``, or event ids that occur once."""
    by = "tpl" if "tpl" in matched.columns else "event_id"
    if by == "event_id" and len({t.event_id for t in bank}) < len(bank):
        raise ValueError("an event id stands for several templates: match gives tpl to tell them apart")
    literals = F.broadcast(bank_table(matched.sparkSession, bank).withColumnRenamed("prio", "tpl").select(by, "literals"))  # a bank is a file of the driver's
    filled = F.array_join(F.zip_with("literals", F.concat("params", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return matched.join(literals, by, "left").withColumn("rendered", F.when(F.col(by).isNotNull(), filled)).drop("literals")


def candidates(bank: list[Template], query: str, most: int = CANDIDATES) -> list[int]:
    """Ids of templates with any of the query's terms: most terms first, then highest id."""
    terms = re.findall(T.TOKEN_A, query.lower())
    scored = [(sum(x in t.text.lower() for x in terms), t.event_id) for t in bank]
    return [e for n, e in sorted(scored, reverse=True) if n][:most]


def recall(matched: DataFrame, number: int) -> DataFrame:
    """Lines of one event."""
    return matched.where(F.col("event_id") == number)


def fast_search(matched: DataFrame, bank: list[Template], query: str, line: str = "line") -> DataFrame:
    """Lines of known events that hold all terms of the query; filtering precedes any limit.

    A term may stand in a parameter, so no template can be left out; ``candidates`` only ranks them.
    """
    return matched.where(F.col("event_id").isNotNull() & all_terms(F.col(line), query))


def all_terms(line: Column, query: str) -> Column:
    out = F.lit(True)
    for t in dict.fromkeys(re.findall(T.TOKEN_A, query.lower())):
        out = out & F.contains(F.lower(line), F.lit(t))
    return out


def route(matched: DataFrame, bank: list[Template], query: str, line: str = "line") -> DataFrame:
    """One complete plan: all lines, known or not, that hold all terms; ``fast`` tells those of candidate templates."""
    found = candidates(bank, query)
    hit = F.coalesce(F.col("event_id").isin(found), F.lit(False)) if found else F.lit(False)
    return matched.where(all_terms(F.col(line), query)).withColumn("fast", hit)


def coverage(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count(F.lit(1)).alias("n_lines"), F.count("event_id").alias("n_known"), F.count_if(F.col("event_id").isNull()).alias("n_unknown"))
