"""Template mining by a fixed-depth parse tree (He, Zhu, Zheng and Lyu, ICWS 2017).

The tree's first layer is the number of tokens, so groups of equal length are
mined apart and at the same time; a group is cut into stretches of the order, in
which lines pass in turn. A stretch's templates are then held against those of the
stretches before it, which they may widen or join. Templates change while lines
arrive; the final ones are reported, and parameters come from a second pass over
the lines. A null line has no template.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SIMILARITY, DEPTH, CHILDREN = 0.4, 4, 100
#: places of the order that one task mines
STRETCH = 50_000
ANY = "<*>"


class Miner:
    """Clusters token lists of one length."""

    def __init__(self, similarity: float = SIMILARITY, depth: int = DEPTH, children: int = CHILDREN):
        self.similarity, self.layers, self.children = similarity, max(0, depth - 3), children
        self.tree: dict = {}
        self.clusters: list[list[str]] = []
        self.sizes: list[int] = []

    def _leaf(self, tokens: list[str]) -> list[int]:
        node = self.tree
        for t in tokens[: self.layers]:
            key = ANY if any(c.isdigit() for c in t) else t
            if key not in node:
                key = ANY if ANY in node and len(node) >= self.children or len(node) + (ANY not in node) >= self.children else key
            node = node.setdefault(key, {})
        return node.setdefault(None, [])

    def add(self, tokens: list[str], n: int = 1, among: int | None = None) -> int:
        """The cluster of a line (or of ``n`` lines), which may widen its template; of the first ``among`` clusters, if given."""
        leaf = self._leaf(tokens)
        best, score = None, (-1.0, -1)
        for c in leaf if among is None else [c for c in leaf if c < among]:
            t = self.clusters[c]
            fixed = sum(a == b for a, b in zip(t, tokens, strict=True) if a != ANY)
            now = (fixed / max(1, len(tokens)), t.count(ANY))
            if now > score:
                best, score = c, now
        if best is None or score[0] < self.similarity:
            leaf.append(len(self.clusters))
            self.clusters.append(list(tokens))
            self.sizes.append(n)
            return leaf[-1]
        self.clusters[best] = [a if a == b else ANY for a, b in zip(self.clusters[best], tokens, strict=True)]
        self.sizes[best] += n
        return best


def mine(lines: DataFrame, order: list[str], line: str = "line", stretch: int = STRETCH) -> DataFrame:
    """(template, n_lines, first): final templates; ``first`` is the place of the first line, as a list.

    The first column of ``order`` must be an integer. Templates that stretches agree on are counted together
    before they meet; what meets in one task is the distinct templates of one length, not lines.
    """
    tokens = F.filter(F.split(line, " +"), lambda x: x != "")
    work = lines.where(F.col(line).isNotNull()).select(F.array(*[F.col(c).cast("long") for c in order]).alias("at"), tokens.alias("tokens"))
    work = work.withColumn("n", F.size("tokens")).withColumn("stretch", F.floor(F.get("at", F.lit(0)) / stretch))

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        miner, first = Miner(), {}
        for at, words in sorted((tuple(a), list(t)) for a, t in zip(pdf["at"], pdf["tokens"], strict=True)):
            first.setdefault(miner.add(words), at)
        return pd.DataFrame({"n": key[0], "stretch": key[1], "tokens": miner.clusters, "n_lines": miner.sizes, "first": [list(first[i]) for i in range(len(miner.clusters))]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        miner, first, last, before = Miner(), {}, None, 0
        rows = sorted((int(s), tuple(a), list(t), int(n)) for s, a, t, n in zip(pdf["stretch"], pdf["first"], pdf["tokens"], pdf["n_lines"], strict=True))
        for s, at, words, n in rows:
            if s != last:
                last, before = s, len(miner.clusters)
            c = miner.add(words, n, before)
            first[c] = min(first.get(c, at), at)
        return pd.DataFrame({"template": [" ".join(c) for c in miner.clusters], "n_lines": miner.sizes, "first": [list(first[i]) for i in range(len(miner.clusters))]})

    each = work.groupBy("n", "stretch").applyInPandas(group, "n int, stretch long, tokens array<string>, n_lines long, first array<long>")
    distinct = each.groupBy("n", "tokens").agg(F.min("stretch").alias("stretch"), F.sum("n_lines").alias("n_lines"), F.min("first").alias("first"))
    merged = distinct.groupBy("n").applyInPandas(merge, "template string, n_lines long, first array<long>")
    return merged.groupBy("template").agg(F.sum("n_lines").alias("n_lines"), F.min("first").alias("first"))


@F.pandas_udf(ArrayType(StringType()))
def extracted(message: pd.Series, template: pd.Series) -> pd.Series:
    """``parameters`` of each row."""
    return pd.Series([None if m is None or t is None else parameters(m, t) for m, t in zip(message, template, strict=True)])


def parameters(message: str, template: str) -> list[str]:
    """What stands for each wildcard, found by the literals in turn; none if a literal is missing."""
    head, *rest = template.split(ANY)
    if not message.startswith(head):
        return []
    at, out = len(head), []
    for i, literal in enumerate(rest):
        last = i == len(rest) - 1
        to = len(message) if not literal and last else (len(message) - len(literal) if last and message.endswith(literal) else message.find(literal, at))
        if to < at:
            return []
        out.append(message[at:to])
        at = to + len(literal)
    return out
