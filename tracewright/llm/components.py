"""Connected components of a distributed graph: local contraction, then large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle

#: links that one task contracts at a time (16 bytes each)
PART = 500_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links, and the least node that it is connected to."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (step := new[new]).tolist() != new.tolist():
            new = step
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        a, b = contract(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """One star step: every neighbour above (large) or not above (small) a node is linked to the least of them."""
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    least = ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    met = ways.join(least, ways["a"] == least["u"])
    if both:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, n_links: int, part: int = PART, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link (a, b); the component is its least node.

    Links are read in parts of about ``part``; a part is contracted by union-find
    in its task. A single part is then done. Else stars join the parts: a step
    is a grouped minimum and a join, whose skew Spark can split, and each round
    is written to the shared folder. Rounds grow with the logarithm of the
    longest chain.
    """
    parts = max(1, -(-n_links // part))
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(parts).mapInArrow(_contracted, "a long, b long"))
    state = None
    for _ in range(rounds if parts > 1 else 0):
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if tuple(row) == state:
            break
        state = tuple(row)
        edges = settle(_stars(_stars(edges, True), False).coalesce(max(1, -(-row["n"] // part))))
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")) if parts > 1 else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
