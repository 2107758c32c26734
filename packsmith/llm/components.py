"""Connected components of a graph too large for one machine: alternating large and small stars.

Edges are pairs of long node ids. Every round maps each edge to the smallest neighbour, first among all neighbours (large star),
then among the smaller ones (small star), until only stars are left; the number of rounds grows with the logarithm of the size of
the largest component. Each round's edges are written to the shared folder, which also survives lost executors. The edges of a node are
dealt by node and salt, so that one with very many of them is spread: its minimum is taken of its salts' minima and returned to them.

Edge cases: an empty table has no components; repeated edges, loops and both directions of an edge change nothing; a null in an
edge matches nothing, so such an edge is ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsmith.session import stored

#: Parts into which the edges of one node are dealt.
SALTS = 16


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (a, b) as stars around each component's smallest node: (node, smallest), without the smallest itself."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = both.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    salted = both.groupBy("a", "s").agg(F.min("b").alias("m"))
    least = salted.groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    placed = salted.select("a", "s").join(least, F.col("a") == F.col("c")).select("c", F.col("s").alias("t"), "m")
    joined = both.join(placed, (F.col("a") == F.col("c")) & (F.col("s") == F.col("t")))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (a, b), b below a, are stars already: every a has one edge and is no b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return not ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").limit(1).count()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, root) for every node that is not its component's smallest; root is that smallest node."""
    for _ in range(max_rounds):
        edges = stored(_star(_star(edges, large=True), large=False), "star")
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
