"""Connected components of an edge table by alternating star contractions.

Edges (a, b) of longs, a > b. A round first links every vertex's larger neighbours to
the smallest of its neighbourhood, then its smaller ones; each vertex ends up linked
to its component's minimum after a number of rounds logarithmic in the longest chain.
Each round is two aggregations and two joins on the vertex. The minima are written and
read again, so that a join sees their size: small ones are broadcast, and else the edges
of a vertex that very many share are split by adaptive execution's skew join, which
works on tables and not on aggregations. Nothing is collected per vertex.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """edges (a, b), a > b. Large star: v > u goes to min(N(u), u), which is u or smaller. Small star: v <= u goes to min N(u)."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        out = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = scratch.table(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"))
        out = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = scratch.table(out.where("a > b").distinct())
    scratch.drop(low, edges)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge (x, y) of longs; root is the smallest node reachable."""
    kept = scratch.table(edges.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    mark = None
    while True:
        done = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if done[0] == 0 or done == mark:
            break
        mark = done
        kept = _star(_star(kept, True, scratch), False, scratch)
    out = kept.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, over the edges (x, y)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        nxt = root.copy()
        np.minimum.at(nxt, x, low)
        np.minimum.at(nxt, y, low)
        np.minimum.at(nxt, root[x], low)
        np.minimum.at(nxt, root[y], low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            return root
        root = nxt
