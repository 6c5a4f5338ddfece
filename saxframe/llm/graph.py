"""Connected components of a graph too large for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saxframe.llm.common import release, stage


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for each node of the edges (a, b): component is the smallest node that can be reached.

    Alternating large-star and small-star steps: each hangs the neighbours of a node below the
    smallest of them, in joins and minima that combine before the shuffle. No task holds a node's
    neighbours, and each round is a table in the shared folder. A graph without edges has no rows.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = _print(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("low"))
        large = both.join(low, both.a == low.u).where("b > u").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("low"))
        small = large.join(low, large.a == low.u).select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        then = stage(small.where("a <> b").distinct(), name)
        last, seen = seen, _print(then)
        release(now)
        now = then
        if seen == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _print(edges: DataFrame) -> tuple:
    """Count and an order-free sum of hashes: equal for equal sets of edges."""
    n, low, high = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
    return n, low, high


class Forest:
    """Union-find over numpy arrays: pairs are joined many at a time, the smaller number is the root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while len(r) and (r != (up := self.parent[r])).any():
            r = up
        return r

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.roots(i) != self.roots(j)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = self.roots(i), self.roots(j)
            low, high = np.minimum(ri, rj), np.maximum(ri, rj)
            far = low != high
            low, high = low[far], high[far]
            np.minimum.at(self.parent, high, low)
            i, j = high, low

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) for each node that is not its own root."""
        self.parent = self.roots(np.arange(len(self.parent)))
        i = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return i, self.parent[i]
