"""Connected components of a graph of any size, without gathering it anywhere.

Alternating large-star and small-star rounds (Kiveris et al., 2014) turn the edges into stars around each component's
smallest node. Before them, each task replaces the edges that it happens to hold by the stars that they make. A round
is a pre-aggregated minimum and a join, each result a table in the shared folder; the centres of large stars are
broadcast, so their edges stay where they are. Edges of a bounded number are finished by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import cut, discard

EDGES = "a long, b long"


class Union:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top:
            up[x] = top
            x = p
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.up.setdefault(min(x, y), min(x, y))
        return True


def _stars(batches: Iterator[pd.DataFrame], most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """The stars of the edges of one task, a bounded number of nodes at a time."""
    union = Union()

    def out() -> pd.DataFrame:
        nodes = list(union.up)
        roots = np.array([union.root(x) for x in nodes], dtype=np.int64)
        nodes = np.array(nodes, dtype=np.int64)
        return pd.DataFrame({"a": roots[nodes != roots], "b": nodes[nodes != roots]})

    for batch in batches:
        for x, y in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            union.join(x, y)
        if len(union.up) > most:
            yield out()
            union = Union()
    yield out()


def _with_least(edges: DataFrame, least: DataFrame, key: str, bound: int) -> DataFrame:
    """edges with the least neighbour m of their key. least: key, m, n (neighbours).

    Keys with more neighbours than the bound are few (at most twice the edges by the bound) and are broadcast, so no star's edges meet in one task."""
    hot = F.broadcast(least.filter(F.col("n") > bound).select(key, "m"))
    cold = least.filter(F.col("n") <= bound).select(key, "m")
    return edges.join(hot, key).select("a", "b", "m").union(edges.join(hot, key, "left_anti").join(cold, key).select("a", "b", "m"))


def _large(edges: DataFrame, bound: int) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    moved = _with_least(edges, least, "a", bound).select(F.col("m").alias("a"), "b")
    return moved.filter("a <> b").distinct()


def _small(edges: DataFrame, bound: int) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them. edges: a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, "b", bound).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.filter("a <> b").union(least.select(F.col("m").alias("a"), "b")).distinct()


#: A star is hot from this many edges on, and from this share of all edges; at most twice the share's inverse are broadcast.
HOT, HOT_SHARE = 500, 1 / 1000
#: So many edges or fewer make their stars in one task: a round deals all of them out a dozen times, whatever their number.
TOGETHER = 500_000


def components(edges: DataFrame, together: int = TOGETHER) -> DataFrame:
    """node and root for every node of an edge (a, b); root is the smallest node that it reaches."""
    now = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).mapInPandas(_stars, EDGES).distinct())
    while True:
        before, n = now, now.count()
        if n <= together:
            now = cut(now.coalesce(1).mapInPandas(lambda batches: _stars(batches, 2 * together), EDGES))
            discard(before)
            break
        # stars: no node is both a root and a member, and no member has two roots
        if n == now.agg(F.count_distinct("b")).first()[0] and not now.join(now.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            break
        bound = max(HOT, int(n * HOT_SHARE))
        large = cut(_large(now, bound))
        now = cut(_small(large, bound))
        discard(before, large)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root")))
