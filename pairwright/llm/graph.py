"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.tables import cut, drop, unsent

#: Each round shortens every path to the smallest node by half or so; this many would need 2**100 nodes.
MOST_ROUNDS = 200


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `edges`: the smallest node that can be reached from it.

    A large star ties the larger neighbours of a node to its smallest one, a small star does so with the
    smaller ones, until nothing changes. Minima are aggregated before the shuffle and written before they
    are joined, so that the join of a node with very many edges can be split between tasks. Nulls and
    loops are no edges; the nodes may have any type with an order.
    """
    x, y = F.col(a), F.col(b)
    ok = x.isNotNull() & y.isNotNull()
    now = cut(edges.where(ok & (x != y)).select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u")).distinct())
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            break
        large = _star(now.union(now.select(F.col("u"), F.col("v"))), large=True)
        new = _star(large, large=False)
        drop(now, large)
        now = new
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether every node is tied to one smaller node, or only to larger ones."""
    ends = edges.select(F.col("v").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select(F.col("u"), F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where("down > 1 or (down = 1 and up = 1)").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (v, u): for each v the smallest m of v and its u; then (u, m) for all u > v, or all u <= v and v itself."""
    lows = unsent(cut(edges.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), F.least("v", "m").alias("m"))))
    tied = edges.join(lows, F.col("v") == F.col("k"))
    if large:
        out = tied.where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
    else:
        out = tied.where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        out = out.union(lows.select(F.col("k").alias("v"), F.col("m").alias("u")))
    kept = cut(out.where(F.col("v") != F.col("u")).distinct())
    drop(lows)
    return kept
