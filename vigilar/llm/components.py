"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


HOT_SHARE = 200  # a node is hot from 1 / HOT_SHARE of all edges on, so there are at most twice as many hot nodes


def _beside_least(both: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``both`` (v, u) with the least node around v. The edges of hot nodes, whose number is bounded, stay where they are and meet
    these in a broadcast join; so no task of the other join gets all edges of a hot node."""
    hot = F.broadcast(least.filter(F.col("c") > max(1000, n_edges // HOT_SHARE)).select("v", "m"))
    tagged = both.join(hot, "v", "left")
    cold = tagged.filter("m IS NULL").select("v", "u").join(least.select("v", "m"), "v")
    return tagged.filter("m IS NOT NULL").select("v", "u", "m").union(cold.select("v", "u", "m"))


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """One step on undirected edges (a > b). Large: links every greater neighbour of a node to the least node around it, an edge
    as often as it comes about. Small: links a node and its smaller neighbours to the least of them, once each."""
    if large:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    else:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    least = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("c"))
    linked = _beside_least(both, least, n_edges)
    if large:
        return linked.filter(F.col("u") > F.col("v")).select(F.col("u").alias("a"), F.col("m").alias("b"))
    out = linked.select(F.col("u").alias("a"), F.col("m").alias("b")).union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def _open(edges: DataFrame) -> tuple[int, bool]:
    """(number of edges, whether some are not yet one edge from a node to the least of its component): a node with two smaller
    neighbours, or with a smaller and a greater one, shows it."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")) \
        .union(edges.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    per = ends.groupBy("v").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    n, more = per.agg(F.sum("down"), F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()
    return n or 0, bool(more)


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b) except the least ones; label is the least node reachable.

    The number of steps grows with the logarithm of the number of nodes; each step is joins and aggregates over edges, staged in
    the shared folder after either half, so the driver holds small plans. Loops and repeated edges do no harm; edges with a null
    end are left out.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) \
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    now = staged(now, "components")
    while True:
        n_edges, more = _open(now)
        if not more:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        now = staged(_star(staged(_star(now, True, n_edges), "components"), False, n_edges), "components")
