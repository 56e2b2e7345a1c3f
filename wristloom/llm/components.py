"""Connected components of a graph given by its edges, as Spark jobs.

Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce
and Beyond" (2014): every step replaces edges by edges to smaller neighbours and keeps the components.
Hubs are no burden: a step groups by a node with a minimum only, and joins it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(arcs: DataFrame, keep) -> DataFrame:
    """Arcs (u, v) to edges (v, least neighbour of u or u itself), for those v that keep(v, u) holds for."""
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = arcs.join(least, "u").where(keep(F.col("v"), F.col("u"))).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest reachable node.

    Rounds go on until one changes nothing; their number grows with the logarithm of the longest path.
    """
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    previous = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: larger neighbours of u go to its least neighbour
        large = _star(both, lambda v, u: v > u).distinct()
        # small star: from the larger end, smaller neighbours and the node itself go to the least
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = written(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == previous:
            break
        previous = state
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
