"""Connected components of a graph given as an edge table, in rounds of two joins.

Alternates the large-star and small-star steps (Kiveris et al., "Connected components in
MapReduce and beyond", SoCC 2014) with plain aggregates and joins: no neighbour list is
ever collected, so a node of any degree is a sum over tasks.  Every round is written to
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every neighbour above u points to the least of u and its neighbours.
    small: u and its neighbours below point to the least of them.
    The neighbours of one node may be in many tasks."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = spread_join(both, least, "a", "b")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b of one comparable type.  Returns (node, root) for every node
    that is not the least of its component; root is that least node."""
    now = staged(edges.select("a", "b").where("a <> b").distinct(), "components")
    seen = None
    while True:
        now = staged(_star(staged(_star(now, True), "components"), False), "components")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
