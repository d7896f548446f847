"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b): every node points its neighbours to its least one.

    The least neighbour comes from a combined aggregate joined back, so a node with
    a third of all edges is pre-aggregated and its join side can be split.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select("b", "m").where("b <> m").union(least.select("a", "m")).toDF("a", "b")
    return out.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that a link (a, b) touches and that is not itself the
    root; root is the least node reachable.  An empty link table gives an empty result."""
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        edges = durable(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == mark or now[0] == 0:
            return edges.toDF("node", "root")
        mark = now
    raise RuntimeError("components did not settle")
