"""What a change reaches: direct and transitive impact with risks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import hotspots, levels
from .lineage import settle

#: Risks in order; a rank is a place in it.
RISKS = ["none", "low", "medium", "high", "critical"]


def risk_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RISKS)), (rank + 1).cast("int"))


def change_rank(kind: Column, severity: Column) -> Column:
    """The rank of a change: removals and warnings are high, critical ones critical, others medium."""
    return F.when(kind == "removed", 3).when(severity == "critical", 4).when(severity == "warning", 3).otherwise(2)


def reached(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, distance, path, via) of all that depends on any of ``sources(node)``, themselves included, over
    ``edges(src, dst, kind)``: path is the smallest of the shortest paths from a source, via the least kind of its last edge."""
    back = settle(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind").where("src <> dst").groupBy("src", "dst").agg(F.min("kind").alias("kind")))
    start = sources.select(F.lit(0).alias("origin"), "node", F.array("node").alias("path"), F.lit(1).cast("long").alias("ways")).distinct()
    found = [x.select("node", F.lit(d).alias("distance"), "path") for d, x in enumerate(levels(back.select("src", "dst"), start, max_depth=max_depth))]
    if not found:
        found = [start.select("node", F.lit(0).alias("distance"), "path")]
    walked = reduce(DataFrame.unionByName, found).withColumn("before", F.when(F.size("path") > 1, F.try_element_at("path", F.lit(-2))))
    last = back.select(F.col("src").alias("before"), F.col("dst").alias("node"), F.col("kind").alias("via"))
    return walked.join(last, ["before", "node"], "left").select("node", "distance", "path", "via")


def impact(changes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, scope, source, distance, via, path, hotspot, risk) of ``changes(node, kind, severity)`` in a graph nodes(node),
    edges(src, dst, kind), where src depends on dst.

    A changed node is ``direct``: its risk is that of its worst change, one more if it is a hotspot.  What depends on
    one, near or far, is ``transitive``: its source is where its path begins, its risk one less than that of
    the source, but not none.  Changes of unknown nodes are direct as well; nothing depends on them.
    """
    hot = settle(hotspots(nodes, edges).select("node", "hotspot"))
    worst = changes.where("node is not null").groupBy("node").agg(F.max(change_rank(F.col("kind"), F.col("severity"))).alias("rank"))
    direct = settle(worst.join(hot, "node", "left").select("node", F.coalesce("hotspot", F.lit(False)).alias("hotspot"), F.least(F.lit(4), F.col("rank") + F.coalesce("hotspot", F.lit(False)).cast("int")).alias("rank")))
    none = F.lit(None).cast("string")
    first = direct.select("node", F.lit("direct").alias("scope"), F.col("node").alias("source"), F.lit(0).alias("distance"), none.alias("via"), F.array("node").alias("path"), "hotspot", "rank")
    far = reached(edges, direct.select("node")).where("distance > 0").join(nodes.select("node").distinct(), "node", "left_semi")
    origin = direct.select(F.col("node").alias("source"), F.col("rank").alias("from_rank"))
    then = far.withColumn("source", F.element_at("path", 1)).join(origin, "source").join(hot, "node", "left")
    then = then.select("node", F.lit("transitive").alias("scope"), "source", "distance", "via", "path", F.coalesce("hotspot", F.lit(False)).alias("hotspot"), F.greatest(F.lit(1), F.col("from_rank") - 1).alias("rank"))
    return first.unionByName(then).withColumn("risk", risk_name(F.col("rank"))).drop("rank")


def impact_summary(found: DataFrame) -> DataFrame:
    """One row: direct, transitive, max_distance and risk, the highest of all."""
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk")) - 1
    own = found.agg(F.count_if(F.col("scope") == "direct").alias("direct"), F.count_if(F.col("scope") == "transitive").alias("transitive"), F.coalesce(F.max("distance"), F.lit(0)).alias("max_distance"), F.coalesce(F.max(rank), F.lit(0)).alias("rank"))
    return own.select("direct", "transitive", "max_distance", risk_name(F.col("rank")).alias("risk"))
