"""Traversal, centrality and integrity of directed graphs, edges(src, dst): src depends on dst."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp, round_half_up
from .lineage import settle


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def levels(links: DataFrame, start: DataFrame, max_depth: int | None = None) -> Iterator[DataFrame]:
    """The rows (origin, node, .., ways) that are reached first at distance 0, 1, 2 ..: ``start`` has the first
    ones, with a path or without.  One join a level; the frontier alone is expanded, and a node is left
    out once it has been reached."""
    paths = "path" in start.columns
    kept = ["path", "ways"] if paths else ["ways"]
    longer = [F.concat("path", F.array("dst")).alias("path")] if paths else []
    best = [F.min("path").alias("path")] if paths else []
    seen = frontier = settle(start.select("origin", "node", *kept))
    depth = 0
    while not frontier.isEmpty():
        yield frontier
        depth += 1
        if max_depth is not None and depth > max_depth:
            return
        step = frontier.join(links, frontier["node"] == links["src"]).select("origin", F.col("dst").alias("node"), *longer, "ways")
        fresh = step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").groupBy("origin", "node").agg(*best, F.sum("ways").alias("ways"))
        frontier = settle(fresh.select("origin", "node", *kept))
        seen = seen.unionByName(frontier)


def traverse(edges: DataFrame, origins: DataFrame, max_depth: int | None = None, paths: bool = True) -> DataFrame:
    """(origin, node, distance, path, ways) of all that each origin reaches: path is the smallest of the
    shortest paths in the order of its nodes, ways their number.  Without ``paths`` there is no path."""
    links = settle(edges.select("src", "dst").where("src <> dst").distinct())  # read anew at each level
    path = [F.array("origin").alias("path")] if paths else []
    start = origins.select(F.col("origin"), F.col("origin").alias("node"), *path, F.lit(1).cast("long").alias("ways")).distinct()
    found = [x.withColumn("distance", F.lit(d)) for d, x in enumerate(levels(links, start, max_depth=max_depth))]
    if not found:
        found = [start.withColumn("distance", F.lit(0))]
    return reduce(DataFrame.unionByName, found).select("origin", "node", "distance", *(["path"] if paths else []), "ways")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out): distinct neighbours."""
    links = edges.select("src", "dst").where("src <> dst").distinct()
    into = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    out = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    return nodes.select("node").join(into, "node", "left").join(out, "node", "left").na.fill(0, ["fan_in", "fan_out"])


def reach(nodes: DataFrame, edges: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    """(node, reach): how many nodes depend on it, directly or not."""
    found = walked if walked is not None else traverse(reverse(edges), nodes.select(F.col("node").alias("origin")), paths=False)
    own = found.where("distance > 0").groupBy(F.col("origin").alias("node")).agg(F.count("*").alias("reach"))
    return nodes.select("node").join(own, "node", "left").na.fill(0, ["reach"])


def hotspots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, reach, hotspot): at least two dependents and half of the others."""
    n = nodes.agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(2), F.ceil((F.col("n") - 1) / 2))
    return reach(nodes, edges).join(F.broadcast(n)).select("node", "reach", (F.col("reach") >= least).alias("hotspot"))


def dependencies(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, amount): how much the shortest paths from all ``sources(origin)`` depend on each node, after
    Brandes: paths are counted level by level outwards, and shares come back level by level inwards,
    so that no pair of pairs is ever joined."""
    start = sources.select("origin", F.col("origin").alias("node"), F.lit(1).cast("long").alias("ways"))
    found = list(levels(links, start))
    given = [sources.select(F.col("origin").alias("node"), F.lit(0.0).alias("amount")).limit(0)]
    outer = None  # (origin, node, share) of a level: what a node hands to each way that leads to it
    for depth in range(len(found) - 1, 0, -1):
        level = found[depth]
        if outer is None:
            owed = level.select("origin", "node", (1 / F.col("ways")).alias("share"))
        else:
            owed = settle(level.join(outer, ["origin", "node"], "left").select("origin", "node", "ways", F.coalesce(F.col("ways") * F.col("share"), F.lit(0.0)).alias("amount")))
            given.append(owed.select("node", "amount"))
            owed = owed.select("origin", "node", ((1 + F.col("amount")) / F.col("ways")).alias("share"))
        # the steps of the way out, once more: those to a node of another level find nothing owed
        steps = found[depth - 1].join(links, F.col("node") == links["src"]).select("origin", "src", F.col("dst").alias("node"))
        outer = steps.join(owed, ["origin", "node"]).groupBy("origin", F.col("src").alias("node")).agg(F.sum("share").alias("share"))
    return reduce(DataFrame.unionByName, given).groupBy("node").agg(F.sum("amount").alias("amount"))


def betweenness(nodes: DataFrame, edges: DataFrame, batch: int = 100_000) -> DataFrame:
    """(node, betweenness): the sum over pairs of the share of their shortest paths through the
    node, its own pairs left out.  ``batch`` sources or so are followed at a time: that, times what a
    source reaches, bounds the rows of a level."""
    links = settle(edges.select("src", "dst").where("src <> dst").distinct())
    sources = settle(links.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("origin")).distinct())
    batches = -(-sources.count() // batch)
    own = [settle(dependencies(links, sources.where(F.pmod(F.xxhash64("origin"), F.lit(batches)) == k))) for k in range(batches)]
    if not own:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    total = reduce(DataFrame.unionByName, own).groupBy("node").agg(F.sum("amount").alias("b"))
    return nodes.select("node").join(total, "node", "left").select("node", round_half_up(F.coalesce("b", F.lit(0.0))).alias("betweenness"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges that remain when nodes without incoming or without outgoing edges are peeled
    off again and again; empty if and only if there is no cycle.  Self loops are not counted."""
    left = settle(edges.select("src", "dst").where("src <> dst").distinct())
    count = left.count()
    while count:
        left = settle(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = left.count()
        if now == count:
            break
        count = now
    return left


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an unknown end, and which: from, to or both."""
    known = nodes.select("node").distinct()
    a, b = known.select(F.col("node").alias("src"), F.lit(True).alias("has_src")), known.select(F.col("node").alias("dst"), F.lit(True).alias("has_dst"))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    missing = F.when(F.col("has_src").isNull() & F.col("has_dst").isNull(), "both").when(F.col("has_src").isNull(), "from").when(F.col("has_dst").isNull(), "to")
    return both.withColumn("missing", missing).where("missing is not null").select("src", "dst", "missing")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return nodes.select("node").join(ends, "node", "left_anti")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ok, nodes, edges, cycles, dangling, orphans.  Edges with an unknown end are dangling and
    take no part in the rest; sound is a graph without those and without cycles."""
    from .cycles import cycles

    lost = dangling(nodes, edges)
    sound = edges.join(lost.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    counts = [nodes.agg(F.count_distinct("node").alias("nodes")), edges.agg(F.count("*").alias("edges")), cycles(sound).agg(F.count("cycle").alias("cycles")), lost.agg(F.count("*").alias("dangling")), orphans(nodes.distinct(), sound).agg(F.count("*").alias("orphans"))]
    row = reduce(lambda a, b: a.join(F.broadcast(b)), counts)  # of one row each
    return row.select(((F.col("cycles") == 0) & (F.col("dangling") == 0)).alias("ok"), "nodes", "edges", "cycles", "dangling", "orphans")


def authoritative(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, authoritative): the edges at a node, either way, that are authoritative."""
    sure = edges.where("authoritative").select("src", "dst").distinct()
    ends = sure.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    return nodes.select("node").join(ends.groupBy("node").agg(F.count("*").alias("authoritative")), "node", "left").na.fill(0, ["authoritative"])


def profile(facts: DataFrame) -> DataFrame:
    """Risk score, level and priority from reach, fan_in, fan_out, betweenness, authoritative, hotspot."""
    score = 20 * F.col("reach") + 14 * F.col("fan_in") + 8 * F.col("fan_out") + F.least(F.lit(20.0), 4 * F.col("betweenness")) + 8 * F.col("authoritative") + F.when(F.col("hotspot"), 24).otherwise(0)
    risk = clamp(round_half_up(score.cast("double")), 0.0, 100.0)
    level = F.when(risk >= 75, "critical").when(risk >= 50, "high").when(risk >= 20, "medium").otherwise("low")
    priority = F.when(risk >= 75, "strict").when(risk >= 50, "elevated").otherwise("normal")
    return facts.withColumns({"risk": risk, "level": level, "priority": priority})
