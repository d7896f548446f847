"""Components of directed graphs and their cycles, edges(src, dst)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cyclic_core, reverse
from .lineage import settle

#: Joins between two checkpoints of a propagation.
HOPS = 2


def least_before(links: DataFrame, start: DataFrame) -> DataFrame:
    """(node, label): the least label of ``start(node, label)`` that leads to each node of ``start`` along
    ``links``; only labels that have changed are passed on."""
    known = settle(start.select("node", "label"))
    fresh = known
    while not fresh.isEmpty():
        for _ in range(HOPS):
            sent = fresh.join(links, fresh["node"] == links["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("sent"))
            now = known.join(sent, "node", "left").select("node", F.least("label", "sent").alias("label"), (F.col("sent") < F.col("label")).alias("new"))
            known, fresh = now.select("node", "label"), now.where("new").select("node", "label")
        both = settle(now.withColumn("new", F.coalesce("new", F.lit(False))))
        known, fresh = both.select("node", "label"), both.where("new").select("node", "label")
    return known


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of an edge: component is the least node that a chain of edges
    connects it with.  Each round every node points its neighbours at the least of them, in two
    steps, so that chains shorten by half; a node of many neighbours is a combined aggregate."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    links = settle(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    while True:
        # every neighbour above a node goes to the least one around it
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every neighbour below a node, and the node, go to the least of them
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(low, "a").where("b <> m").select("b", "m").union(low).toDF("a", "b").distinct()
        now = settle(down)
        moved = not now.exceptAll(links).isEmpty() or not links.exceptAll(now).isEmpty()
        links = now
        if not moved:
            return ends.join(links.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node that a node reaches and is reached from.

    Nodes off all cycles are peeled away.  In what is left each node takes the colour of the least node
    that leads to it; the nodes that lead back to that one within their colour are its component.  Those
    are taken out, and the rest is peeled and coloured again.
    """
    left, done = cyclic_core(edges), []
    while not left.isEmpty():
        ends = left.select(F.col("src").alias("node")).distinct()  # in the core each has both kinds of edges
        sinks = left.select(F.col("dst").alias("node")).distinct()
        colour = settle(least_before(left, ends.union(sinks).distinct().withColumn("label", F.col("node"))))
        a, b = colour.toDF("src", "from_label"), colour.toDF("dst", "to_label")
        inner = settle(left.join(a, "src").join(b, "dst").where("from_label = to_label").select("src", "dst"))
        # roots send their own name back; it stays in their colour
        start = colour.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).alias("label"))
        own = settle(_marked(reverse(inner), start.where("label is not null")))
        done.append(own)
        rest = left.join(own.select(F.col("node").alias("src")), "src", "left_anti").join(own.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = cyclic_core(rest.select("src", "dst"))
    alone = nodes.select("node").distinct()
    if not done:
        return alone.select("node", F.col("node").alias("component"))
    found = reduce(DataFrame.unionByName, done).select("node", F.col("label").alias("component"))
    return alone.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _marked(links: DataFrame, start: DataFrame) -> DataFrame:
    """(node, label) of all that ``start(node, label)`` leads to, where no node is led to by two labels."""
    seen = fresh = settle(start.select("node", "label"))
    while not fresh.isEmpty():
        step = fresh.join(links, fresh["node"] == links["src"]).select(F.col("dst").alias("node"), "label").distinct()
        fresh = settle(step.join(seen, "node", "left_anti"))
        seen = seen.union(fresh)
    return seen


def back_edge_cycles(links: Iterable[tuple]) -> list[list]:
    """The cycles that a depth-first walk closes, from the least node on and to lesser neighbours first;
    each begins and ends at its least node and is there once."""
    after: dict = {}
    for a, b in sorted(set(links)):
        after.setdefault(a, []).append(b)
    rings, left = set(), set()
    for root in after:  # sorted, as the edges were
        if root in left:
            continue
        path, place, ahead = [root], {root: 0}, [iter(after[root])]
        while path:
            try:
                node = next(ahead[-1])
            except StopIteration:
                ahead.pop()
                left.add(path[-1])
                del place[path.pop()]
                continue
            if node in place:
                ring = path[place[node] :]
                k = ring.index(min(ring))
                rings.add((*ring[k:], *ring[:k], ring[k]))
            elif node not in left:
                place[node] = len(path)
                path.append(node)
                ahead.append(iter(after.get(node, ())))
    return [list(r) for r in sorted(rings)]


def cycles(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(component, edges, cycle): the cycles that a depth-first walk of the graph closes, as arrays from the
    least node back to it.

    A walk does not leave a weak component, so each is walked on its own, in one task, if it has ``most``
    edges or fewer.  A larger one is walked by strong components, each from its least node on: the cycles
    are cycles of the graph, though a walk that enters it elsewhere may close others.  A strong component
    of over ``most`` edges is not walked but reported, by a row whose cycle is null.
    """
    links = settle(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    member = settle(weak_components(links))
    placed = settle(links.join(member.select(F.col("node").alias("src"), "component"), "src"))
    large = placed.groupBy("component").count().where(F.col("count") > most)
    if not large.isEmpty():
        big = placed.join(large, "component", "left_semi")
        ends = big.select(F.col("src").alias("node")).union(big.select("dst"))
        strong = strong_components(ends, big)
        inner = big.select("src", "dst").join(strong.select(F.col("node").alias("src"), "component"), "src").join(strong.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst")
        placed = placed.join(large, "component", "left_anti").unionByName(inner.where("component = other").select("src", "component", "dst"))
    sized = placed.join(placed.groupBy("component").agg(F.count("*").alias("edges")), "component")
    kind = links.schema["src"].dataType.simpleString()

    def walk(own: pa.Table) -> pa.Table:
        rings = back_edge_cycles(zip(own["src"].to_pylist(), own["dst"].to_pylist(), strict=True))
        node = own.schema.field("src").type
        first = pa.array([own["component"][0].as_py()] * len(rings), node)
        return pa.table({"component": first, "edges": pa.array([own.num_rows] * len(rings), pa.int64()), "cycle": pa.array(rings, pa.list_(node))})

    walked = sized.where(F.col("edges") <= most).groupBy("component").applyInArrow(walk, f"component {kind}, edges long, cycle array<{kind}>")
    reported = sized.where(F.col("edges") > most).select("component", "edges", F.lit(None).cast(f"array<{kind}>").alias("cycle")).distinct()
    return walked.unionByName(reported)
