"""How two nodes are connected: shortest chains of relations, whichever way these point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import stored


#: Rows (a query and a node each) that are broadcast to the relations; more are shuffled with them.
FEW = 1_000_000


def _steps(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """(query, node, other, relation, direction): the relations at the nodes of ``rows(query, node)``, whichever way they
    point.  Rows are few beside relations: those come to where the relations are read, which are neither turned round nor kept twice."""
    rows = stored(rows.select("query", "node"))
    near = F.broadcast(rows) if rows.count() <= FEW else rows
    sound = relations.where("src is not null and dst is not null and src <> dst")
    ways = [("src", "dst", "forward"), ("dst", "src", "reverse")]
    out = [sound.join(near, F.col("node") == F.col(a)).select("query", "node", F.col(b).alias("other"), F.col("id").alias("relation"), F.lit(d).alias("direction")) for a, b, d in ways]
    return out[0].unionByName(out[1])


def _outward(side: DataFrame, relations: DataFrame, depth: int) -> DataFrame:
    """``side(query, node, depth)`` with the nodes one further out."""
    edge = _steps(side.where(F.col("depth") == depth - 1), relations).select("query", F.col("other").alias("node")).distinct()
    return side.unionByName(stored(edge.join(side, ["query", "node"], "left_anti").select("query", "node", F.lit(depth).alias("depth"))))


def connections(pairs: DataFrame, relations: DataFrame, most: int = 64) -> DataFrame:
    """(query, hop, source, target, relation, direction), hop from 1: for each row of ``pairs(query, a, b)`` the
    shortest chain of ``relations(id, src, dst)`` from a to b; of several the one of least nodes, read from
    a, and between two nodes the relation of least id.

    Both ends are followed outwards, always the one with fewer rows at its edge, until they meet: a
    chain of n hops needs no more than what lies n / 2 around its ends.  Nodes are held with their
    distances only; the chain is read off afterwards, hop by hop.  No rows come from a pair without a
    chain, or with one of over ``most`` hops, or with a = b.

    Relations are read anew at every step, only as far as a step needs them, and may be repeated.
    """
    asked = stored(pairs.select("query", "a", "b").where("a is not null and b is not null").distinct())
    out_a = stored(asked.select("query", F.col("a").alias("node"), F.lit(0).alias("depth")))
    out_b = stored(asked.select("query", F.col("b").alias("node"), F.lit(0).alias("depth")))
    i = j = 0
    lengths: list[DataFrame] = []  # (query, i, j) of pairs that have met
    left_a, left_b = out_a, out_b
    kept_a: list[DataFrame] = []
    kept_b: list[DataFrame] = []
    while True:
        met = stored(left_a.join(left_b.select("query", "node"), ["query", "node"], "left_semi").select("query").distinct())
        lengths.append(met.select("query", F.lit(i).alias("i"), F.lit(j).alias("j")))
        kept_a.append(left_a.join(met, "query", "left_semi"))
        kept_b.append(left_b.join(met, "query", "left_semi"))
        left_a, left_b = left_a.join(met, "query", "left_anti"), left_b.join(met, "query", "left_anti")
        # a pair of which one end has nothing further out has no chain
        edges = [x.where(F.col("depth") == d).groupBy("query").count() for x, d in ((left_a, i), (left_b, j))]
        alive = stored(edges[0].join(edges[1].withColumnRenamed("count", "other"), "query"))
        sums = alive.agg(F.sum("count"), F.sum("other")).head()
        if sums is None or sums[0] is None or i + j >= most:
            break
        left_a, left_b = stored(left_a.join(alive, "query", "left_semi")), stored(left_b.join(alive, "query", "left_semi"))
        if sums[0] <= sums[1]:
            i += 1
            left_a = _outward(left_a, relations, i)
        else:
            j += 1
            left_b = _outward(left_b, relations, j)
    length = stored(reduce(DataFrame.unionByName, lengths))
    whole_a, whole_b = stored(reduce(DataFrame.unionByName, kept_a)), stored(reduce(DataFrame.unionByName, kept_b))
    # nodes by their place in a shortest chain: those of b's side have one, those of a's side if they lead to it
    late = whole_b.join(length, "query").select("query", "node", (F.col("i") + F.col("j") - F.col("depth")).alias("hop"))
    ahead = whole_a.join(length, "query").where("depth = i").join(whole_b.select("query", "node"), ["query", "node"], "left_semi").select("query", "node", F.col("depth").alias("hop"))
    marked = [stored(ahead)]
    for hop in range(i - 1, -1, -1):
        nearer = reduce(DataFrame.unionByName, marked).where(F.col("hop") == hop + 1)
        nearer = _steps(nearer, relations).select("query", F.col("other").alias("node")).distinct()
        marked.append(stored(nearer.join(whole_a.where(F.col("depth") == hop), ["query", "node"]).select("query", "node", F.lit(hop).alias("hop"))))
    places = stored(reduce(DataFrame.unionByName, [*marked, late]).distinct())
    at = asked.join(length, "query").where("i + j > 0").select("query", F.col("a").alias("node"))
    hops: list[DataFrame] = []
    for hop in range(1, i + j + 1):
        target = places.where(F.col("hop") == hop).select("query", F.col("node").alias("other"))
        ways = _steps(at, relations).join(target, ["query", "other"])
        best = stored(ways.groupBy("query", "node").agg(F.min(F.struct("other", "relation", "direction")).alias("r")))
        hops.append(best.select("query", F.lit(hop).alias("hop"), F.col("node").alias("source"), F.col("r.other").alias("target"), "r.relation", "r.direction"))
        at = best.join(length, "query").where(F.col("i") + F.col("j") > hop).select("query", F.col("r.other").alias("node"))
    if not hops:
        return _steps(at, relations).select("query", F.lit(0).alias("hop"), F.col("node").alias("source"), F.col("other").alias("target"), "relation", "direction").limit(0)
    return reduce(DataFrame.unionByName, hops)
