"""Queries over the nations' trade graph and over the entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alias_key, stable_id
from ..operators import graph
from .tables import BACK_SQL, ENTITY_SQL, PATHS_SQL, TRADE_SQL, entities, nations, table, trade

Spark = SparkSession
Links = Callable[[SparkSession, str], DataFrame]


def entity_list(spark: Spark, sf_dir: str) -> DataFrame:
    own = entities(spark, sf_dir)
    return own.select("id", "kind", "label", stable_id(F.col("kind"), F.col("id")).alias("stable_id"))


def resolve_alias(spark: Spark, sf_dir: str) -> DataFrame:
    own = entities(spark, sf_dir).groupBy(alias_key(F.col("label")).alias("alias")).agg(F.count("*").alias("candidates"), F.min("id").alias("least"))
    return own.select("alias", "candidates", F.when(F.col("candidates") == 1, F.col("least")).alias("resolved"))


def evidence_lookup(spark: Spark, sf_dir: str) -> DataFrame:
    proofs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").distinct()
    own = proofs.groupBy("o_custkey").agg(F.count("*").alias("proofs"), F.min("o_orderkey").alias("first_proof"), F.max("o_orderkey").alias("last_proof"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customers.join(own, customers["c_custkey"] == own["o_custkey"], "left").select("c_custkey", "c_name", F.coalesce("proofs", F.lit(0)).alias("proofs"), "first_proof", "last_proof")


def trade_edges(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    return links(spark, sf_dir).select("src", "dst", F.round("amount", 2).alias("amount"))


def transitive_dependents(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    """The flagship: who depends on each nation, and how far away."""
    walked = graph.traverse(graph.reverse(links(spark, sf_dir)), nations(spark, sf_dir).select(F.col("node").alias("origin")))
    return walked.select("origin", "node", "distance")


def shortest_paths(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    walked = graph.traverse(links(spark, sf_dir), nations(spark, sf_dir).select(F.col("node").alias("origin")))
    return walked.select("origin", "node", "distance", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "ways")


def degree(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    return graph.degrees(nations(spark, sf_dir), links(spark, sf_dir))


def reach_hotspots(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    return graph.hotspots(nations(spark, sf_dir), links(spark, sf_dir))


def betweenness(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    return graph.betweenness(nations(spark, sf_dir), links(spark, sf_dir))


def operational_profile(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    from ..operators.lineage import settle

    nodes, edges = nations(spark, sf_dir), settle(links(spark, sf_dir))
    known = graph.authoritative(nodes, edges) if "authoritative" in edges.columns else nodes.withColumn("authoritative", F.lit(0))
    facts = graph.degrees(nodes, edges).join(graph.hotspots(nodes, edges), "node").join(graph.betweenness(nodes, edges), "node").join(known, "node")
    own = graph.profile(facts)
    return own.select("node", "reach", "fan_in", "fan_out", "betweenness", "hotspot", "risk", "level", "priority")


def has_cycle(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    """The edges on cycles or between them."""
    return graph.cyclic_core(links(spark, sf_dir))


def integrity_dangling(spark: Spark, sf_dir: str) -> DataFrame:
    """Links of orders to customers where the order is pending or the customer has no balance above
    zero: neither is a known node."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("node"))
    orders = table(spark, sf_dir, "orders")
    done = orders.where("o_orderstatus <> 'P'").select(F.concat(F.lit("order:"), "o_orderkey").alias("node"))
    links = orders.select(F.concat(F.lit("order:"), "o_orderkey").alias("src"), F.concat(F.lit("customer:"), "o_custkey").alias("dst"))
    return graph.dangling(customers.union(done), links)


def orphan_nodes(spark: Spark, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.orphans(customers, urgent.select(F.lit(None).cast("long").alias("src"), "dst"))


def graph_stats(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    n = nations(spark, sf_dir).agg(F.count("*").alias("nodes"))
    e = links(spark, sf_dir).agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))
    density = F.round(F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), 6)
    return n.join(F.broadcast(e)).select("nodes", "edges", "sources", "targets", density.alias("density"))


def explain_node(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    """For every nation its neighbours one and two links away, in either direction."""
    edges, start = links(spark, sf_dir), nations(spark, sf_dir).select(F.col("node").alias("origin"))
    up = graph.traverse(graph.reverse(edges), start, 2).select("origin", "node", "distance", F.lit("dependent").alias("role"))
    down = graph.traverse(edges, start, 2).select("origin", "node", "distance", F.lit("dependency").alias("role"))
    return up.unionByName(down).where("distance > 0")


QUERIES = {f.__name__: f for f in (entity_list, resolve_alias, evidence_lookup, trade_edges, transitive_dependents, shortest_paths, degree, reach_hotspots, betweenness, operational_profile, has_cycle, integrity_dangling, orphan_nodes, graph_stats, explain_node)}

_REACH = """reached AS (SELECT n_nationkey AS node, count(b.node) AS reach FROM nation LEFT JOIN best b ON b.origin = n_nationkey AND b.distance > 0 GROUP BY 1)"""
_BETWEEN = """through AS (
    SELECT a.node AS node, sum(a.ways * b.ways / w.ways) AS b FROM best a JOIN best b ON a.node = b.origin JOIN best w ON w.origin = a.origin AND w.node = b.node
    WHERE a.distance > 0 AND b.distance > 0 AND w.distance > 0 AND a.distance + b.distance = w.distance GROUP BY 1
), between_ AS (SELECT n_nationkey AS node, floor(coalesce(b, 0.0) * 1000 + 0.5) / 1000 AS betweenness FROM nation LEFT JOIN through ON node = n_nationkey)"""
_DEGREE = """deg AS (
    SELECT n_nationkey AS node, (SELECT count(DISTINCT src) FROM edge WHERE dst = n_nationkey) AS fan_in, (SELECT count(DISTINCT dst) FROM edge WHERE src = n_nationkey) AS fan_out FROM nation
)"""
_HOT = "hot AS (SELECT node, reach, reach >= greatest(2, ceil(((SELECT count(*) FROM nation) - 1) / 2)) AS hotspot FROM reached)"
_BACK_NAMED = BACK_SQL.replace("walk", "back_walk").replace("short", "back_short").replace("best", "back_best")
ORACLE_SQL = {
    "entity_list": f"SELECT id, kind, label, 'wkg:' || kind || ':' || left(sha256(kind || chr(0) || id), 20) AS stable_id FROM ({ENTITY_SQL})",
    "resolve_alias": f"SELECT lower(trim(label)) AS alias, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(id) END AS resolved FROM ({ENTITY_SQL}) GROUP BY 1",
    "evidence_lookup": "SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS proofs, min(o_orderkey) AS first_proof, max(o_orderkey) AS last_proof FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
    "trade_edges": f"WITH {TRADE_SQL} SELECT src, dst, round(amount, 2) AS amount FROM pair JOIN edge USING (src, dst)",
    "transitive_dependents": f"WITH RECURSIVE {TRADE_SQL}, {BACK_SQL} SELECT origin, node, distance FROM best",
    "shortest_paths": f"WITH RECURSIVE {TRADE_SQL}, {PATHS_SQL} SELECT origin, node, distance, array_to_string(path, '>') AS path, ways FROM best",
    "degree": f"WITH {TRADE_SQL}, {_DEGREE} SELECT node, fan_in, fan_out FROM deg",
    "reach_hotspots": f"WITH RECURSIVE {TRADE_SQL}, {BACK_SQL}, {_REACH}, {_HOT} SELECT node, reach, hotspot FROM hot",
    "betweenness": f"WITH RECURSIVE {TRADE_SQL}, {PATHS_SQL}, {_BETWEEN} SELECT node, betweenness FROM between_",
    "operational_profile": f"""WITH RECURSIVE {TRADE_SQL}, {PATHS_SQL}, {_BETWEEN}, {_BACK_NAMED}, {_REACH.replace("best", "back_best")}, {_HOT}, {_DEGREE}, facts AS (
            SELECT node, reach, fan_in, fan_out, betweenness, hotspot,
                   least(greatest(floor((20 * reach + 14 * fan_in + 8 * fan_out + least(20.0, 4 * betweenness) + CASE WHEN hotspot THEN 24 ELSE 0 END) * 1000 + 0.5) / 1000, 0.0), 100.0) AS risk
            FROM deg JOIN hot USING (node) JOIN between_ USING (node))
        SELECT node, reach, fan_in, fan_out, betweenness, hotspot, risk,
               CASE WHEN risk >= 75 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 20 THEN 'medium' ELSE 'low' END AS level,
               CASE WHEN risk >= 75 THEN 'strict' WHEN risk >= 50 THEN 'elevated' ELSE 'normal' END AS priority FROM facts""",
    # an edge stays if its start is reached from a cycle and its end reaches one
    "has_cycle": f"""WITH RECURSIVE {TRADE_SQL}, far(a, b) AS (SELECT src, dst FROM edge UNION SELECT a, dst FROM far JOIN edge ON b = src),
        loops AS (SELECT a AS node FROM far WHERE a = b)
        SELECT src, dst FROM edge
        WHERE (src IN (SELECT node FROM loops) OR src IN (SELECT b FROM far WHERE a IN (SELECT node FROM loops)))
          AND (dst IN (SELECT node FROM loops) OR dst IN (SELECT a FROM far WHERE b IN (SELECT node FROM loops)))""",
    "integrity_dangling": """WITH links AS (SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst, o_orderstatus = 'P' AS no_src, coalesce(NOT c_acctbal > 0, true) AS no_dst FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
        SELECT src, dst, CASE WHEN no_src AND no_dst THEN 'both' WHEN no_src THEN 'from' ELSE 'to' END AS missing FROM links WHERE no_src OR no_dst""",
    "orphan_nodes": "SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "graph_stats": f"WITH {TRADE_SQL} SELECT (SELECT count(*) FROM nation) AS nodes, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, round(count(*) / ((SELECT count(*) FROM nation) * ((SELECT count(*) FROM nation) - 1)), 6) AS density FROM edge",
    "explain_node": f"""WITH RECURSIVE {TRADE_SQL}, {PATHS_SQL}, {_BACK_NAMED}
        SELECT origin, node, distance, 'dependency' AS role FROM best WHERE distance BETWEEN 1 AND 2
        UNION ALL SELECT origin, node, distance, 'dependent' AS role FROM back_best WHERE distance BETWEEN 1 AND 2""",
}
