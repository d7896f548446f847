"""Graph queries without a threshold: all pairs of nations, and the supply graph of all keys."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from . import graph_queries, stream_queries
from .tables import ALL_SQL, BACK_SQL, FAR_BACK_SQL, FAR_SQL, PATHS_SQL, TRADE_SQL, pairs, supply, supply_name, supply_nodes

Spark = SparkSession


def whole_operational_profile(spark: Spark, sf_dir: str) -> DataFrame:
    """With authoritative edges, and the priority by level."""
    own = graph_queries.operational_profile(spark, sf_dir, pairs)
    return own.withColumn("priority", F.when(F.col("level").isin("critical", "high"), "strict").when(F.col("level") == "medium", "elevated").otherwise("normal"))


def supply_edges(spark: Spark, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).select(supply_name("src").alias("src"), supply_name("dst").alias("dst"))


def supply_dependents(spark: Spark, sf_dir: str) -> DataFrame:
    """Who depends on each supplier, part, order and customer, and how far away."""
    walked = graph.traverse(graph.reverse(supply(spark, sf_dir)), supply_nodes(spark, sf_dir).select(F.col("node").alias("origin")), paths=False)
    return walked.select(supply_name("origin").alias("origin"), supply_name("node").alias("node"), "distance", "ways")


def supply_degree(spark: Spark, sf_dir: str) -> DataFrame:
    own = graph.degrees(supply_nodes(spark, sf_dir), supply(spark, sf_dir))
    return own.select(supply_name("node").alias("node"), "fan_in", "fan_out")


def supply_hotspots(spark: Spark, sf_dir: str) -> DataFrame:
    own = graph.hotspots(supply_nodes(spark, sf_dir), supply(spark, sf_dir))
    return own.select(supply_name("node").alias("node"), "reach", "hotspot")


def supply_betweenness(spark: Spark, sf_dir: str) -> DataFrame:
    own = graph.betweenness(supply_nodes(spark, sf_dir), supply(spark, sf_dir))
    return own.select(supply_name("node").alias("node"), "betweenness")


_GRAPH = ["trade_edges", "transitive_dependents", "shortest_paths", "degree", "reach_hotspots", "betweenness", "has_cycle", "graph_stats", "explain_node"]
_DRAWN = ["graph_dot", "graph_mermaid", "graph_graphml"]
QUERIES = {f"whole_{k}": partial(m.QUERIES[k], links=pairs) for m, names in ((graph_queries, _GRAPH), (stream_queries, _DRAWN)) for k in names}
QUERIES |= {f.__name__: f for f in (whole_operational_profile, supply_edges, supply_dependents, supply_degree, supply_hotspots, supply_betweenness)}

_NO_TWIN = {"shortest_paths", "betweenness"}  # simple paths are too many: tested against brute force


def _twin(sql: str) -> str:
    named = lambda x: x.replace("far", "back_far").replace("best", "back_best")
    sql = sql.replace(TRADE_SQL, ALL_SQL).replace(graph_queries._BACK_NAMED, named(FAR_BACK_SQL))
    return sql.replace(PATHS_SQL, FAR_SQL).replace(BACK_SQL, FAR_BACK_SQL)


_SUPPLY_SQL = """edge AS (
    SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst FROM orders
    UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem UNION SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem
), node AS (
    SELECT 'customer:' || c_custkey AS node FROM customer UNION SELECT 'order:' || o_orderkey FROM orders UNION SELECT 'part:' || p_partkey FROM part UNION SELECT 'supplier:' || s_suppkey FROM supplier
)"""
#: Edges lead from one layer to the next, so all walks are shortest paths.
_SUPPLY_WALK = """walk(origin, node, distance, ways) AS (
    SELECT node, node, 0, 1::BIGINT FROM node
    UNION ALL SELECT origin, src, distance + 1, sum(ways)::BIGINT FROM walk w JOIN edge e ON e.dst = w.node GROUP BY 1, 2, 3
)"""
ORACLE_SQL = {f"whole_{k}": _twin(m.ORACLE_SQL[k]) for m, names in ((graph_queries, _GRAPH), (stream_queries, _DRAWN)) for k in names if k not in _NO_TWIN}
ORACLE_SQL |= {
    "supply_edges": f"WITH {_SUPPLY_SQL} SELECT src, dst FROM edge WHERE src IS NOT NULL AND dst IS NOT NULL",
    "supply_dependents": f"WITH RECURSIVE {_SUPPLY_SQL}, {_SUPPLY_WALK} SELECT origin, node, distance, ways FROM walk",
    "supply_degree": f"""WITH {_SUPPLY_SQL} SELECT node, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM node
        LEFT JOIN (SELECT dst AS node, count(*) AS n FROM edge GROUP BY 1) i USING (node) LEFT JOIN (SELECT src AS node, count(*) AS n FROM edge GROUP BY 1) o USING (node)""",
    "supply_hotspots": f"""WITH RECURSIVE {_SUPPLY_SQL}, {_SUPPLY_WALK} SELECT origin AS node, count(*) - 1 AS reach,
        count(*) - 1 >= greatest(2, ceil(((SELECT count(*) FROM node) - 1) / 2)) AS hotspot FROM walk GROUP BY origin""",
}
