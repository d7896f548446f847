"""Star-schema tables as a property graph, in DataFrames and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import following


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: kind, table, key, label and the project that an entity belongs to.
ENTITIES = [
    ("region", "region", "r_regionkey", "r_name"),
    ("nation", "nation", "n_nationkey", "n_name"),
    ("customer", "customer", "c_custkey", "c_name"),
    ("supplier", "supplier", "s_suppkey", "s_name"),
    ("part", "part", "p_partkey", "p_name"),
]
ENTITY_SQL = " UNION ALL ".join(f"SELECT '{kind}:' || CAST({key} AS VARCHAR) AS id, '{kind}' AS kind, {label} AS label FROM {name}" for kind, name, key, label in ENTITIES)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, name, key, label in ENTITIES:
        own = table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"))
        out = own if out is None else out.unionByName(own)
    return out


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, amount, authoritative): supplier nations and all other nations that they sell to;
    authoritative if a line is of a manual or contract source, that is, not returned."""
    t = lambda name: table(spark, sf_dir, name)
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.sum(paid).alias("amount"), F.bool_or(F.coalesce(F.col("l_returnflag") != "R", F.lit(False))).alias("authoritative"))
    )


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, amount): the pairs whose amount is over the mean by a standard deviation."""
    pair = pairs(spark, sf_dir)
    usual = pair.agg((F.avg("amount") + F.stddev_pop("amount")).alias("least"))
    return pair.join(F.broadcast(usual)).where("amount > least").select("src", "dst", "amount")


#: Kinds of node in the supply graph, with their tables and keys.
SUPPLY = [("customer", "customer", "c_custkey"), ("order", "orders", "o_orderkey"), ("part", "part", "p_partkey"), ("supplier", "supplier", "s_suppkey")]


def supply_node(kind: str, key: str) -> Column:
    """A node as one whole number: its key, then its kind."""
    return F.col(key).cast("long") * len(SUPPLY) + [k for k, _, _ in SUPPLY].index(kind)


def supply_name(node: str) -> Column:
    names = F.array(*(F.lit(f"{k}:") for k, _, _ in SUPPLY))
    n = len(SUPPLY)
    return F.concat(F.element_at(names, (F.pmod(F.col(node), F.lit(n)) + 1).cast("int")), F.floor(F.col(node) / n).cast("string"))


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [table(spark, sf_dir, name).select(supply_node(kind, key).alias("node")) for kind, name, key in SUPPLY]
    return reduce(DataFrame.union, own).where("node is not null").distinct()


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of every key: customers to their orders, orders to parts, parts to suppliers."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    placed = orders.select(supply_node("customer", "o_custkey").alias("src"), supply_node("order", "o_orderkey").alias("dst"))
    held = lines.select(supply_node("order", "l_orderkey").alias("src"), supply_node("part", "l_partkey").alias("dst"))
    made = lines.select(supply_node("part", "l_partkey").alias("src"), supply_node("supplier", "l_suppkey").alias("dst"))
    return placed.union(held).union(made).where("src is not null and dst is not null").distinct()


#: Sections of a site: keys of events by fives; a node is a user's visit to one.
SECTION, SECTIONS = 5, 100


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, user_id, event_type, ts, event_id) of the events with a key: node is the user x 100 + the section."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    node = F.col("user_id").cast("long") * SECTIONS + F.floor(k / SECTION)
    return table(spark, sf_dir, "events").select(node.alias("node"), "user_id", "event_type", "ts", "event_id").where("node is not null and ts is not null")


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, moves): from one section to that of the user's next event, and how often."""
    own = following(visits(spark, sf_dir), "user_id", F.to_date("ts"), ["ts", "event_id"], "node")
    return own.where("next is not null").groupBy(F.col("node").alias("src"), F.col("next").alias("dst")).agg(F.count("*").alias("moves"))


VISITS_SQL = """visit AS (
    SELECT user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) // 5 AS node, user_id, event_type, ts, event_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
), moved AS (SELECT node AS src, lead(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM visit),
move AS (SELECT src, dst, count(*) AS moves FROM moved WHERE dst IS NOT NULL GROUP BY 1, 2), edge AS (SELECT src, dst FROM move WHERE src <> dst)"""

TRADE_SQL = """pair AS (
    SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_extendedprice * (1 - l_discount)) AS amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE s_nationkey <> c_nationkey GROUP BY 1, 2
), edge AS (SELECT src, dst FROM pair WHERE amount > (SELECT avg(amount) + stddev_pop(amount) FROM pair))"""
#: All simple paths along edges, and the shortest of each pair.
PATHS_SQL = """walk(origin, node, distance, path) AS (
    SELECT n_nationkey, n_nationkey, 0, [n_nationkey] FROM nation
    UNION ALL
    SELECT w.origin, e.dst, w.distance + 1, list_append(w.path, e.dst) FROM walk w JOIN edge e ON e.src = w.node
    WHERE NOT list_contains(w.path, e.dst) AND w.distance < 8
), short AS (SELECT origin, node, min(distance) AS distance FROM walk GROUP BY 1, 2),
best AS (
    SELECT origin, node, any_value(s.distance) AS distance, min(path) AS path, count(*) AS ways
    FROM walk w JOIN short s USING (origin, node) WHERE w.distance = s.distance GROUP BY 1, 2
)"""
BACK_SQL = PATHS_SQL.replace("e.dst", "e.X").replace("e.src", "e.dst").replace("e.X", "e.src")
#: All pairs as edges, and the distances along them: a level a step, at most as many as there are nations.
ALL_SQL = TRADE_SQL[: TRADE_SQL.index(", edge AS (")] + ", edge AS (SELECT src, dst FROM pair)"
FAR_SQL = """far(origin, node, distance) AS (
    SELECT n_nationkey, n_nationkey, 0 FROM nation
    UNION SELECT f.origin, e.dst, f.distance + 1 FROM far f JOIN edge e ON e.src = f.node WHERE f.distance < (SELECT count(*) FROM nation)
), best AS (SELECT origin, node, min(distance) AS distance FROM far GROUP BY 1, 2)"""
FAR_BACK_SQL = FAR_SQL.replace("e.dst", "e.X").replace("e.src", "e.dst").replace("e.X", "e.src")
