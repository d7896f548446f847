"""Joins, selections and verdicts by rule over the star-schema tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.selection import bounded, dealt_in_turn, stratified
from .tables import ENTITY_SQL, entities, table

Spark = SparkSession


def percent(a: Column, b: Column) -> Column:
    """A share in hundredths of a percent, half up; null where there is nothing to share."""
    return F.when(b > 0, F.floor(a * 10000 / b + 0.5) / 100)


PERCENT = "CASE WHEN {b} > 0 THEN floor(CAST({a} AS DOUBLE) * 10000 / {b} + 0.5) / 100 END"


# -- joins ----------------------------------------------------------------------------------


def package_join(spark: Spark, sf_dir: str) -> DataFrame:
    """Parts as packages that declare the brand of another as a dependency: the type names the
    wanted brand's digits.  Edges between brands, without self loops and repeats."""
    part = table(spark, sf_dir, "part")
    wanted = part.select(F.col("p_brand").alias("src"), F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("name")).distinct()
    names = part.select(F.col("p_brand").alias("dst")).distinct()
    return wanted.join(names, F.col("name") == F.col("dst")).where("src <> dst").select("src", "dst")


def local_resolution(spark: Spark, sf_dir: str) -> DataFrame:
    """Suppliers looked up by nation and balance band: the key of the only one, else external."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.floor(F.col("s_acctbal") / 1000).cast("long").alias("band"), "s_suppkey")
    n = s.groupBy("s_nationkey", "band").agg(F.count("*").alias("targets"), F.min("s_suppkey").alias("only"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"), F.floor(F.col("c_acctbal") / 1000).cast("long").alias("band"))
    both = c.join(n, ["s_nationkey", "band"], "left")
    return both.select("c_custkey", F.when(F.col("targets") == 1, F.col("only")).alias("local"), (F.coalesce("targets", F.lit(0)) != 1).alias("external"))


def endpoint_reconciliation(spark: Spark, sf_dir: str) -> DataFrame:
    """Order lines of one part, supplier and ship mode flag seen at least twice, one of them not
    returned: corroborated."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey", "l_linestatus")
    out = own.agg(F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("l_returnflag") != "R", F.lit(False))).alias("authoritative"))
    return out.where("n >= 2 and authoritative").drop("authoritative")


def first_existing(spark: Spark, sf_dir: str) -> DataFrame:
    """Each customer's preferred supplier: of three candidate keys in order, the first that exists."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, F.posexplode(F.array(k, (k * 7) % 1000, (k % 10) + 1)).alias("pos", "s_suppkey"))
    hit = c.join(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    return hit.groupBy("c_custkey").agg(F.min_by("s_suppkey", "pos").alias("target"), F.min("pos").alias("pos"))


def missing_dependencies(spark: Spark, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").select("c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def project_consumers(spark: Spark, sf_dir: str) -> DataFrame:
    """Consumers of each part: nations that ordered it, and regions whose suppliers deliver it."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    asked = line.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    made = line.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    both = asked.select("l_partkey", F.col("c_nationkey").alias("nation")).union(made.select("l_partkey", "s_nationkey")).distinct()
    return both.groupBy("l_partkey").agg(F.count("*").alias("consumers"), F.min("nation").alias("first_consumer"))


def finding_subjects(spark: Spark, sf_dir: str) -> DataFrame:
    """Benchmark items as findings whose first word is the subject: of the parts with that first
    word, the four of least key, or none."""
    word = lambda c: F.lower(F.element_at(F.split(F.trim(F.col(c)), " "), 1))
    parts = bounded(table(spark, sf_dir, "part").select(word("p_name").alias("subject"), "p_partkey"), "subject", ["p_partkey"], 4)
    found = table(spark, sf_dir, "benchmark").select("item_id", word("text").alias("subject")).join(parts, "subject", "left")
    return found.groupBy("item_id", "subject").agg(F.count("p_partkey").alias("resolved"), F.min("p_partkey").alias("first_root"))


def manual_edges(spark: Spark, sf_dir: str) -> DataFrame:
    """Lines as edges between a part and the part of its supplier's key: those with known ends and a
    valid kind, and no loop."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 3).alias("dst"), F.col("l_returnflag").alias("kind")).distinct()
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    own = own.where("src <> dst and kind in ('A', 'N')")
    return own.join(known, F.col("src") == F.col("node"), "left_semi").join(known, F.col("dst") == F.col("node"), "left_semi")


def scope_members(spark: Spark, sf_dir: str) -> DataFrame:
    """Parts in the scope of each region: shared ones, next to a supplier of the region."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    near = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("n_regionkey", "l_partkey").distinct()
    return near.groupBy("n_regionkey").agg(F.count("*").alias("parts"), F.min("l_partkey").alias("first_part"))


# -- selections -------------------------------------------------------------------------------


def kind_selection(spark: Spark, sf_dir: str) -> DataFrame:
    """Of each kind the first 8 entities by label and id, kinds in order of priority, 30 in all."""
    kinds = ["supplier", "region", "nation", "part", "customer"]
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    own = bounded(entities(spark, sf_dir), "kind", ["label", "id"], 8).withColumn("priority", rank)
    first = own.orderBy("priority", "nth").limit(30)
    return first.select("id", "kind", "nth")


def touching_relations(spark: Spark, sf_dir: str) -> DataFrame:
    """128 orders, those of the first hundred customers before others, by key."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") <= 100).alias("touches"))
    return own.orderBy(F.desc_nulls_last("touches"), "o_orderkey").limit(128)


def stratified_documents(spark: Spark, sf_dir: str) -> DataFrame:
    """60 documents: the first 15 of each of four languages, more or fewer by their number, then others."""
    own = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang")
    return stratified(own, "lang", ["doc_id"], 60)


def edge_evidence(spark: Spark, sf_dir: str) -> DataFrame:
    """Up to five distinct (flag, status, day) proofs of each supplier, in order."""
    own = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").cast("string").alias("day")).distinct()
    return bounded(own, "l_suppkey", ["l_returnflag", "l_linestatus", "day"], 5)


def proofs_in_turn(spark: Spark, sf_dir: str) -> DataFrame:
    """16 proofs of the first twelve orders: the first line of each, then the second, without repeats."""
    line = table(spark, sf_dir, "lineitem")
    items = table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(12).select("o_orderkey")
    own = line.join(F.broadcast(items), F.col("l_orderkey") == F.col("o_orderkey"))
    return dealt_in_turn(own, "l_orderkey", "l_linenumber", "l_partkey", 16)


def slowest_events(spark: Spark, sf_dir: str) -> DataFrame:
    """The ten events of highest value."""
    own = table(spark, sf_dir, "events").where("value is not null").select("event_id", "event_type", "value")
    return own.orderBy(F.desc("value"), "event_id").limit(10)


def latest_reports(spark: Spark, sf_dir: str) -> DataFrame:
    """The latest event of each user and type, and how many it replaces."""
    own = table(spark, sf_dir, "events")
    return own.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), (F.count("*") - 1).alias("replaced"))


# -- verdicts -----------------------------------------------------------------------------------


def binding_coverage(spark: Spark, sf_dir: str) -> DataFrame:
    """Customers as endpoints, by segment: eligible, bound to an order, unknown, and the share bound."""
    ordered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(1))
    own = table(spark, sf_dir, "customer").join(ordered, "c_custkey", "left").groupBy("c_mktsegment")
    out = own.agg(F.count("*").alias("eligible"), F.count("has").alias("bound"))
    return out.withColumn("unknown", F.col("eligible") - F.col("bound")).withColumn("share", percent(F.col("bound"), F.col("eligible")))


def run_comparison(spark: Spark, sf_dir: str) -> DataFrame:
    """The orders of each customer in two halves of the calendar as runs: difference and reduction in
    percent of the earlier one, null where that is 0; comparable if both have orders."""
    late = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(~late).alias("base"), F.count_if(late).alias("current"))
    return own.select("o_custkey", "base", "current", (F.col("current") - F.col("base")).alias("delta"), percent(F.col("base") - F.col("current"), F.col("base")).alias("reduction"), ((F.col("base") > 0) & (F.col("current") > 0)).alias("comparable"))


def worst_status(spark: Spark, sf_dir: str) -> DataFrame:
    """The worst state of each customer's orders: F before O before P."""
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(rank).alias("r"))
    names = F.array(*map(F.lit, ("none", "pending", "warning", "failed")))
    return own.select("o_custkey", F.element_at(names, F.col("r") + 1).alias("worst"))


def verify_gate(spark: Spark, sf_dir: str) -> DataFrame:
    """Users with errors fail, those with views alone warn, others pass; strict mode fails warnings."""
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.coalesce(F.col("event_type") == "error", F.lit(False))).alias("bad"), F.bool_and(F.coalesce(F.col("event_type") == "view", F.lit(False))).alias("thin"))
    state = F.when(F.col("bad"), "fail").when(F.col("thin"), "warn").otherwise("pass")
    return own.select("user_id", state.alias("state"), (state == "fail").alias("blocks"), (state != "pass").alias("blocks_strict"))


def suite_coverage(spark: Spark, sf_dir: str) -> DataFrame:
    """Lines of an order as lines of a file, suites by flag: hits are the most of any suite; covered
    lines, all, and the share."""
    hits = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_returnflag").agg(F.count_if(F.col("l_quantity") > 45).alias("n"))
    line = hits.groupBy("l_suppkey", "l_linenumber").agg(F.max("n").alias("hits"))
    own = line.groupBy("l_suppkey").agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count("*").alias("total"))
    return own.withColumn("share", percent(F.col("covered"), F.col("total")))


def workspace_coverage(spark: Spark, sf_dir: str) -> DataFrame:
    """Shares of urgent orders by nation: a region has its nations' least, none if one of them has none."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    own = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(percent(F.count_if(F.col("o_orderpriority") == "1-URGENT"), F.count("*")).alias("share"))
    n = table(spark, sf_dir, "nation").join(own, "n_nationkey", "left").groupBy("n_regionkey")
    return n.agg(F.count("*").alias("projects"), F.when(F.count("share") == F.count("*"), F.min("share")).alias("share"))


def domain_coverage(spark: Spark, sf_dir: str) -> DataFrame:
    """Segments as domains in the state of their accounts: unknown without any, blocked if a tenth are
    overdrawn, partial if one is, covered otherwise."""
    own = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("low"))
    dim = spark.createDataFrame([(x,) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE")], "c_mktsegment string")
    own = dim.join(own, "c_mktsegment", "left")
    state = F.when(F.col("n").isNull(), "unknown").when(F.col("low") * 10 >= F.col("n"), "blocked").when(F.col("low") > 0, "partial").otherwise("covered")
    return own.select("c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def remediation_merge(spark: Spark, sf_dir: str) -> DataFrame:
    """Lines of one part as actions for it: that of the highest authority (bits for urgency, size and
    discount) wins, flags are united, the first line keeps the place."""
    bit = lambda c, n: F.when(c, n).otherwise(0)
    rank = bit(F.col("l_returnflag") == "R", 16) + bit(F.col("l_quantity") > 40, 8) + bit(F.col("l_discount") > 0.05, 4)
    own = table(spark, sf_dir, "lineitem").withColumn("authority", rank)
    key = F.struct("authority", -F.col("l_orderkey"), -F.col("l_linenumber"))
    return own.groupBy("l_partkey").agg(F.max_by("l_suppkey", key).alias("winner"), F.max("authority").alias("authority"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.min("l_orderkey").alias("first_order"))


def probe_summary(spark: Spark, sf_dir: str) -> DataFrame:
    """Events of each user as probes: raw counts by state, and distinct causes among the errors."""
    own = table(spark, sf_dir, "events").withColumn("key", F.get_json_object("props", "$.k"))
    return own.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "purchase").alias("passed"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct(F.when(F.col("event_type") == "error", F.col("key"))).alias("causes"))


def probe_freshness(spark: Spark, sf_dir: str) -> DataFrame:
    """By type, events within a day of the last one of all, older ones, and the oldest."""
    own = table(spark, sf_dir, "events")
    now = F.broadcast(own.agg(F.max("ts").alias("now")))
    old = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > 86400 * 1_000_000
    return own.join(now).groupBy("event_type").agg(F.count_if(~old).alias("fresh"), F.count_if(old).alias("stale"), F.min_by("event_id", F.struct("ts", "event_id")).alias("oldest"))


def scope_provenance(spark: Spark, sf_dir: str) -> DataFrame:
    """Sources of documents: languages of their own make them scoped, none aggregated, both mixed."""
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("lang").alias("own"), F.count_if(F.col("lang").isNull()).alias("shared"))
    kind = F.when((F.col("own") > 0) & (F.col("shared") > 0), "mixed").when(F.col("own") > 0, "scoped").when(F.col("shared") > 0, "aggregated").otherwise("unknown")
    return own.withColumn("provenance", kind)


def event_shapes(spark: Spark, sf_dir: str) -> DataFrame:
    """Rows of events that are well formed and not, by type: a value if and only if it is a purchase,
    and a readable key."""
    own = table(spark, sf_dir, "events")
    body = (F.col("event_type") == "purchase") == (F.coalesce(F.col("value"), F.lit(0.0)) > 0)
    key = F.get_json_object("props", "$.k").isNotNull()
    return own.groupBy("event_type").agg(F.count_if(body & key).alias("valid"), F.count_if(~(body & key)).alias("quarantined"))


def freshness_floor(spark: Spark, sf_dir: str) -> DataFrame:
    """Users whose last purchase is older than their last error: the evidence is stale."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", at)).alias("evidence"), F.max(F.when(F.col("event_type") == "error", at)).alias("impact"))
    state = F.when(F.col("evidence").isNull(), "missing").when(F.col("impact").isNull() | (F.col("evidence") >= F.col("impact")), "fresh").otherwise("stale")
    return own.select("user_id", state.alias("state"))


# -- hashes -------------------------------------------------------------------------------------


def fingerprint_tree(spark: Spark, sf_dir: str) -> DataFrame:
    """A fingerprint of each region's customers: rows of up to 1,000 successive keys are hashed
    together, then a nation's chunks by thousands, its thousands, and the region's nations."""
    row = F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"), 256)
    own = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = own.select("n_regionkey", "n_nationkey", F.floor(F.col("c_custkey") / 1_000_000).cast("long").alias("wide"), F.floor(F.col("c_custkey") / 1000).cast("long").alias("part"), F.col("c_custkey").alias("at"), row.alias("h"))
    keys = ["n_regionkey", "n_nationkey", "wide", "part"]
    for k in range(len(keys), 0, -1):  # at most 1,000 hashes meet, but for the widest of a nation
        together = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), ""), 256)
        own = own.groupBy(*keys[:k]).agg(together.alias("h")).withColumn("at", F.col(keys[k - 1]))
    return own.select("n_regionkey", F.col("h").alias("fingerprint"))


def _fingerprint_sql() -> str:
    keys = ["n_regionkey", "n_nationkey", "wide", "part"]
    sql = "SELECT n_regionkey, n_nationkey, CAST(c_custkey // 1000000 AS BIGINT) AS wide, CAST(c_custkey // 1000 AS BIGINT) AS part, c_custkey AS place, sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment)) AS h FROM customer JOIN nation ON c_nationkey = n_nationkey"
    for k in range(len(keys), 0, -1):
        sql = f"SELECT {', '.join(keys[:k])}, {keys[k - 1]} AS place, sha256(string_agg(h, '' ORDER BY place)) AS h FROM ({sql}) GROUP BY {', '.join(keys[:k])}"
    return f"SELECT n_regionkey, h AS fingerprint FROM ({sql})"


_ALL = (package_join, local_resolution, endpoint_reconciliation, first_existing, missing_dependencies, project_consumers, finding_subjects, manual_edges, scope_members,
        kind_selection, touching_relations, stratified_documents, edge_evidence, proofs_in_turn, slowest_events, latest_reports,
        binding_coverage, run_comparison, worst_status, verify_gate, suite_coverage, workspace_coverage, domain_coverage, remediation_merge, probe_summary, probe_freshness, scope_provenance, event_shapes, freshness_floor, fingerprint_tree)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "package_join": """SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst FROM part a JOIN part b ON b.p_brand = 'Brand#' || CAST(a.p_size AS VARCHAR) WHERE a.p_brand <> b.p_brand""",
    "local_resolution": """WITH n AS (SELECT s_nationkey, CAST(floor(s_acctbal / 1000) AS BIGINT) AS band, count(*) AS targets, min(s_suppkey) AS only_one FROM supplier GROUP BY 1, 2)
        SELECT c_custkey, CASE WHEN targets = 1 THEN only_one END AS local, coalesce(targets, 0) <> 1 AS external FROM customer LEFT JOIN n ON s_nationkey = c_nationkey AND band = CAST(floor(c_acctbal / 1000) AS BIGINT)""",
    "endpoint_reconciliation": """SELECT l_partkey, l_suppkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND bool_or(coalesce(l_returnflag <> 'R', false))""",
    "first_existing": """WITH c AS (SELECT c_custkey, unnest([c_custkey, (c_custkey * 7) % 1000, (c_custkey % 10) + 1]) AS k, unnest([0, 1, 2]) AS pos FROM customer)
        SELECT c_custkey, arg_min(s_suppkey, pos) AS target, min(pos) AS pos FROM c JOIN supplier ON s_suppkey = k GROUP BY 1""",
    "missing_dependencies": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "project_consumers": """WITH b AS (SELECT l_partkey, c_nationkey AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey UNION SELECT l_partkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
        SELECT l_partkey, count(*) AS consumers, min(nation) AS first_consumer FROM b GROUP BY 1""",
    "finding_subjects": """WITH p AS (SELECT lower(string_split(trim(p_name), ' ')[1]) AS subject, p_partkey, row_number() OVER (PARTITION BY lower(string_split(trim(p_name), ' ')[1]) ORDER BY p_partkey) AS nth FROM part)
        SELECT item_id, b.subject, count(p_partkey) AS resolved, min(p_partkey) AS first_root FROM (SELECT item_id, lower(string_split(trim(text), ' ')[1]) AS subject FROM benchmark) b LEFT JOIN p ON p.subject = b.subject AND nth <= 4 GROUP BY 1, 2""",
    "manual_edges": """SELECT DISTINCT l_partkey AS src, l_suppkey * 3 AS dst, l_returnflag AS kind FROM lineitem WHERE l_partkey <> l_suppkey * 3 AND l_returnflag IN ('A', 'N') AND l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey * 3 IN (SELECT p_partkey FROM part)""",
    "scope_members": """SELECT n_regionkey, count(DISTINCT l_partkey) AS parts, min(l_partkey) AS first_part FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
    "kind_selection": f"""WITH e AS ({ENTITY_SQL}), k AS (SELECT id, kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY label, id) AS INTEGER) AS nth FROM e)
        SELECT id, kind, nth FROM k WHERE nth <= 8 ORDER BY list_position(['supplier', 'region', 'nation', 'part', 'customer'], kind), nth LIMIT 30""",
    "touching_relations": "SELECT o_orderkey, o_custkey <= 100 AS touches FROM orders ORDER BY touches DESC NULLS LAST, o_orderkey LIMIT 128",
    "stratified_documents": """WITH d AS (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS nth, (SELECT greatest(1, least(25, 60 // count(DISTINCT lang))) FROM documents) AS least_each FROM documents WHERE lang IS NOT NULL)
        SELECT lang, doc_id, nth <= least_each AS guaranteed FROM d ORDER BY guaranteed DESC, doc_id, lang LIMIT 60""",
    "edge_evidence": """SELECT * FROM (SELECT l_suppkey, l_returnflag, l_linestatus, day, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_linestatus, day) AS INTEGER) AS nth FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day FROM lineitem)) WHERE nth <= 5""",
    "proofs_in_turn": """WITH o AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 12), l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS turn FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
        f AS (SELECT l_partkey AS proof, min({'turn': turn, 'item': l_orderkey}) AS first FROM l GROUP BY 1)
        SELECT proof, CAST(row_number() OVER (ORDER BY first, proof) AS INTEGER) AS place FROM f ORDER BY first, proof LIMIT 16""",
    "slowest_events": "SELECT event_id, event_type, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 10",
    "latest_reports": """SELECT user_id, event_type, arg_max(event_id, {'t': ts, 'i': event_id}) AS latest, count(*) - 1 AS replaced FROM events GROUP BY 1, 2""",
    "binding_coverage": f"""SELECT c_mktsegment, count(*) AS eligible, count(o) AS bound, count(*) - count(o) AS unknown, {PERCENT.format(a="count(o)", b="count(*)")} AS share FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey GROUP BY 1""",
    "run_comparison": f"""WITH r AS (SELECT o_custkey, count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS base, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS current FROM orders GROUP BY 1)
        SELECT o_custkey, base, current, current - base AS delta, {PERCENT.format(a="(base - current)", b="base")} AS reduction, base > 0 AND current > 0 AS comparable FROM r""",
    "worst_status": """SELECT o_custkey, ['none', 'pending', 'warning', 'failed'][max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END) + 1] AS worst FROM orders GROUP BY 1""",
    "verify_gate": """WITH s AS (SELECT user_id, CASE WHEN bool_or(coalesce(event_type = 'error', false)) THEN 'fail' WHEN bool_and(coalesce(event_type = 'view', false)) THEN 'warn' ELSE 'pass' END AS state FROM events GROUP BY 1)
        SELECT user_id, state, state = 'fail' AS blocks, state <> 'pass' AS blocks_strict FROM s""",
    "suite_coverage": f"""WITH h AS (SELECT l_suppkey, l_linenumber, l_returnflag, count(*) FILTER (l_quantity > 45) AS n FROM lineitem GROUP BY 1, 2, 3), l AS (SELECT l_suppkey, l_linenumber, max(n) AS hits FROM h GROUP BY 1, 2), s AS (SELECT l_suppkey, count(*) FILTER (hits > 0) AS covered, count(*) AS total FROM l GROUP BY 1)
        SELECT l_suppkey, covered, total, {PERCENT.format(a="covered", b="total")} AS share FROM s""",
    "workspace_coverage": f"""WITH c AS (SELECT c_nationkey, {PERCENT.format(a="count(*) FILTER (o_orderpriority = '1-URGENT')", b="count(*)")} AS share FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1)
        SELECT n_regionkey, count(*) AS projects, CASE WHEN count(share) = count(*) THEN min(share) END AS share FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY 1""",
    "domain_coverage": """WITH d AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NONE']) AS seg), c AS (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS low FROM customer GROUP BY 1)
        SELECT seg AS c_mktsegment, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'unknown' WHEN low * 10 >= n THEN 'blocked' WHEN low > 0 THEN 'partial' ELSE 'covered' END AS state FROM d LEFT JOIN c ON c_mktsegment = seg""",
    "remediation_merge": """WITH l AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_quantity > 40 THEN 8 ELSE 0 END + CASE WHEN l_discount > CAST(0.05 AS DOUBLE) THEN 4 ELSE 0 END AS authority FROM lineitem)
        SELECT l_partkey, arg_max(l_suppkey, {'a': authority, 'o': -l_orderkey, 'l': -l_linenumber}) AS winner, max(authority) AS authority, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, min(l_orderkey) AS first_order FROM l GROUP BY 1""",
    "probe_summary": """SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS passed, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') END) AS causes FROM events GROUP BY 1""",
    "probe_freshness": """WITH e AS (SELECT *, epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) > 86400000000 AS old FROM events)
        SELECT event_type, count(*) FILTER (NOT old) AS fresh, count(*) FILTER (old) AS stale, arg_min(event_id, {'t': ts, 'i': event_id}) AS oldest FROM e GROUP BY 1""",
    "scope_provenance": """WITH s AS (SELECT source, count(lang) AS own, count(*) FILTER (lang IS NULL) AS shared FROM documents GROUP BY 1)
        SELECT source, own, shared, CASE WHEN own > 0 AND shared > 0 THEN 'mixed' WHEN own > 0 THEN 'scoped' WHEN shared > 0 THEN 'aggregated' ELSE 'unknown' END AS provenance FROM s""",
    "event_shapes": """WITH e AS (SELECT event_type, (event_type = 'purchase') = (coalesce(value, 0) > 0) AND json_extract_string(props, '$.k') IS NOT NULL AS fine FROM events)
        SELECT event_type, count(*) FILTER (fine) AS valid, count(*) FILTER (NOT fine) AS quarantined FROM e GROUP BY 1""",
    "freshness_floor": """WITH e AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS evidence, max(ts) FILTER (event_type = 'error') AS impact FROM events GROUP BY 1)
        SELECT user_id, CASE WHEN evidence IS NULL THEN 'missing' WHEN impact IS NULL OR evidence >= impact THEN 'fresh' ELSE 'stale' END AS state FROM e""",
    "fingerprint_tree": _fingerprint_sql(),
}
