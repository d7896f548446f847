"""Queries with merges, joins and differences over orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import alnum, round_half_up, slug
from ..operators import changes, merge, search
from ..operators.occurrence import occurrences
from .tables import table

Spark = SparkSession


def _lines(spark: Spark, sf_dir: str) -> DataFrame:
    """Lines with their arrival order; lines that tie in order and number follow by part and supplier."""
    own = table(spark, sf_dir, "lineitem")
    return own.withColumn("seq", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))


def edge_merge_precedence(spark: Spark, sf_dir: str) -> DataFrame:
    """Part-supplier edges from three sources: A manual, N contract, R inferred."""
    source = F.when(F.col("l_returnflag") == "A", "manual").when(F.col("l_returnflag") == "N", "contract").otherwise("inferred")
    rank = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 2).otherwise(1)
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", source.alias("source"), rank.alias("rank"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("seq"))
    return merge.merge_edges(rows, ["l_partkey", "l_suppkey"])


def relation_trust_merge(spark: Spark, sf_dir: str) -> DataFrame:
    trust = F.when(F.col("l_returnflag") == "R", "ambiguous").otherwise("observed")
    confidence = F.when(F.col("l_linestatus") == "F", "medium").otherwise("low")
    rows = _lines(spark, sf_dir).select("l_partkey", F.col("l_suppkey").alias("provider"), trust.alias("trust"), confidence.alias("confidence"), "seq")
    return merge.merge_relations(rows, ["l_partkey"])


def attribute_conflicts(spark: Spark, sf_dir: str) -> DataFrame:
    """Attributes that orders claim of their customers: the first claim stays."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("seq"), F.explode(F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus")).alias("attribute", "value"))
    return merge.merge_attributes(rows)


def proof_upsert(spark: Spark, sf_dir: str) -> DataFrame:
    """The first order of each customer."""
    own = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return merge.first_by(own, ["o_custkey"], "o_orderkey").withColumn("first_order", F.col("o_orderkey"))


def severity_counts(spark: Spark, sf_dir: str) -> DataFrame:
    """Part names as subjects, types as severities, brands as versions known for sizes over 10."""
    own = table(spark, sf_dir, "part").withColumn("version", F.when(F.col("p_size") > 10, F.col("p_brand")))
    return merge.severities(own, "p_name", "p_type", "version", "p_partkey")


def pubsub_join(spark: Spark, sf_dir: str) -> DataFrame:
    """Consumer to publisher: segments that buy a brand and suppliers' nations that sell it."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    published = lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("p_size >= 45").select(F.col("s_nationkey").alias("publisher"), F.col("p_brand").alias("topic")).distinct()
    consumed = lines.where("p_size <= 5").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("consumer"), F.col("p_brand").alias("topic")).distinct()
    return consumed.join(published, "topic").groupBy("consumer", "publisher").agg(F.count("*").alias("topics"))


def env_theta_join(spark: Spark, sf_dir: str) -> DataFrame:
    """Part names, alphanumerics only, that contain a colour's slug: the first slug in order.  The slugs are
    the distinct first words of the names; names and slugs meet by pieces that they share."""
    part = table(spark, sf_dir, "part")
    slugs = part.select(slug(F.substring_index("p_name", " ", 1)).alias("slug")).distinct().where(F.length("slug") >= 3)
    names = part.select(F.col("p_name").alias("text_id"), alnum(F.col("p_name")).alias("text")).distinct()
    met = occurrences(names, slugs.select(F.col("slug").alias("pattern_id"), F.col("slug").alias("pattern")))
    return met.groupBy(F.col("text_id").alias("p_name")).agg(F.min("pattern_id").alias("target"), F.count("*").alias("claims"))


def prefix_owner_join(spark: Spark, sf_dir: str) -> DataFrame:
    """Pages and the longest of their path's ancestors that owns them: hosts, and folders of at least
    two pages.  Ancestors are exploded and met by equality."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    parts = F.split("path", "/")
    above = pages.select("page_id", "path", F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).alias("depth")).withColumn("owner", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    owners = above.groupBy("owner").agg(F.min("depth").alias("d"), F.count("*").alias("n")).where("d = 1 or n >= 2").select("owner")
    return above.join(owners, "owner").groupBy("page_id").agg(F.max_by("owner", "depth").alias("owner"))


def keyed_diff(spark: Spark, sf_dir: str) -> DataFrame:
    """Settled and open orders as two versions; urgent ones change their price, low ones their status."""
    o = table(spark, sf_dir, "orders")
    base = o.where("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus", "o_totalprice")
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when(F.col("o_orderpriority") == "5-LOW", "C").otherwise(F.col("o_orderstatus"))
    head = o.where("o_orderstatus <> 'F'").select("o_orderkey", status.alias("o_orderstatus"), price.alias("o_totalprice"))
    return changes.keyed_diff(base, head, "o_orderkey", ["o_orderstatus", "o_totalprice"])


def change_overlay(spark: Spark, sf_dir: str) -> DataFrame:
    """Risk of the change above for each market segment, with the customers one hop away."""
    diff = keyed_diff(spark, sf_dir)
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    own = diff.join(o, "o_orderkey").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("total"), F.count_if(F.col("change") == "removed").alias("removed"), F.count_distinct("o_custkey").alias("impacted"))
    return own.withColumn("risk", changes.overlay_risk(F.col("removed"), F.col("impacted"), F.col("total")))


def freshness_compare(spark: Spark, sf_dir: str) -> DataFrame:
    """Digest of each customer's orders now and without the urgent ones."""
    o = table(spark, sf_dir, "orders")

    def digests(df: DataFrame) -> DataFrame:
        return df.groupBy("o_custkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("o_orderkey"))).cast("array<string>"), ","), 256).alias("digest"))

    return changes.freshness(digests(o), digests(o.where("o_orderpriority <> '1-URGENT'")), "o_custkey", "digest")


def drift_delta(spark: Spark, sf_dir: str) -> DataFrame:
    """Pending orders of each customer as issues: those of priorities 1 and 2 against 4 and 5, as in the
    SQL twin; those of priority 3 are in neither version."""
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    count = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return changes.drift(count(pending.where("o_orderpriority in ('1-URGENT', '2-HIGH')")), count(pending.where("o_orderpriority in ('4-NOT SPECIFIED', '5-LOW')")), "o_custkey", "n")


def health_score(spark: Spark, sf_dir: str) -> DataFrame:
    """Line states of each supplier as probes: F passed, O open, R failed."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("total"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "R")).alias("passed"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "R")).alias("warned"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    rate = F.floor(F.try_divide(F.col("passed") * 100, F.col("total")) + 0.5)
    verdict = F.when(F.col("failed") * 3 > F.col("total"), "blocked").when(F.col("warned") > F.col("passed"), "attention").otherwise("passed")
    return own.select("l_suppkey", "total", "passed", "warned", "failed", rate.cast("long").alias("pass_rate"), verdict.alias("verdict"))


def release_score(spark: Spark, sf_dir: str) -> DataFrame:
    """Order states of each customer as release steps: F 1, O 0.6, P 0; 100 without any."""
    share = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.6).when(F.col("o_orderstatus") == "P", 0.0)
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(share).alias("s"), F.count(share).alias("n"))
    both = table(spark, sf_dir, "customer").select("c_custkey").join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", F.coalesce(F.floor(F.round(F.try_divide(F.col("s"), F.col("n")) * 100, 6) + 0.5), F.lit(100)).cast("long").alias("score"))


def kind_counts_zero_filled(spark: Spark, sf_dir: str) -> DataFrame:
    """Lines of every supplier and return flag, absent ones as 0."""
    lines = table(spark, sf_dir, "lineitem")
    every = table(spark, sf_dir, "supplier").select("s_suppkey").withColumn("kind", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"), F.lit("X"))))
    own = lines.groupBy(F.col("l_suppkey").alias("s_suppkey"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))
    return every.join(own, ["s_suppkey", "kind"], "left").na.fill(0, ["n"])


def coverage_rollup(spark: Spark, sf_dir: str) -> DataFrame:
    """Covered quantity (returned lines do not count) of each supplier, and the least of a nation."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)).alias("covered"))
    own = table(spark, sf_dir, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    percent = F.round(F.try_divide(F.least("covered", "total"), F.col("total")) * 100, 2)
    return own.groupBy("s_nationkey").agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"), F.when(F.count(percent) == F.count("*"), F.min(percent)).alias("least_percent"))


def causal_dedupe(spark: Spark, sf_dir: str) -> DataFrame:
    """Lines grouped by part and mode as findings of one cause: the worst, dearest, first stands for all."""
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    own = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.max_by("l_orderkey", F.struct(rank, F.col("l_extendedprice"), -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("representative"), F.count("*").alias("findings"), (F.count_distinct("l_linestatus") > 1).alias("contradiction")
    )
    return own


def remediation_order(spark: Spark, sf_dir: str) -> DataFrame:
    """Open lines of each supplier in order: priority of the order, part, line."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    own = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    nth = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("o_orderpriority", "l_partkey", "l_orderkey", "l_linenumber"))
    return own.select("l_suppkey", "l_orderkey", "l_linenumber", nth.alias("position"))


def top_lines(spark: Spark, sf_dir: str) -> DataFrame:
    """The eight dearest lines of each supplier."""
    own = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return search.per_owner(own, "l_suppkey", [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 8)


def verify_summary(spark: Spark, sf_dir: str) -> DataFrame:
    """Steps of each order: required lines (N, A) that are open block it, optional (R) ones need attention."""
    required, open_ = F.col("l_returnflag") != "R", F.col("l_linestatus") == "O"
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(required & open_).alias("blocking"), F.count_if(~required & open_).alias("optional"), F.count("*").alias("steps"))
    return own.withColumn("verdict", F.when(F.col("blocking") > 0, "blocked").when(F.col("optional") > 0, "needs-attention").otherwise("passed"))


def subgraph_gate(spark: Spark, sf_dir: str) -> DataFrame:
    """Nations by the orders of their customers: covered if all are settled, uncovered if some are
    open, unverifiable without any."""
    n, c, o = (table(spark, sf_dir, x) for x in ("nation", "customer", "orders"))
    own = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("n_nationkey").agg(F.count("o_orderkey").alias("steps"), F.count_if(F.col("o_orderstatus") != "F").alias("open"))
    return own.withColumn("gate", F.when(F.col("steps") == 0, "unverifiable").when(F.col("open") > 0, "uncovered").otherwise("covered"))


def analyze_score(spark: Spark, sf_dir: str) -> DataFrame:
    """100 less 28 for each urgent, 12 for each high and 3 for each medium pending order."""
    p = lambda x: F.count_if(F.col("o_orderpriority") == x)
    own = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(p("1-URGENT").alias("fail"), p("2-HIGH").alias("warn"), p("3-MEDIUM").alias("info"))
    return own.withColumn("score", F.greatest(F.lit(0), 100 - 28 * F.col("fail") - 12 * F.col("warn") - 3 * F.col("info")))


def contract_rules(spark: Spark, sf_dir: str) -> DataFrame:
    """Violations among parts: a name used twice, a size out of range, a price of 0 or less, and
    suppliers whose nation is unknown or whose balance is negative."""
    p, s, n = (table(spark, sf_dir, x) for x in ("part", "supplier", "nation"))
    rule = lambda df, code, key: df.select(F.lit(code).alias("code"), F.col(key).cast("string").alias("subject"))
    out = rule(p.groupBy("p_name").count().where("count > 1"), "name.duplicate", "p_name")
    out = out.unionByName(rule(p.where("p_size not between 1 and 45"), "size.range", "p_partkey")).unionByName(rule(p.where("p_retailprice <= 0"), "price.positive", "p_partkey"))
    out = out.unionByName(rule(s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_anti"), "nation.unknown", "s_suppkey"))
    return out.unionByName(rule(s.where("s_acctbal < 0"), "balance.negative", "s_suppkey"))


def dependency_impact(spark: Spark, sf_dir: str) -> DataFrame:
    """Suppliers by distinct parts and customers; mean line price rounded half up."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return own.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("out_degree"), F.count_distinct("o_custkey").alias("in_degree"), round_half_up(F.sum("l_quantity") / F.count("*")).alias("mean_quantity"))


QUERIES = {
    f.__name__: f
    for f in (edge_merge_precedence, relation_trust_merge, attribute_conflicts, proof_upsert, severity_counts, pubsub_join, env_theta_join, prefix_owner_join, keyed_diff, change_overlay, freshness_compare, drift_delta, health_score, release_score, kind_counts_zero_filled, coverage_rollup, causal_dedupe, remediation_order, top_lines, verify_summary, subgraph_gate, analyze_score, contract_rules, dependency_impact)
}

_SEQ = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
_DIFF = """base AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O'),
    head AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'C' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'F'),
    diff AS (
        SELECT coalesce(b.o_orderkey, h.o_orderkey) AS o_orderkey,
               CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN h.o_orderkey IS NULL THEN 'removed' WHEN b.o_orderstatus <> h.o_orderstatus OR b.o_totalprice <> h.o_totalprice THEN 'updated' END AS change,
               CASE WHEN b.o_orderkey IS NULL OR h.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.o_orderstatus <> h.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN b.o_totalprice <> h.o_totalprice THEN 'o_totalprice' END) END AS changed
        FROM base b FULL JOIN head h ON b.o_orderkey = h.o_orderkey)"""
ORACLE_SQL = {
    "edge_merge_precedence": """WITH rows AS (SELECT l_partkey, l_suppkey, l_orderkey * 1000 + l_linenumber AS seq,
            CASE l_returnflag WHEN 'A' THEN 'manual' WHEN 'N' THEN 'contract' ELSE 'inferred' END AS source, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS rank FROM lineitem),
        seen AS (SELECT *, max(rank) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top FROM rows)
        SELECT l_partkey, l_suppkey, CASE max(rank) WHEN 3 THEN 'manual' WHEN 2 THEN 'contract' ELSE 'inferred' END AS source, max(rank) AS rank, count(*) AS evidence FROM seen WHERE rank >= top GROUP BY 1, 2""",
    "relation_trust_merge": f"""WITH own AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS providers, max_by(l_returnflag, {_SEQ}) AS flag, max_by(l_linestatus, {_SEQ}) AS status FROM lineitem GROUP BY 1)
        SELECT l_partkey, providers, CASE WHEN flag = 'R' THEN 'ambiguous' WHEN providers >= 2 THEN 'corroborated' ELSE 'observed' END AS trust,
               CASE WHEN providers >= 2 AND flag <> 'R' THEN 'high' WHEN status = 'F' THEN 'medium' ELSE 'low' END AS confidence FROM own""",
    "attribute_conflicts": """WITH rows AS (SELECT o_custkey AS entity, 'priority' AS attribute, o_orderpriority AS value, o_orderkey AS seq FROM orders UNION ALL SELECT o_custkey, 'status', o_orderstatus, o_orderkey FROM orders)
        SELECT entity, attribute, min_by(value, seq) AS value, count(DISTINCT value) > 1 AS conflict FROM rows GROUP BY 1, 2""",
    "proof_upsert": "SELECT o_custkey, o_orderstatus, o_totalprice, o_orderkey AS first_order, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    "severity_counts": "SELECT lower(p_name) AS subject, min_by(p_brand, p_partkey) FILTER (WHERE p_size > 10) AS version, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS severities, count(*) AS n FROM part GROUP BY 1",
    "pubsub_join": """WITH lines AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
        published AS (SELECT DISTINCT s_nationkey AS publisher, p_brand AS topic FROM lines JOIN supplier ON l_suppkey = s_suppkey WHERE p_size >= 45),
        consumed AS (SELECT DISTINCT c_mktsegment AS consumer, p_brand AS topic FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE p_size <= 5)
        SELECT consumer, publisher, count(*) AS topics FROM consumed JOIN published USING (topic) GROUP BY 1, 2""",
    "env_theta_join": """WITH slugs AS (SELECT DISTINCT regexp_replace(lower(split_part(p_name, ' ', 1)), '[^a-z0-9]+', '-', 'g') AS slug FROM part), names AS (SELECT DISTINCT p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS env FROM part)
        SELECT p_name, min(slug) AS target, count(*) AS claims FROM names JOIN slugs ON length(slug) >= 3 AND contains(env, slug) GROUP BY 1""",
    "prefix_owner_join": """WITH paths AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS parts FROM pages),
        above AS (SELECT page_id, unnest(range(1, greatest(len(parts) - 1, 1) + 1)) AS depth, parts FROM paths),
        named AS (SELECT page_id, depth, array_to_string(parts[1:depth], '/') AS owner FROM above),
        owners AS (SELECT owner FROM named GROUP BY owner HAVING min(depth) = 1 OR count(*) >= 2)
        SELECT page_id, max_by(owner, depth) AS owner FROM named JOIN owners USING (owner) GROUP BY 1""",
    "keyed_diff": f"WITH {_DIFF} SELECT o_orderkey, change, changed FROM diff WHERE change IS NOT NULL",
    "change_overlay": f"""WITH {_DIFF}, own AS (SELECT c_mktsegment, count(*) AS total, count(*) FILTER (WHERE change = 'removed') AS removed, count(DISTINCT o_custkey) AS impacted
            FROM diff JOIN orders USING (o_orderkey) JOIN customer ON o_custkey = c_custkey WHERE change IS NOT NULL GROUP BY 1)
        SELECT *, CASE WHEN total = 0 THEN 'none' WHEN removed > 0 OR impacted >= 10 THEN 'high' WHEN impacted >= 5 OR total >= 5 THEN 'medium' ELSE 'low' END AS risk FROM own""",
    "freshness_compare": """WITH d AS (SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS now_, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (WHERE o_orderpriority <> '1-URGENT')) AS then_ FROM orders GROUP BY 1)
        SELECT o_custkey, CASE WHEN then_ IS NULL THEN 'added' WHEN now_ <> then_ THEN 'changed' ELSE 'fresh' END AS verdict FROM d""",
    "drift_delta": """WITH d AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS a, count(*) FILTER (WHERE o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')) AS b FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
        SELECT o_custkey, greatest(a - b, 0) AS new, greatest(b - a, 0) AS resolved, a - b AS net FROM d WHERE a + b > 0""",
    "health_score": """WITH d AS (SELECT l_suppkey, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'R') AS passed, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag <> 'R') AS warned, count(*) FILTER (WHERE l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1)
        SELECT *, CAST(floor(passed * 100 / total + 0.5) AS BIGINT) AS pass_rate, CASE WHEN failed * 3 > total THEN 'blocked' WHEN warned > passed THEN 'attention' ELSE 'passed' END AS verdict FROM d""",
    "release_score": """SELECT c_custkey, CAST(coalesce(floor(round(avg(CASE o_orderstatus WHEN 'F' THEN CAST(1.0 AS DOUBLE) WHEN 'O' THEN CAST(0.6 AS DOUBLE) WHEN 'P' THEN CAST(0 AS DOUBLE) END) * 100, 6) + 0.5), 100) AS BIGINT) AS score FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "kind_counts_zero_filled": "WITH k AS (SELECT s_suppkey, unnest(['A', 'N', 'R', 'X']) AS kind FROM supplier) SELECT s_suppkey, kind, count(l_orderkey) AS n FROM k LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = kind GROUP BY 1, 2",
    "coverage_rollup": """WITH lines AS (SELECT l_suppkey, sum(l_quantity) AS total, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS covered FROM lineitem GROUP BY 1),
        own AS (SELECT s_nationkey, covered, total, round(least(covered, total) / total * 100, 2) AS percent FROM supplier LEFT JOIN lines ON s_suppkey = l_suppkey)
        SELECT s_nationkey, sum(covered) AS covered, sum(total) AS total, CASE WHEN count(percent) = count(*) THEN min(percent) END AS least_percent FROM own GROUP BY 1""",
    "causal_dedupe": """SELECT l_partkey, max_by(l_orderkey, row(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END, l_extendedprice, -l_orderkey, -l_linenumber)) AS representative, count(*) AS findings, count(DISTINCT l_linestatus) > 1 AS contradiction FROM lineitem GROUP BY 1""",
    "remediation_order": "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY o_orderpriority, l_partkey, l_orderkey, l_linenumber) AS position FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O'",
    "top_lines": "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS nth FROM lineitem QUALIFY nth <= 8",
    "verify_summary": """WITH d AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'O') AS blocking, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS optional, count(*) AS steps FROM lineitem GROUP BY 1)
        SELECT *, CASE WHEN blocking > 0 THEN 'blocked' WHEN optional > 0 THEN 'needs-attention' ELSE 'passed' END AS verdict FROM d""",
    "subgraph_gate": """WITH d AS (SELECT n_nationkey, count(o_orderkey) AS steps, count(*) FILTER (WHERE o_orderstatus <> 'F') AS open FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
        SELECT *, CASE WHEN steps = 0 THEN 'unverifiable' WHEN open > 0 THEN 'uncovered' ELSE 'covered' END AS gate FROM d""",
    "analyze_score": """WITH d AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS fail, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS warn, count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS info FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
        SELECT *, greatest(0, 100 - 28 * fail - 12 * warn - 3 * info) AS score FROM d""",
    "contract_rules": """SELECT 'name.duplicate' AS code, p_name AS subject FROM part GROUP BY p_name HAVING count(*) > 1
        UNION ALL SELECT 'size.range', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size NOT BETWEEN 1 AND 45
        UNION ALL SELECT 'price.positive', CAST(p_partkey AS VARCHAR) FROM part WHERE p_retailprice <= 0
        UNION ALL SELECT 'nation.unknown', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)
        UNION ALL SELECT 'balance.negative', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0""",
    "dependency_impact": "SELECT l_suppkey, count(DISTINCT l_partkey) AS out_degree, count(DISTINCT o_custkey) AS in_degree, floor(sum(l_quantity) / count(*) * 1000 + 0.5) / 1000 AS mean_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
}
