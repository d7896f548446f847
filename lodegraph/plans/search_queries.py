"""Ranked search over the entities of the star schema, with its DuckDB twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import ranking
from ..operators.lineage import stored
from .tables import ENTITIES, table

QUESTION = "Which nation 1 does the part of red steel go to?"
NAMED = "Supplier#000000003"


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their keys as identities, and kind and number as an alias."""
    out = None
    for kind, name, key, label in ENTITIES:
        number = F.col(key).cast("string")
        own = table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}:"), number).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"), F.concat(F.lit(f"{kind}:"), number).alias("key"), F.array(F.concat(F.lit(f"{kind} "), number)).alias("aliases"))
        out = own if out is None else out.unionByName(own)
    return out


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve entities that answer a question best."""
    return ranking.ranked(searchable(spark, sf_dir), QUESTION)


def named_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity named as it is comes before all others."""
    return ranking.ranked(searchable(spark, sf_dir), NAMED, 5)


def diversified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred entities that answer a question, two of each kind and of unlike labels first."""
    return ranking.diversified(ranking.ranked(searchable(spark, sf_dir), QUESTION, 100)).select("pick", "id", "place")


def search_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of the best answers: of each the first four, all together 24."""
    line = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("dst"))
    relations = line.union(nation).withColumn("id", F.concat("src", F.lit(">"), "dst"))
    return ranking.expanded(relations, ranking.ranked(searchable(spark, sf_dir), QUESTION))


def _ranked_sql(question: str, limit: int, some: str = "", gain: str = "0", extra: str = "false") -> str:
    query, terms = question.strip().lower(), ranking.question_terms(question)
    some = some or " UNION ALL ".join(f"SELECT '{kind}:' || CAST({key} AS VARCHAR) AS id, '{kind}' AS kind, {label} AS label, '{kind} ' || CAST({key} AS VARCHAR) AS alias FROM {name}" for kind, name, key, label in ENTITIES)

    def words(x: str) -> str:
        return f"list_filter(list_concat(regexp_extract_all(lower({x}), '[a-z0-9]+'), regexp_extract_all(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')), lambda t: len(t) > 1)"

    def has(held: str, t: str) -> str:
        return f"len(list_filter({held}, lambda x: {f'starts_with(x, {t!r})' if len(t) >= 3 else f'x = {t!r}'})) > 0"

    hit = ", ".join(f"{has(c, t)} AS {c}{k}" for k, t in enumerate(terms) for c in ("lt", "it", "att", "ht"))
    one = ", ".join(f"(lt{k} OR it{k} OR att{k} OR ht{k}) AS any{k}" for k in range(len(terms)))
    idf = ", ".join(f"ln((count(*) + 1) / (count(*) FILTER (any{k}) + 1)) + 1 AS w{k}" for k in range(len(terms)))
    score = f"CASE WHEN l = {query!r} OR i = {query!r} OR a = {query!r} THEN {ranking.EXACT} ELSE 0 END + CASE WHEN starts_with(l, {query!r}) OR starts_with(i, {query!r}) THEN {ranking.PREFIX} ELSE 0 END + CASE WHEN contains(h, {query!r}) THEN {ranking.HAYSTACK} ELSE 0 END"
    for k, t in enumerate(terms):
        score += f" + CASE WHEN l = {t!r} THEN {ranking.SAME_LABEL} * w{k} WHEN lt{k} THEN {ranking.LABEL} * w{k} ELSE 0 END + CASE WHEN it{k} THEN {ranking.IDENTITY} * w{k} ELSE 0 END + CASE WHEN att{k} THEN {ranking.ALIAS} * w{k} ELSE 0 END + CASE WHEN any{k} THEN {ranking.ANY} * w{k} ELSE 0 END"
    matched = " + ".join(f"CAST(any{k} AS INTEGER)" for k in range(len(terms)))
    return f"""SELECT id, kind, label, score, matched, CAST(row_number() OVER (ORDER BY score DESC, kind, label, id) AS INTEGER) AS place FROM (
        WITH e AS ({some}), d AS (SELECT id, kind, label, lower(trim(label)) AS l, lower(trim(id)) AS i, lower(trim(alias)) AS a, lower(concat_ws(' ', kind, label, id, alias)) AS h, {gain} AS gain, {words("label")} AS lt, {words("id")} AS it, {words("alias")} AS att FROM e),
        t AS (SELECT *, {words("h")} AS ht FROM d), m AS (SELECT *, {hit} FROM t), n AS (SELECT *, {one} FROM m), w AS (SELECT {idf} FROM n)
        SELECT id, kind, label, round({score} + CAST({matched} AS DOUBLE) / {len(terms)} * {ranking.ALL_TERMS} + gain, 6) AS score, {matched} AS matched FROM n, w)
        WHERE score > 0 AND (matched >= {ranking.least_matches(terms)} OR {extra}) ORDER BY place LIMIT {limit}"""


QUERIES = {f.__name__: f for f in (ranked_search, named_search, diversified_search, search_relations)}
ORACLE_SQL = {
    "ranked_search": _ranked_sql(QUESTION, 12),
    "named_search": _ranked_sql(NAMED, 5),
    "diversified_search": f"""WITH r AS ({_ranked_sql(QUESTION, 100)}), f AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY place) = 1 AS fresh FROM r),
        k AS (SELECT *, coalesce(fresh AND row_number() OVER (PARTITION BY kind, fresh ORDER BY place) <= 2, false) AS lead_in FROM f)
        SELECT CAST(row_number() OVER (ORDER BY lead_in DESC, place) AS INTEGER) AS pick, id, place FROM k""",
    "search_relations": f"""WITH r AS ({_ranked_sql(QUESTION, 12)}), e AS (SELECT DISTINCT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
        o AS (SELECT src || '>' || dst AS id, src, dst, CASE WHEN src IN (SELECT id FROM r) THEN src WHEN dst IN (SELECT id FROM r) THEN dst END AS owner FROM e)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY owner ORDER BY id) AS INTEGER) AS nth FROM o WHERE owner IS NOT NULL) WHERE nth <= 4 ORDER BY id LIMIT 24""",
}


def name_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name with its hash and the vector of four numbers that the hash seeds."""
    own = table(spark, sf_dir, "part").select("p_name").where("p_name is not null").distinct()
    own = own.withColumn("hash", values.string_hash(F.col("p_name"))).withColumn("v", values.mock_embedding(F.col("p_name"), 4))
    return own.select("p_name", "hash", *(F.round(F.col("v")[k], 6).alias(f"v{k}") for k in range(4)))


QUERIES |= {"name_vectors": name_vectors}
_STEP = "((({x}) * 1664525 + 1013904223 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"
_SEEDS = ", ".join(f"s{k} AS (SELECT *, {_STEP.format(x=f'h{k}')} AS h{k + 1} FROM {f's{k - 1}' if k else 'h'})" for k in range(4))
_UNIT = ", ".join(f"round((h{k + 1} / 4294967295 * 2 - 1) / sqrt({' + '.join(f'(h{j + 1} / 4294967295 * 2 - 1) ** 2' for j in range(4))}), 6) AS v{k}" for k in range(4))
ORACLE_SQL |= {
    # names are plain letters: one unit of UTF-16 each
    "name_vectors": f"""WITH n AS (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL),
        h AS (SELECT p_name, list_reduce(list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT) AS h0 FROM n),
        {_SEEDS} SELECT p_name, CAST(h0 AS INTEGER) AS hash, {_UNIT} FROM s3""",
}


#: A question that asks for four aspects of a system, one of two terms that asks for owners, and a scope.
BROAD = "Which language, owner and service does the documentation of the red ring name?"
SHORT = "owners"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages, documents, parts and customers tell as entities: languages with the number of their texts, services
    (hosts), documents (pages, of their host's project), packages (parts), owners (customers) and projects (hosts)."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string")

    def kind(rows: DataFrame, kind: str, key: str, label: str, project: Column = none, files: Column = F.lit(None).cast("long")) -> DataFrame:
        key = F.col(key).cast("string")
        return rows.select(F.concat(F.lit(f"{kind}:"), key).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"), F.concat(F.lit(f"{kind}:"), key).alias("key"), F.array(F.concat(F.lit(f"{kind} "), key)).alias("aliases"), project.alias("project"), files.alias("file_count"))

    pages = t("pages").select("page_id", "url", host.alias("host"))
    hosts = pages.select("host").where("host <> ''").distinct()
    parts = [
        kind(t("documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")), "language", "lang", "lang", files=F.col("n")),
        kind(pages, "document", "page_id", "url", F.col("host")), kind(hosts, "service", "host", "host", F.col("host")), kind(hosts, "project", "host", "host", F.col("host")),
        kind(t("part"), "package", "p_partkey", "p_name"), kind(t("customer"), "owner", "c_custkey", "c_name"),
    ]
    return reduce(DataFrame.unionByName, parts)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, src, dst): projects to the languages of their pages, and services to their documents."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("html", '<html[^>]* lang="([a-z]+)"', 1).alias("lang")).where("host <> ''")
    spoken = pages.where("lang <> ''").select(F.concat(F.lit("project:"), "host").alias("src"), F.concat(F.lit("language:"), "lang").alias("dst")).distinct()
    held = pages.select(F.concat(F.lit("service:"), "host").alias("src"), F.concat(F.lit("document:"), F.col("page_id").cast("string")).alias("dst"))
    return spoken.union(held).withColumn("id", F.concat("src", F.lit(">"), "dst"))


def intent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred entities that answer a broad question best, kinds that it asks for among them."""
    return ranking.ranked(catalogue(spark, sf_dir), BROAD, 100)


def owner_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of one term that asks for a kind: its entities match though none has the term."""
    return ranking.ranked(catalogue(spark, sf_dir), SHORT, 30)


def broad_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to the broad question: two of each kind and of unlike labels lead, chosen from all matches."""
    return ranking.answered(stored(ranking.matches(catalogue(spark, sf_dir), BROAD)), 24).select("pick", "id", "kind", "label", "score")


def answer_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that question's first hundred entities bring along, within and beyond the budget of an answer."""
    own = catalogue(spark, sf_dir)
    found = stored(ranking.matches(own, BROAD))
    return ranking.budgeted(found, page_links(spark, sf_dir), own, stored(ranking.placed(found, 100)))


def project_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of the project with the first host in order, and shared ones that it is related to, in an overview's order:
    a question that is the scope's name."""
    own = catalogue(spark, sf_dir)
    host = own.where("kind = 'project'").agg(F.min("label")).head()[0] or "none"
    return ranking.ranked(ranking.scoped(own, page_links(spark, sf_dir), host), host, 100, scope=host).select("place", "id", "kind", "label", "score")


QUERIES |= {f.__name__: f for f in (intent_search, owner_search, broad_answer, answer_budget, project_overview)}
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_CATALOGUE = f"""SELECT 'language:' || lang AS id, 'language' AS kind, lang AS label, 'language ' || lang AS alias, NULL AS project, count(*) AS files FROM documents WHERE lang IS NOT NULL GROUP BY lang
    UNION ALL SELECT 'document:' || page_id, 'document', url, 'document ' || page_id, {_HOST}, NULL FROM pages
    UNION ALL SELECT DISTINCT k || ':' || {_HOST}, k, {_HOST}, k || ' ' || {_HOST}, {_HOST}, NULL FROM pages, (VALUES ('service'), ('project')) v(k) WHERE {_HOST} <> ''
    UNION ALL SELECT 'package:' || p_partkey, 'package', p_name, 'package ' || p_partkey, NULL, NULL FROM part
    UNION ALL SELECT 'owner:' || c_custkey, 'owner', c_name, 'owner ' || c_custkey, NULL, NULL FROM customer"""
_LINKS = f"""SELECT DISTINCT 'project:' || {_HOST} AS src, 'language:' || regexp_extract(html, '<html[^>]* lang="([a-z]+)"', 1) AS dst FROM pages WHERE {_HOST} <> '' AND regexp_extract(html, '<html[^>]* lang="([a-z]+)"', 1) <> ''
    UNION ALL SELECT 'service:' || {_HOST}, 'document:' || page_id FROM pages WHERE {_HOST} <> ''"""
_BROAD_GAIN = "CASE kind WHEN 'language' THEN 900 + least(files, 10000) / 10.0 WHEN 'owner' THEN 850 WHEN 'document' THEN 725 WHEN 'service' THEN 700 ELSE 0 END"
_ORDER = "score DESC, kind COLLATE en, label COLLATE en, id COLLATE en, id"


def _intent_sql(question: str, limit: int, gain: str) -> str:
    return _ranked_sql(question, limit, _CATALOGUE, gain, "gain > 0").replace("SELECT id, kind, label, round(", "SELECT id, kind, label, gain, round(").replace("ORDER BY score DESC, kind, label, id)", f"ORDER BY {_ORDER})")


ORACLE_SQL |= {
    "intent_search": _intent_sql(BROAD, 100, _BROAD_GAIN),
    "owner_search": _intent_sql(SHORT, 30, "CASE kind WHEN 'owner' THEN 850 ELSE 0 END"),
    "project_overview": f"""WITH e AS ({_CATALOGUE}), r AS ({_LINKS}), h AS (SELECT min(label) AS host FROM e WHERE kind = 'project'),
        s AS (SELECT e.* FROM e, h WHERE project = host OR (project IS NULL AND id IN (SELECT dst FROM r, h WHERE src = 'project:' || host))),
        p AS (SELECT id, kind, label, CASE kind WHEN 'project' THEN 1000.0 WHEN 'service' THEN 900.0 WHEN 'package' THEN 850.0 WHEN 'owner' THEN 500.0 WHEN 'document' THEN 400.0 END::DOUBLE AS score FROM s)
        SELECT CAST(row_number() OVER (ORDER BY {_ORDER}) AS INTEGER) AS place, id, kind, label, score FROM p WHERE score > 0 ORDER BY place LIMIT 100""",
}
ORACLE_SQL["answer_budget"] = f"""WITH e AS ({_CATALOGUE}), l AS ({_LINKS}), f AS ({_intent_sql(BROAD, 100, _BROAD_GAIN)}), a AS ({_intent_sql(BROAD, 1_000_000_000, _BROAD_GAIN)}),
    o AS (SELECT src || '>' || dst AS id, src, dst, CASE WHEN src IN (SELECT id FROM f) THEN src WHEN dst IN (SELECT id FROM f) THEN dst END AS owner FROM l),
    n AS (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY id) AS nth FROM o WHERE owner IS NOT NULL) WHERE nth <= 4),
    k AS (SELECT count(*) AS related FROM (SELECT src AS id FROM n WHERE pos <= 24 UNION SELECT dst FROM n WHERE pos <= 24) WHERE id NOT IN (SELECT id FROM f) AND id IN (SELECT id FROM e)),
    c AS (SELECT (SELECT count(*) FROM a) AS total_matches, (SELECT count(*) FROM f) AS entities, (SELECT count(*) FROM n) AS r, related AS q FROM k)
    SELECT total_matches, entities, least(r, 24) AS relations, r - least(r, 24) AS omitted_relations, least(q, 24) AS related, q - least(q, 24) AS omitted_related, 0::BIGINT AS omitted_aliases,
        total_matches > entities OR r > 24 OR q > 24 AS truncated FROM c"""
