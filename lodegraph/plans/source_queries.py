"""Extractors over pages: scripts as source files, folders as owned projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import settle
from ..sources import code, owners
from .tables import table

Spark = SparkSession
SCRIPT = r"(?s)<script[^>]*>(.*?)</script>"


def scripts(spark: Spark, sf_dir: str) -> DataFrame:
    """(project, path, content): the scripts inside pages as files of their hosts."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    own = table(spark, sf_dir, "pages").select(host.alias("project"), "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("n", "content"))
    return own.select("project", F.concat_ws("/", "page_id", F.concat(F.lit("script"), "n", F.lit(".js"))).alias("path"), "content")


def script_facts(spark: Spark, sf_dir: str) -> DataFrame:
    """What the scripts of pages import, define and route, all of it."""
    return code.facts(code.sources(scripts(spark, sf_dir)), most=None).select("project", "path", "kind", "line", "name", "detail")


def script_graph(spark: Spark, sf_dir: str) -> DataFrame:
    """The same as a graph: relations with the kinds and labels of what they lead to, and lines as proofs."""
    entities, relations, proofs = code.structure(scripts(spark, sf_dir), most=None)
    to = entities.select(F.col("id").alias("dst"), F.col("kind").alias("to_kind"), "label", "project")
    own = relations.withColumnRenamed("id", "relation").join(to, "dst").join(proofs.select(F.col("id").alias("proof"), "path", "line"), "proof")
    return own.select("relation", "kind", "confidence", "to_kind", "label", "project", "path", "line")


def page_owners(spark: Spark, sf_dir: str) -> DataFrame:
    """Domains as owners of the first folders that their pages lie in, and the pages below each, on whatever host."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]*/?", ""), "[?#].*$", "")
    host = F.regexp_extract("url", r"^[a-z]+://[^/?#]*?([^./?#:]+\.[^./?#:]+)(?:[:/?#]|$)", 1)
    pages = settle(table(spark, sf_dir, "pages").select("page_id", path.alias("root"), host.alias("host")))
    folders = pages.where(F.contains("root", F.lit("/"))).select("host", F.split_part("root", F.lit("/"), F.lit(1)).alias("folder")).distinct()
    lines = folders.groupBy("folder").agg(F.concat_ws(" ", F.array_sort(F.collect_set(F.concat(F.lit("@"), "host")))).alias("hosts"))
    lines = lines.select(F.lit("CODEOWNERS").alias("path"), F.col("folder").alias("line_no"), F.concat(F.lit("/"), "folder", F.lit("/* "), "hosts").alias("line"))
    met = owners.owned(owners.rules(lines), pages.select(F.col("page_id").alias("project"), "root"))
    return met.where("project is not null").select(F.col("project").alias("page_id"), "pattern", "owner")


QUERIES = {f.__name__: f for f in (script_facts, script_graph, page_owners)}

_FILES = """file AS (
    SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS project, page_id || '/script' || (i - 1) || '.js' AS path, s[i] AS content
    FROM (SELECT *, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS s FROM pages), unnest(range(1, len(s) + 1)) AS u(i)
), line AS (SELECT project, path, i AS line, l[i] AS code FROM (SELECT *, string_split_regex(content, '\\r?\\n') AS l FROM file), unnest(range(1, len(l) + 1)) AS u(i))"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _cases(patterns: list[tuple[str, str]]) -> str:
    """The first pattern with a name, as a struct."""
    one = lambda p: f"trim(regexp_extract(code, {_quoted(p)}, 1))"
    return "CASE " + " ".join(f"WHEN {one(p)} <> '' THEN {{'name': {one(p)}, 'detail': '{d}'}}" for p, d in patterns) + " END"


_FACTS = f"""{_FILES}, fact AS (
    SELECT project, path, kind, line, f.name AS name, f.detail AS detail FROM (
        SELECT project, path, line, 'import' AS kind, {_cases(code.SCRIPT_IMPORTS)} AS f FROM line
        UNION ALL SELECT project, path, line, 'symbol', {_cases(code.SYMBOLS)} FROM line
        UNION ALL SELECT project, path, line, 'route', {_cases(code.ROUTES)} FROM line WHERE NOT regexp_matches(ltrim(code), '^(//|/\\*|\\*)'))
    WHERE f IS NOT NULL)"""
_ID = lambda kind, key: f"'wkg:' || {kind} || ':' || left(sha256({kind} || chr(0) || {key}), 20)"
ORACLE_SQL = {
    # scripts of the pages have no comments
    "script_facts": f"WITH {_FACTS} SELECT project, path, kind, CAST(line AS INTEGER) AS line, name, detail FROM fact",
    "script_graph": f"""WITH {_FACTS}, row_ AS (
            SELECT 'contains' AS kind, 'high' AS confidence, 'project' AS a_kind, 'project:' || project AS a, 'file' AS to_kind, 'file:' || project || ':' || path AS b, path AS label, project, path, NULL AS line FROM (SELECT DISTINCT project, path FROM file)
            UNION ALL SELECT 'imports', 'medium', 'file', 'file:' || project || ':' || path, 'module', 'module:' || project || ':' || name, name, project, path, line FROM fact WHERE kind = 'import'
            UNION ALL SELECT 'defines', 'medium', 'file', 'file:' || project || ':' || path, 'symbol', 'symbol:' || project || ':' || path || ':' || detail || ':' || name, name, project, path, line FROM fact WHERE kind = 'symbol')
        SELECT {_ID("'relation'", f"{_ID('a_kind', 'a')} || chr(0) || kind || chr(0) || {_ID('to_kind', 'b')}")} AS relation, kind, confidence, to_kind, label, project, path, CAST(line AS INTEGER) AS line FROM row_""",
    "page_owners": r"""WITH page AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*/?', ''), '[?#].*$', '') AS root, regexp_extract(url, '^[a-z]+://[^/?#]*?([^./?#:]+\.[^./?#:]+)(?:[:/?#]|$)', 1) AS host FROM pages),
        rule AS (SELECT DISTINCT host, split_part(root, '/', 1) AS folder FROM page WHERE contains(root, '/'))
        SELECT page_id, '/' || folder || '/*' AS pattern, '@' || rule.host AS owner FROM rule JOIN page ON starts_with(root, folder)""",
}
