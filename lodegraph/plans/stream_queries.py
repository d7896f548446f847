"""Queries over streams and renderings of the trade graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..sources import render
from ..streaming import events as streams
from .graph_queries import Links
from .tables import TRADE_SQL, nations, table, trade

Spark = SparkSession


def _event_stream(spark: Spark, sf_dir: str) -> DataFrame:
    """The events as a stream of files; the glob also fits a table of one file."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _result(spark: Spark, stream: DataFrame, name: str) -> DataFrame:
    """The whole result of a stream, as of the last batch."""
    at = streams.shared_folder(spark, name)
    writer = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/rows"))
    streams.drained(writer, f"{at}/state")
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def burst_stream(spark: Spark, sf_dir: str) -> DataFrame:
    """Each user's bursts of events less than six hours apart, by a stream over the events."""
    own = _result(spark, streams.bursts(_event_stream(spark, sf_dir), "user_id", "ts", "6 hours"), "bursts")
    return own.select("user_id", "events", "first_event", "last_event")


def once_stream(spark: Spark, sf_dir: str) -> DataFrame:
    """Each event once, by a stream over the events sent twice."""
    events = _event_stream(spark, sf_dir).select("event_id", "ts", "event_type")
    at = streams.shared_folder(spark, "once")
    twice = streams.once(events.unionByName(events), "event_id", "ts", "60 days")
    streams.drained(twice.writeStream.format("parquet").option("path", f"{at}/rows"), f"{at}/state")
    return spark.read.schema(twice.schema).parquet(f"{at}/rows").select("event_id", "event_type")


def _named(spark: Spark, sf_dir: str, links: Links = trade) -> tuple[DataFrame, DataFrame]:
    n = lambda c: F.concat(F.lit("nation:"), F.col(c).cast("string"))
    return nations(spark, sf_dir).select(n("node").alias("id")), links(spark, sf_dir).select(n("src").alias("src"), n("dst").alias("dst"), F.lit("sells-to").alias("kind"))


def graph_dot(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    return render.dot(*_named(spark, sf_dir, links)).select("part", "line")


def graph_mermaid(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    return render.mermaid(*_named(spark, sf_dir, links)).select("part", "line")


def graph_graphml(spark: Spark, sf_dir: str, links: Links = trade) -> DataFrame:
    return render.graphml(*_named(spark, sf_dir, links)).select("part", "line")


_TERMS = search.query_terms("which customers of the part are blue")


def term_frequencies(spark: Spark, sf_dir: str) -> DataFrame:
    """Document frequencies of a question's terms among the parts' names."""
    own = search.frequencies(table(spark, sf_dir, "part"), _TERMS, "p_partkey", "p_name")
    return own.select("term", "df", F.round("idf", 6).alias("idf"))


def nearest_vectors(spark: Spark, sf_dir: str) -> DataFrame:
    """The five vectors most alike to the first one by cosine."""
    own = table(spark, sf_dir, "embeddings").where("embedding is not null")
    first = own.orderBy(F.asc_nulls_last("vec_id")).limit(1)
    return search.nearest(own, first, "vec_id", "embedding", 5).select("vec_id", F.round("similarity", 4).alias("similarity"))


def nearest_vectors_each(spark: Spark, sf_dir: str) -> DataFrame:
    """The five vectors most alike by cosine to each one whose id is divisible by 100."""
    own = table(spark, sf_dir, "embeddings").where("embedding is not null")
    found = search.nearest(own, own.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return found.select("query_id", "rank", "vec_id", F.round("similarity", 4).alias("similarity"))


QUERIES = {f.__name__: f for f in (burst_stream, once_stream, graph_dot, graph_mermaid, graph_graphml, term_frequencies, nearest_vectors, nearest_vectors_each)}

_NAMED = f"WITH {TRADE_SQL}, n AS (SELECT 'nation:' || n_nationkey AS id FROM nation), e AS (SELECT 'nation:' || src AS src, 'nation:' || dst AS dst FROM edge)"


def _values(part: int, lines: list[str]) -> str:
    return " ".join("UNION ALL SELECT {}, '{}'".format(part, x.replace("'", "''")) for x in lines)


_HAS = " UNION ALL ".join(
    f"SELECT '{t}' AS term, count(*) FILTER (WHERE list_bool_or(list_transform(t, lambda x: {f"starts_with(x, '{t}')" if len(t) >= 3 else f"x = '{t}'"}))) AS df, count(*) AS n FROM d" for t in _TERMS
)
ORACLE_SQL = {
    "burst_stream": """WITH g AS (SELECT user_id, event_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
        b AS (SELECT *, sum(CASE WHEN gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
        SELECT user_id, count(*) AS events, min(event_id) AS first_event, max(event_id) AS last_event FROM b GROUP BY user_id, burst""",
    "once_stream": "SELECT event_id, event_type FROM events",
    "graph_dot": f"""{_NAMED} SELECT 1 AS part, '  "' || id || '";' AS line FROM n UNION ALL SELECT 2, '  "' || src || '" -> "' || dst || '" [label="sells-to", style=solid];' FROM e
        {_values(0, ["digraph workspace {", "  rankdir=LR;", "  node [shape=box];"])} {_values(3, ["}"])}""",
    "graph_mermaid": f"""{_NAMED} SELECT 1 AS part, '  ' || replace(id, ':', '_') || '["' || id || '"]' AS line FROM n UNION ALL SELECT 2, '  ' || replace(src, ':', '_') || ' -->|sells-to| ' || replace(dst, ':', '_') FROM e
        {_values(0, ["flowchart LR"])}""",
    "graph_graphml": f"""{_NAMED} SELECT 1 AS part, '    <node id="' || id || '"/>' AS line FROM n UNION ALL SELECT 2, '    <edge source="' || src || '" target="' || dst || '"><data key="kind">sells-to</data></edge>' FROM e
        {_values(0, ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '  <key id="kind" for="edge" attr.name="kind" attr.type="string"/>', '  <graph edgedefault="directed">'])} {_values(3, ["  </graph>", "</graphml>"])}""",
    "term_frequencies": f"""WITH d AS (SELECT regexp_split_to_array(lower(p_name), '[^a-z0-9]+') || regexp_split_to_array(lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+') AS t FROM part), f AS ({_HAS})
        SELECT term, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM f""",
    "nearest_vectors": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT e AS q FROM v ORDER BY vec_id LIMIT 1)
        SELECT vec_id, round(round(list_cosine_similarity(e, q), 6), 4) AS similarity FROM v, q ORDER BY round(list_cosine_similarity(e, q), 6) DESC, vec_id LIMIT 5""",
    "nearest_vectors_each": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS similarity FROM v AS q JOIN v ON len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, round(similarity, 4) AS similarity FROM r WHERE rank <= 5""",
}
