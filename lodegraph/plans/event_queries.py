"""Queries over events, conversations, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SECRET, estimated_tokens
from ..operators import changes, merge, search
from .tables import table

Spark = SparkSession


def evaluation_summary(spark: Spark, sf_dir: str) -> DataFrame:
    """Turns of each role: calls, estimated tokens, and empty ones."""
    own = table(spark, sf_dir, "conversations")
    return own.groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.coalesce(estimated_tokens(F.col("text")), F.lit(0))).alias("tokens"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("no_progress"))


def user_outcomes(spark: Spark, sf_dir: str) -> DataFrame:
    """Each user's counts by event type, value, repeated keys read and last event."""
    own = table(spark, sf_dir, "events").withColumn("key", F.get_json_object("props", "$.k"))
    reads = own.groupBy("user_id", "key").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.sum(F.col("n") - 1).alias("repeated"))
    kinds = [F.count_if(F.col("event_type") == k).alias(k) for k in ("signup", "purchase", "error", "view", "click")]
    last = F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event")
    return own.groupBy("user_id").agg(*kinds, F.round(F.sum("value"), 4).alias("value"), last).join(reads, "user_id")


def dedupe_events(spark: Spark, sf_dir: str) -> DataFrame:
    """One event of each user, type and key: the first."""
    own = table(spark, sf_dir, "events").withColumn("key", F.get_json_object("props", "$.k")).select("user_id", "event_type", "key", "event_id", "ts")
    return merge.first_by(own.withColumn("seq", F.struct("ts", "event_id")), ["user_id", "event_type", "key"]).drop("ts", "seq")


def debounce_sessions(spark: Spark, sf_dir: str) -> DataFrame:
    """Each user's bursts of events that are at most six hours apart."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = table(spark, sf_dir, "events").withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order))
    own = own.withColumn("burst", F.sum(F.when(F.col("gap") > 6 * 3600 * 1_000_000, 1).otherwise(0)).over(order))
    return own.groupBy("user_id", "burst").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def history_ring(spark: Spark, sf_dir: str) -> DataFrame:
    """The last fifty events of each user."""
    own = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return search.per_owner(own, "user_id", [F.desc("ts"), F.desc("event_id")], 50).select("user_id", "event_id", "event_type", "nth")


def fact_freshness(spark: Spark, sf_dir: str) -> DataFrame:
    """Events as facts with a time to live by type, at the time of the last event: counts by type."""
    own = table(spark, sf_dir, "events")
    ttl = F.when(F.col("event_type") == "signup", 30 * 86400).when(F.col("event_type") == "purchase", 7 * 86400).when(F.col("event_type") == "error", 86400).when(F.col("event_type") == "view", 300)
    now = F.broadcast(own.agg(F.max("ts").alias("now")))
    status = own.join(now).select("event_type", changes.expired(F.col("ts"), ttl, F.col("now")).alias("status"))
    return status.groupBy("event_type", "status").agg(F.count("*").alias("n"))


def token_efficiency(spark: Spark, sf_dir: str) -> DataFrame:
    """Estimated tokens of each source's documents, and what reading only those of 500 or fewer saves."""
    own = table(spark, sf_dir, "documents").select("source", estimated_tokens(F.col("text")).alias("t"))
    own = own.groupBy("source").agg(F.sum("t").alias("corpus"), F.sum(F.when(F.col("t") <= 500, F.col("t")).otherwise(0)).alias("read"))
    return own.select("source", "corpus", "read", F.greatest(F.col("corpus") - F.col("read"), F.lit(0)).alias("avoided"), F.round(F.try_divide(F.col("corpus"), F.col("read")), 2).alias("ratio"))


def secret_scan(spark: Spark, sf_dir: str) -> DataFrame:
    """Documents that hold a key of a published format; letters count as they are."""
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(SECRET)).select("doc_id")


def precision_recall(spark: Spark, sf_dir: str) -> DataFrame:
    """Texts of a thousand characters and more predicted as good, against their labels, by language."""
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id").where("quality is not null")
    yes, good = F.length("text") >= 1000, F.col("quality") == 1
    own = own.groupBy("lang").agg(F.count_if(yes & good).alias("tp"), F.count_if(yes & ~good).alias("fp"), F.count_if(~yes & good).alias("fn"), F.count_if(~yes & ~good).alias("tn"))
    return own.withColumns({"precision": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 4), "recall": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 4)})


QUERIES = {f.__name__: f for f in (evaluation_summary, user_outcomes, dedupe_events, debounce_sessions, history_ring, fact_freshness, token_efficiency, secret_scan, precision_recall)}

_KEY = "json_extract_string(props, '$.k')"
ORACLE_SQL = {
    "evaluation_summary": "SELECT role, count(*) AS calls, sum(coalesce(CAST(ceil(length(text) / 4) AS BIGINT), 0)) AS tokens, count(*) FILTER (WHERE coalesce(length(text), 0) = 0) AS no_progress FROM conversations GROUP BY 1",
    "user_outcomes": f"""WITH reads AS (SELECT user_id, sum(n - 1) AS repeated FROM (SELECT user_id, {_KEY} AS k, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)
        SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'error') AS error,
               count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, round(sum(value), 4) AS value, max_by(event_type, row(ts, event_id)) AS last_event, any_value(repeated) AS repeated
        FROM events JOIN reads USING (user_id) GROUP BY 1""",
    "dedupe_events": f"SELECT user_id, event_type, {_KEY} AS key, min_by(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY 1, 2, 3",
    "debounce_sessions": """WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
        b AS (SELECT *, sum(CASE WHEN gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
        SELECT user_id, burst, count(*) AS events, min(event_id) AS first_event, max(event_id) AS last_event FROM b GROUP BY 1, 2""",
    "history_ring": "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events QUALIFY nth <= 50",
    "fact_freshness": """WITH f AS (SELECT event_type, ts, CASE event_type WHEN 'signup' THEN 2592000 WHEN 'purchase' THEN 604800 WHEN 'error' THEN 86400 WHEN 'view' THEN 300 END AS ttl, (SELECT max(ts) FROM events) AS now_ FROM events)
        SELECT event_type, CASE WHEN ts IS NULL OR ttl IS NULL THEN 'unknown' WHEN epoch_us(now_) > epoch_us(ts) + CAST(ttl AS BIGINT) * 1000000 THEN 'stale' ELSE 'fresh' END AS status, count(*) AS n FROM f GROUP BY 1, 2""",
    "token_efficiency": """WITH d AS (SELECT source, CAST(ceil(length(text) / 4) AS BIGINT) AS t FROM documents), s AS (SELECT source, sum(t) AS corpus, sum(CASE WHEN t <= 500 THEN t ELSE 0 END) AS read FROM d GROUP BY 1)
        SELECT source, corpus, read, greatest(corpus - read, 0) AS avoided, round(corpus / nullif(read, 0), 2) AS ratio FROM s""",
    "secret_scan": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{SECRET}')",
    "precision_recall": """WITH d AS (SELECT lang, length(text) >= 1000 AS yes, quality = 1 AS good FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
        c AS (SELECT lang, count(*) FILTER (WHERE yes AND good) AS tp, count(*) FILTER (WHERE yes AND NOT good) AS fp, count(*) FILTER (WHERE NOT yes AND good) AS fn, count(*) FILTER (WHERE NOT yes AND NOT good) AS tn FROM d GROUP BY 1)
        SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM c""",
}
