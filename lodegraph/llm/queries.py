"""The registered queries opN_<name>: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counting, fingerprints, language, lm, negatives, packing, quality, resampling, sharding, simhash, suffix, topk
from .blocks import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.nearest(rows, rows.where("vec_id % 50 = 0"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_interleaved_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.mined(rows, rows.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_order_minhash": op9_order_minhash,
    "op10_token_counts": op10_token_counts,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_interleaved_sharding": op12_interleaved_sharding,
    "op13_hard_negatives": op13_hard_negatives,
}


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of the UTF-8 bytes of a text, in halves of bytes."""
    steps = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        steps.append(x)
    half = lambda c, n: f"xor(({c}) >> 4, CAST({steps} AS BIGINT[])[(xor({c}, {n}) & 15) + 1])"
    codes = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {half(half('c', 'b & 15'), '(b >> 4)')}, 4294967295::BIGINT), 4294967295)"


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The others cannot be expressed in SQL.
ORACLE_SQL: dict[str, str] = {
    "op7_exact_top_k": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND list_count(embedding) = len(embedding)
              AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_importance_resampling": f"""
        WITH own AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
        word AS (SELECT row, unnest(words) AS w FROM own), aim AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
        crc AS (SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT w FROM word UNION SELECT w FROM aim)),
        source AS (SELECT bucket, count(*) AS n FROM word JOIN crc USING (w) GROUP BY 1),
        target AS (SELECT bucket, count(*) AS n FROM aim JOIN crc USING (w) GROUP BY 1),
        total AS (SELECT CAST((SELECT count(*) FROM word) AS DOUBLE) AS s, CAST((SELECT count(*) FROM aim) AS DOUBLE) AS t),
        gain AS (
            SELECT bucket, floor(1000 * ln((coalesce(b.n, 0) + 1.0::DOUBLE) * (s + 10000) / ((a.n + 1.0::DOUBLE) * (t + 10000)))) AS g
            FROM source a LEFT JOIN target b USING (bucket), total
        ), mean AS (SELECT row, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM word JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY 1),
        scored AS (
            SELECT doc_id, coalesce(len(words), 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM own LEFT JOIN mean USING (row)
        ), may AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM may
        UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
    """,
    "op12_interleaved_sharding": f"""
        WITH own AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce({_crc32("text")}, 0) AS text_crc32,
                   coalesce('=' || source, '') AS source, substr(sha256('2024:' || doc_id), 1, 15) AS h FROM documents
        ), ranked AS (
            SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32)
                       - (CAST('0x' || substr(sha256('2024:' || source), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296) / count(*) OVER (PARTITION BY source) AS f FROM own
        ), placed AS (SELECT *, row_number() OVER (ORDER BY f, source) - 1 AS place, count(*) OVER () AS n FROM ranked)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(place * 8 // n AS INTEGER) AS shard,
               place - ((place * 8 // n) * n + 7) // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
    """,
    "op13_hard_negatives": """
        WITH whole AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND list_count(embedding) = len(embedding)
              AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
            WHERE q.vec_id % 100 = 0
        ), positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), ranked AS (
            SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id AS negative_id, positive_score, score AS negative_score
            FROM positive JOIN scored USING (anchor_id)
            WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
    """,
}
