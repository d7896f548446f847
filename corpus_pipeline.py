"""The corpus pipeline: classify, identify, deduplicate, cut repeats, pack.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on all
that the stage before it kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from lodegraph.llm import language, packing, quality, simhash, suffix
from lodegraph.llm.blocks import durable, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier scores 0.3 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is identified with a score of 0.5 or more."""
    return language.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id."""
    return simhash.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that an earlier one has, or they have further up; bytes
    of a character that a cut leaves incomplete go too, and n_chars follows the text."""
    names = [c for c in docs.columns if c != "text"]
    # in a struct, no column clashes with those of the result
    own = docs.select("doc_id", "text", F.struct(*(F.col(c) for c in names)).alias("_row"))
    cut = suffix.cut_repeats(own, keep="first", text=True)
    fields = [F.col("_row").getField(c).alias(c) for c in names]
    out = cut.select(*fields, F.col("kept").alias("text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their sequences and offsets."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good),
    ("language_id", identified),
    ("simhash_near_dedup", distinct),
    ("suffix_array_dedup", unrepeated),
    ("best_fit_packing", packed),
]
#: The stages train models, hash and tokenise: SQL cannot express their rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
