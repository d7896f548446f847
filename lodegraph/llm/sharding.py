"""Shards that each hold the mixture of sources: proportional stratified interleaving.

Rows of a source are put in an order shuffled by a seeded hash and numbered; a row's fractional rank
is its place in its source, over the source's rows.  In the order of fractional ranks sources
alternate in proportion, so any run of rows has the mixture of all, and equal cuts of that order are
the shards.  Both numberings are exact and without a task for a whole source: rows are numbered in
ranges of hashes or of fractional ranks, above the counts of the ranges before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import durable

#: Ranges of hashes of each source, and of fractional ranks: one task has a range or several.
PARTS = 4096
HASHED = 2**60


def _hash(seed: int, x: Column, digits: int) -> Column:
    """The first hex digits of the SHA-256 of the seed and a text, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(x.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def interleaved(rows: DataFrame, shards: int = 8, by: str = "source", key: str = "doc_id", ties: Sequence[str] = (), seed: int = 2024, parts: int = PARTS) -> DataFrame:
    """The rows with shard (int, from 0) and slot (long, from 0 without gaps): sizes of shards differ by
    one row at most, and of each value of ``by`` every shard has its share to within two rows.

    Rows are shuffled by the hash of ``key``; those of one key go in the order of ``ties``, and are
    taken as alike beyond it.  Nulls of ``by`` are a source of their own, a null ``key`` hashes as an
    empty one.  No rows give no rows; with fewer rows than shards some shards are empty.  All columns
    stay, whatever their names; columns called shard or slot are replaced.
    """
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    source = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    order = [F.col("_hash"), F.col("_row").getField(key)] + [F.col("_row").getField(c) for c in ties]
    keyed = rows.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), source.alias("_by"), _hash(seed, F.col(key), 15).alias("_hash"))
    keyed = keyed.withColumn("_part", F.floor(F.col("_hash") / F.lit(HASHED / parts)).cast("int"))
    # place in the source: rows of the ranges before, and the place in the range
    ranges = keyed.groupBy("_by", "_part").agg(F.count("*").alias("_n"))
    own = Window.partitionBy("_by")
    ranges = ranges.select("_by", "_part", (F.sum("_n").over(own.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(own).alias("_of"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_by", "_part").orderBy(*order))
    # the start differs by source: small ones do not all fall in the middle
    start = (_hash(seed, F.col("_by"), 8) + 0.5) / 4294967296.0
    ranked = durable(keyed.join(ranges, ["_by", "_part"]).select("_row", "_by", ((place - start) / F.col("_of")).alias("_rank")))
    # place among all, in the same way
    ranked = ranked.withColumn("_part", F.floor(F.col("_rank") * parts).cast("int"))
    all_rows = Window.orderBy("_part")  # over ``parts`` counts
    counts = ranked.groupBy("_part").agg(F.count("*").alias("_n"))
    counts = counts.select("_part", (F.sum("_n").over(all_rows) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_of"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_rank", "_by")) - 1
    placed = ranked.join(F.broadcast(counts), "_part").withColumn("_place", place)
    placed = placed.withColumn("_shard", F.expr(f"_place * {shards} div _of"))
    slot = F.expr(f"_place - (_shard * _of + {shards - 1}) div {shards}")
    fields = [F.col("_row").getField(c).alias(c) for c in names]
    return placed.select(*fields, F.col("_shard").cast("int").alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int = 64, **how: object) -> None:
    """Write the rows to ``path`` as one folder a shard, each file in the order of slots."""
    placed = interleaved(docs, shards, **how)  # type: ignore[arg-type]
    placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def assigned(docs: DataFrame, shards: int = 8, seed: int = 2024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of ``docs(doc_id, text, source)``, by
    equal numbers of rows.  A null text is empty; ids may be null or repeated.  Other columns are not read."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = interleaved(narrow, shards, ties=["size", "text_crc32"], seed=seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
