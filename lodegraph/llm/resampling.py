"""Importance resampling of documents towards the words of a target.

Runs of words fall into buckets by CRC-32.  The gain of a bucket is the scaled logarithm of its
share in the target over its share in the documents; an array of gains, one number a bucket, scores
each document by the mean over its features, and noise from its id makes the highest scores a draw.
Scores are whole numbers, so a histogram of them is exact and small: its sums from the top are the
ranks at which each score begins, and tell the score at which the draw ends.  Only documents of that
score or a higher one are numbered, each score by doc_id, in ranges of ids.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LOWER, durable, text_blocks, words_of

BUCKETS = 10_000
SCALE = 1000
#: Words of more bytes are hashed one by one.
LONG = 64
#: Ranges of doc_id into which the documents of one score are dealt.
RANGES = 1024
#: Bytes that no word holds: all ASCII but digits and small letters.
OUTSIDE = np.ones(256, bool)
OUTSIDE[48:58] = OUTSIDE[97:123] = OUTSIDE[128:] = False


@lru_cache(1)
def crc_steps() -> np.ndarray:
    """The effect of each byte on a CRC-32, by its polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of ``data``, carried on from ``state`` (0 at a beginning)."""
    steps, size = crc_steps(), end - start
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -LONG, "left"))
    out = state.copy()
    for i in order[:long]:
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i]))
    rest = order[long:]
    at, falling, own = start[rest], -size[rest], ~state[rest]
    for k in range(int(size[rest].max(initial=0))):
        n = int(np.searchsorted(falling, -k, "left"))  # spans of more than k bytes
        own[:n] = steps[(own[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (own[:n] >> np.uint32(8))
    out[rest] = ~own
    return out


def features(data: np.ndarray, offsets: np.ndarray, runs: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 ... ``runs`` words: the buckets of a block's runs, text by text, and how many
    each text has."""
    data = LOWER[data]
    start, end, counts = words_of(data, offsets, OUTSIDE)
    text = np.repeat(np.arange(len(counts)), counts)
    blank = np.array([32], np.uint8)
    crc = crc32(data, start, end, np.zeros(len(start), np.uint32))
    for k in range(1, runs + 1):
        if k > 1:  # carry on the runs that another word of the same text follows
            n = max(0, len(start) - k + 1)
            more = np.flatnonzero(text[:n] == text[k - 1 :]) if n else np.zeros(0, np.int64)
            stem = crc[np.searchsorted(begins, more)]
            stem = crc32(blank, np.zeros(len(more), np.int64), np.ones(len(more), np.int64), stem)
            crc = crc32(data, start[more + k - 1], end[more + k - 1], stem)
            begins = more
        else:
            begins = np.arange(len(start))
        yield (crc % np.uint32(buckets)).astype(np.int64), np.bincount(text[begins], minlength=len(counts))


def bucket_counts(docs: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``docs(text)`` are in each bucket: one array, whatever their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                for bucket, _ in features(data, offsets, runs, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, from its counts in the documents and in the target."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(SCALE * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, runs: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features,
    0 without any."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            n = batch.num_rows
            words, number, total = (np.zeros(n, np.int64) for _ in range(3))
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                for k, (bucket, counts) in enumerate(features(data, offsets, runs, len(own))):
                    sums = np.concatenate(([0], np.cumsum(own[bucket])))
                    ends = np.concatenate(([0], np.cumsum(counts)))
                    number[lo:hi] += counts
                    total[lo:hi] += sums[ends[1:]] - sums[ends[:-1]]
                    if k == 0:
                        words[lo:hi] = counts
            weight = total // np.maximum(number, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(number), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Scaled noise of the key that makes the order of sums a weighted draw."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, runs: int = 1, least_words: int = 20, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs(doc_id, text)``: rank is the
    place, from 1, of the ``percent`` in a hundred of all documents of ``least_words`` words or more
    that score highest against ``target(text)``, ties to the smaller doc_id; null for the others.

    A null text is empty: no features, weight 0, never drawn.  A null doc_id has the noise of an empty
    one and comes after all others of its score.  Repeated rows have places of their own; rows of one
    id and score are alike, so which of them has which place does not matter.  With an empty target
    all gains follow from the documents; without documents there are no rows.  Other columns, whatever
    their names, are not read.  Scores are between the least and the largest gain and noise, some
    100,000 values for any input: that bounds the histogram.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    scored = durable(weights(docs, gain, runs).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    may = scored.where(F.col("n_words") >= least_words)
    bars = sorted(may.groupBy("score").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect(), key=lambda r: -r["score"])
    counts = np.array([r["n"] for r in bars], np.int64)
    drawn = percent * int(counts.sum()) // 100
    before = np.cumsum(counts) - counts  # documents of higher scores
    kept = int(np.searchsorted(before, drawn, "left"))
    out = lambda df, rank: df.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
    if not kept:
        return out(scored, F.lit(None))
    cutoff = bars[kept - 1]["score"]
    begins = spark.createDataFrame([(r["score"], int(b)) for r, b in zip(bars[:kept], before, strict=False)], "score long, above long")
    ids = [x for r in bars for x in (r["lo"], r["hi"]) if x is not None] or [0]
    width = (max(ids) - min(ids)) // RANGES + 1
    high = (F.col("n_words") >= least_words) & (F.col("score") >= cutoff)
    ranged = scored.where(high).withColumn("part", F.coalesce(F.expr(f"doc_id div {width}L"), F.lit(2**63 - 1)))
    parts = ranged.groupBy("score", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("score").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.join(F.broadcast(begins), "score").select("score", "part", (F.col("above") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("above"))
    place = F.col("above") + F.row_number().over(Window.partitionBy("score", "part").orderBy(F.asc_nulls_last("doc_id")))
    ranked = ranged.join(parts, ["score", "part"]).withColumn("place", place)
    return out(ranked, F.when(F.col("place") <= drawn, F.col("place"))).unionByName(out(scored.where(~high), F.lit(None)))
