"""Language-model scores from a log-frequency Bloom filter.

Words and pairs of words are counted over all training texts.  A count is quantised to a
level of ``EDGES`` (whole up to 10, then in steps of a tenth), and a pair of level q goes
into a Bloom filter q times, once with each level from 1; its level is read back by probing
levels upwards until one is missing.  Pairs of a level above ``FILTERED`` would take most of the
probes and much of the filter: they stand beside it with their levels.  The filter is broadcast to
the workers, with these and the words' exact counts, from which their levels are taken.  A word's probability after another is
smoothed towards that of the word alone:

    P(w)     = (c(w) + 1) / (N + V + 1)
    P(w | v) = (c(v, w) + MU * P(w)) / (c(v) + MU)

with the least count of a level above the line and the largest below it, so that the
probabilities of all words after v sum to at most 1 but for the filter's false positives.

What a worker holds is bounded: a filter of at most ``FILTER_BITS`` bits and ``WORDS`` exact word
counts and levels.  A larger model is cut into slices by n-gram hash, and documents pass over one slice
after another with the levels found so far beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, Rolling, counted, durable, found, mix, packed, small_batches, text_blocks, words_of

FILTER_BITS = 1 << 30
WORDS = 1 << 23
ITEM_BITS = 10
PROBES = 6
#: Levels that the filter holds; pairs of higher ones are few unless texts are many.
FILTERED = 8
#: By the likelihood of held-out texts, which is flat from here to twice this.
MU = 512.0
HELD = 500_000
U = np.uint64
#: Hashes of the end of a text and of what stands before its first word.
END, START = U(0x5DEECE66D1234567), U(0x2545F4914F6CDD1D)


def _edges(top: int = 1 << 50) -> np.ndarray:
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, -(-out[-1] * 11 // 10)))
    return np.array(out, np.int64)


#: The least count of each level, from level 1.
EDGES = _edges()


def level_of(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, count, "right")


def least_of(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, EDGES[np.maximum(level, 1) - 1], 0)


def most_of(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, EDGES[np.minimum(level, len(EDGES) - 1)] - 1, 0)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of a block and of the pairs that end in them, and how many tokens
    each text has: its words, then one end."""
    n = len(offsets) - 1
    start, end, words = words_of(data, offsets)
    sizes = words + 1
    last = np.cumsum(sizes) - 1
    h = np.full(int(sizes.sum()), END)
    inside = np.ones(len(h), bool)
    inside[last] = False
    if len(start):
        h[inside] = Rolling(LOWER[data], 61).spans(start, end)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[last - sizes + 1] = START
    return h, mix(before * U(0x9E3779B97F4A7C15) ^ h) if n else h, sizes


def buckets_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> U(64 - buckets.bit_length() + 1)).astype(np.int64)


# -- counts ---------------------------------------------------------------------------------


def counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, w, wn, g, gn, tokens, words, items, near, exact): the words and pairs of one bucket of hashes in
    order and their counts, with their totals (items: the sum of levels; near: of those in the filter; exact: of what stands
    beside it); summed per block before they travel."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                h, g, _ = tokens(data, offsets)
                held.append((*counted(h), *counted(g)))
                size += len(held[-1][2])
                if size > HELD:
                    yield dealt(held)
                    held, size = [], 0
        if held:
            yield dealt(held)

    def merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return counted(np.concatenate(keys), np.concatenate(n))

    def dealt(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        w, wn, g, gn = zip(*held, strict=True)
        w, wn = merged(w, wn)
        g, gn = merged(g, gn)
        cuts = [np.searchsorted(buckets_of(k, buckets), np.arange(buckets + 1)) for k in (w, g)]
        full = [b for b in range(buckets) if any(c[b] < c[b + 1] for c in cuts)]
        # counts of a block fit 32 bits
        cols = [[x[c[b] : c[b + 1]].astype(t).tobytes() for b in full] for x, c, t in ((w, cuts[0], "<u8"), (wn, cuts[0], "<u4"), (g, cuts[1], "<u8"), (gn, cuts[1], "<u4"))]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["bucket", "w", "wn", "g", "gn"])

    def reduced(rows: pa.Table) -> pa.Table:
        w, wn = merged(packed(rows["w"].combine_chunks(), "<u8"), [x.astype(np.int64) for x in packed(rows["wn"].combine_chunks(), "<u4")])
        g, gn = merged(packed(rows["g"].combine_chunks(), "<u8"), [x.astype(np.int64) for x in packed(rows["gn"].combine_chunks(), "<u4")])
        levels = level_of(gn)
        near = levels <= FILTERED
        return pa.table({
            "bucket": rows["bucket"][:1], "w": [w.tobytes()], "wn": [wn.astype("<i8").tobytes()], "g": [g.tobytes()], "gn": [gn.astype("<i8").tobytes()],
            "tokens": pa.array([int(wn.sum())]), "words": pa.array([len(w)]), "items": pa.array([int(levels.sum())]), "near": pa.array([int(levels[near].sum())]), "exact": pa.array([len(w) + int(np.count_nonzero(~near))]),
        })

    return (
        docs.select("text")
        .mapInArrow(gather, "bucket int, w binary, wn binary, g binary, gn binary")
        .groupBy("bucket")
        .applyInArrow(reduced, "bucket int, w binary, wn binary, g binary, gn binary, tokens long, words long, items long, near long, exact long")
    )


# -- the filter -------------------------------------------------------------------------------


def hashed(h: np.ndarray, level: int) -> np.ndarray:
    """A start and a step, 32 bits each, for the probes of (n-gram, level)."""
    return mix(h ^ mix(np.array([level], U) + U(0x632BE59BD9B4E019)))


def scaled(at: np.ndarray, size: int) -> np.ndarray:
    """The low 32 bits of ``at`` as places in a segment of ``size`` bits."""
    return ((at & U(0xFFFFFFFF)) * U(size) >> U(32)).astype(np.int64)


def segment(h: np.ndarray, level: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        h = h[level >= q]
        level = level[level >= q]
        x = hashed(h, q)
        at, step = x & U(0xFFFFFFFF), (x >> U(32)) | U(1)
        for _ in range(PROBES):
            bits[scaled(at, size)] = True
            at = at + step
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass
class Slice:
    """Segments of buckets first .. first + len - 1 for pairs, the words of these buckets with their counts and their
    pairs above FILTERED with their levels."""

    first: int
    buckets: int  # in all
    size: int  # bits of a segment
    bits: np.ndarray
    words: np.ndarray
    numbers: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    top: int = len(EDGES) - 1  # the highest level in the filter

    def level(self, h: np.ndarray) -> np.ndarray:
        """Levels of pairs; 0 for those not in this slice."""
        out = np.zeros(len(h), np.uint8)
        at = (buckets_of(h, self.buckets) - self.first) * self.size
        inside = (at >= 0) & (at < len(self.bits) * 8)  # a pair of another slice is in no table of this one
        if len(self.pairs):
            place, far = found(h, self.pairs)
            out[far] = self.levels[place[far]]
            inside &= ~far
        live = np.flatnonzero(inside)
        h, base, q = h[live], at[live], 1
        while len(live) and q <= self.top:
            x = hashed(h, q)
            at, step, left = x & U(0xFFFFFFFF), (x >> U(32)) | U(1), np.arange(len(live))
            for _ in range(PROBES):  # only those still there are probed again
                place = base[left] + scaled(at, self.size)
                there = (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & np.uint8(1) == 1
                left, at, step = left[there], at[there], step[there]
                at = at + step
            live, h, base = live[left], h[left], base[left]
            out[live] = q
            q += 1
        return out

    def count(self, h: np.ndarray) -> np.ndarray:
        """Exact counts of words; 0 for those not in this slice."""
        at, there = found(h, self.words)
        return np.where(there, self.numbers[at], 0).astype(np.int64) if len(self.words) else np.zeros(len(h), np.int64)


@dataclass
class Model:
    table: DataFrame  # counts(), durable
    buckets: int
    tokens: int
    words: int
    texts: int
    slices: int
    size: int

    def slice(self, k: int) -> Slice:
        """The k-th slice, gathered on the driver: FILTER_BITS bits and WORDS counts and levels at most."""
        each = self.buckets // self.slices
        size = self.size

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    g, gn = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("g", "<u8"), ("gn", "<i8")))
                    levels = level_of(gn)
                    near = levels <= FILTERED
                    cells = [segment(g[near], levels[near], size), g[~near].tobytes(), levels[~near].astype(np.uint8).tobytes()]
                    yield pa.RecordBatch.from_arrays([batch.column("bucket")[r : r + 1], *(pa.array([c], pa.binary()) for c in cells), batch.column("w")[r : r + 1], batch.column("wn")[r : r + 1]], names=["bucket", "bits", "g", "q", "w", "wn"])

        own = self.table.where((F.col("bucket") >= k * each) & (F.col("bucket") < (k + 1) * each)).select("bucket", "w", "wn", "g", "gn")
        bits = np.zeros((each, size // 8), np.uint8)
        words: dict[int, np.ndarray] = {}
        numbers: dict[int, np.ndarray] = {}
        pairs: dict[int, np.ndarray] = {}
        levels: dict[int, np.ndarray] = {}
        # partition by partition, so that the JVM never holds the whole slice
        for row in own.mapInArrow(build, "bucket int, bits binary, g binary, q binary, w binary, wn binary").toLocalIterator(True):
            b = row["bucket"] - k * each
            bits[b] = np.frombuffer(row["bits"], np.uint8)
            pairs[b], levels[b] = np.frombuffer(row["g"], "<u8"), np.frombuffer(row["q"], np.uint8)
            n = np.frombuffer(row["wn"], "<i8")
            words[b], numbers[b] = np.frombuffer(row["w"], "<u8"), n.astype("<u4") if n.max(initial=0) < 2**32 else n
        words[each], numbers[each], pairs[each], levels[each] = np.zeros(0, U), np.zeros(0, "<u4"), np.zeros(0, U), np.zeros(0, np.uint8)
        order = sorted(words)
        return Slice(k * each, self.buckets, size, bits.ravel(), *(np.concatenate([held[b] for b in order]) for held in (words, numbers, pairs, levels)), FILTERED)


def learn(docs: DataFrame, filter_bits: int = FILTER_BITS, words: int = WORDS) -> Model:
    """Counts of all rows of ``docs(text)``; null is the empty text."""
    buckets = 1 << min(16, max(8, (8 * docs.rdd.getNumPartitions() - 1).bit_length()))  # a bucket is merged in one go
    table = durable(counts(docs, buckets))
    total = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("items"), F.lit(0)), F.coalesce(F.max("near"), F.lit(0)), F.coalesce(F.max("exact"), F.lit(0))).head()
    size = max(64, -(-int(total[3]) * ITEM_BITS // 64) * 64)  # segments are alike: hashes deal them evenly
    slices = 1
    while slices < buckets and (buckets // slices * size > filter_bits or buckets // slices * int(total[4]) > words):
        slices *= 2
    return Model(table, buckets, int(total[0]), int(total[1]), 0, slices, size)


# -- scores ----------------------------------------------------------------------------------


STATE = "n_tokens long, n_known long, base_score double, score double, levels binary"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score of each row.

    Null is the empty text, one end.  An untrained model (N = V = 0) gives every token the
    probability 1 alone, in base_score as in score.
    """
    spark = docs.sparkSession
    if any(c in docs.columns for c in ("n_tokens", "n_known", "base_score", "score", "_levels")):
        raise ValueError("docs has a column of the result")
    starts = model.texts
    total, kinds = model.tokens, model.words
    floor = float(total + kinds + 1)

    def passed(held: Slice, last: bool, text: pa.Array, levels: pa.Array | None, known: pa.Array | None, base: pa.Array | None) -> pa.StructArray:
        n = len(text)
        sizes_all, known_all, base_all, score_all, out = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), []
        for lo, hi, data, offsets in text_blocks(text):
            h, g, sizes = tokens(data, offsets)
            edge = np.concatenate(([0], np.cumsum(sizes)))
            kinds_h, back_h = np.unique(h, return_inverse=True)
            kinds_g, back_g = np.unique(g, return_inverse=True)
            own = held.count(kinds_h)
            # a word outside the slice adds nothing here; one that no slice has adds its share at the end
            own_known = np.add.reduceat((own > 0)[back_h].astype(np.int64), edge[:-1])
            own_base = np.add.reduceat(np.where(own > 0, np.log10(own + 1.0), 0.0)[back_h], edge[:-1])
            lw, lg = level_of(own).astype(np.uint8)[back_h], held.level(kinds_g)[back_g]
            if levels is not None:
                earlier = np.concatenate([np.frombuffer(levels[i].as_buffer(), np.uint8).reshape(2, -1) for i in range(lo, hi)], axis=1)
                lw, lg = np.maximum(lw, earlier[0]), np.maximum(lg, earlier[1])
                own_known = own_known + known[lo:hi].to_numpy()
                own_base = own_base + base[lo:hi].to_numpy()
            sizes_all[lo:hi], known_all[lo:hi], base_all[lo:hi] = sizes, own_known, own_base
            if last:
                context = np.empty(len(lw), np.int64)
                context[1:] = most_of(lw[:-1].astype(np.int64))
                context[edge[:-1]] = starts
                one = (least_of(lw.astype(np.int64)) + 1) / floor
                p = np.log10((least_of(lg.astype(np.int64)) + MU * one) / (context + MU))
                score_all[lo:hi] = np.add.reduceat(p, edge[:-1])
                base_all[lo:hi] -= sizes * np.log10(float(total + kinds + 1))
                out += [b""] * (hi - lo)
            else:
                out += [np.stack((lw[a:b], lg[a:b])).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.StructArray.from_arrays([pa.array(sizes_all), pa.array(known_all), pa.array(base_all), pa.array(score_all), pa.array(out, pa.binary())], names=["n_tokens", "n_known", "base_score", "score", "levels"])

    out = docs
    for k in range(model.slices):
        held, last = spark.sparkContext.broadcast(model.slice(k)), k == model.slices - 1
        if k == 0:
            run = F.arrow_udf(lambda text, held=held, last=last: passed(held.value, last, text, None, None, None), STATE)
            out = out.withColumn("_lm", run("text"))
        else:
            run = F.arrow_udf(lambda text, levels, known, base, held=held, last=last: passed(held.value, last, text, levels, known, base), STATE)
            out = out.withColumn("_lm", run("text", "_lm.levels", "_lm.n_known", "_lm.base_score"))
        if not last:
            out = durable(out)
            held.unpersist()
    return out.select(*docs.columns, *(F.col(f"_lm.{c}").alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def fitted(docs: DataFrame, filter_bits: int = FILTER_BITS, words: int = WORDS) -> Model:
    """A model of the rows of ``docs(doc_id, text)`` that are not held out; rows without an id are
    neither learned from nor held out."""
    own = docs.where("crc32(cast(doc_id as string)) % 7 <> 2")
    model = learn(own, filter_bits, words)
    model.texts = own.count()
    return model


def scored(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of
    ``docs(doc_id, text)``.

    Null is the empty text: one end.  Rows are taken as they come, repeated or without a doc_id; an
    empty table gives no rows; texts of any length are read whole; other columns, whatever their
    names, are not read.
    """
    small_batches(docs.sparkSession)
    model = model or fitted(docs)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
