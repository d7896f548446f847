"""A quality classifier: a factorisation machine over hashed words, statistics and metadata.

A text's inputs are its lower-cased words hashed to ``WORDS`` places (log counts, scaled to
length 1), statistics of its bytes, words and lines, and the length that its row states.
The score is the logistic of w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2),
linear in the number of inputs.  It is trained in numpy on at most ``SAMPLE`` labelled texts,
whose inputs are taken from their whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from .blocks import LOWER, Rolling, counted, small_batches, text_blocks, unkept, words_of

WORDS = 1 << 14
RANK = 8
SAMPLE = 6_000
EPOCHS = 6
LEAST = 0.3
STATS = 14
U = np.uint64
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 space, 5 common marks, 6 other ASCII, 7 beyond ASCII
_KIND[33:127] = 6
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
_KIND[[32, 9, 10, 11, 12, 13]] = 4
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = 5
INPUTS = StructType([StructField("at", ArrayType(IntegerType())), StructField("x", ArrayType(FloatType())), StructField("stats", ArrayType(FloatType()))])


def _distinct(text: np.ndarray, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, n = counted(text.astype(U) << U(bits) | (keys & U((1 << bits) - 1)))
    return (both >> U(bits)).astype(np.int64), (both & U((1 << bits) - 1)).astype(np.int64), n


def inputs(data: np.ndarray, offsets: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse word inputs (text, place, value) of a block and its texts' statistics."""
    n = len(offsets) - 1
    roll = Rolling(LOWER[data], 41)
    start, end, words = words_of(data, offsets)
    of_word = np.repeat(np.arange(n), words)
    text, place, count = _distinct(of_word, roll.spans(start, end), WORDS.bit_length() - 1)
    x = np.log1p(count)
    norm = np.sqrt(np.bincount(text, x * x, n))
    x = (x / np.maximum(norm, 1e-9)[text]).astype(np.float32)

    size = np.diff(offsets)
    kind = _KIND[data]
    share = []
    for k in range(1, 8):
        total = np.concatenate(([0], np.cumsum(kind == k)))
        share.append((total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1))
    upper, lower, digit, space, marks, odd, beyond = share
    kinds = np.bincount(text, minlength=n) / np.maximum(words, 1)
    closed = (data[end - 1] == ord(".")) | (data[end - 1] == ord(",")) if len(end) else np.zeros(0, bool)
    breaks = np.union1d(np.flatnonzero(data == 10), offsets[1:-1] - 1) if len(data) else np.zeros(0, np.int64)
    heads = np.unique(np.concatenate(([0], breaks + 1)))
    heads = heads[(heads >= 0) & (heads < len(data))]
    tails = np.append(heads[1:], len(data))
    of_line = np.searchsorted(offsets, heads, "right") - 1
    lines = np.bincount(of_line, minlength=n)
    fresh = np.bincount(_distinct(of_line, roll.spans(heads, tails), 40)[0], minlength=n)
    stats = np.stack([
        upper, upper / np.maximum(upper + lower, 0.01), digit, space, marks, odd, beyond, np.minimum(odd * 10, 1), kinds, fresh / np.maximum(lines, 1),
        np.bincount(of_word, closed, n) / np.maximum(words, 1), np.minimum(size / np.maximum(words, 1) / 20, 2), np.log1p(words) / 10, np.log1p(np.maximum(stated, 0)) / 12,
    ], 1)
    return text, place, x, stats.astype(np.float32)


@dataclass
class Machine:
    w0: float
    w: np.ndarray  # WORDS + STATS
    v: np.ndarray  # WORDS + STATS x RANK
    mean: np.ndarray
    sd: np.ndarray

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.sd, -4, 4)

    def margins(self, text: np.ndarray, place: np.ndarray, x: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n, s = len(stats), self.scaled(stats)
        one = np.bincount(text, self.w[place] * x, n) + s @ self.w[WORDS:]
        vx = self.v[place] * x[:, None]
        first, square = s @ self.v[WORDS:], (s * s) @ (self.v[WORDS:] ** 2)
        at = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, np.int64)
        if len(at):
            first[text[at]] += np.add.reduceat(vx, at)
            square[text[at]] += np.add.reduceat(vx * vx, at)
        return self.w0 + one + 0.5 * (first * first - square).sum(1)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], seed: int = 0, epochs: int = EPOCHS) -> Machine:
    """Adagrad on the log loss with a little shrinkage; without rows every score is 1/2."""
    rng = np.random.default_rng(seed)
    size = WORDS + STATS
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32), np.zeros(STATS, np.float32), np.ones(STATS, np.float32))
    if not rows:
        m.v[:] = 0
        return m
    stats = np.array([r[2] for r in rows], np.float32)
    m.mean, m.sd = stats.mean(0), np.maximum(stats.std(0), 0.01)
    y = np.array([r[3] for r in rows], np.float32)
    gw, gv, g0 = np.full(size, 1e-6, np.float32), np.full((size, RANK), 1e-6, np.float32), 1e-6
    own_s = m.scaled(stats)
    place = [np.concatenate((np.asarray(r[0], np.int64), WORDS + np.arange(STATS))) for r in rows]
    value = [np.concatenate((np.asarray(r[1], np.float32), own_s[i])) for i, r in enumerate(rows)]
    for _ in range(max(epochs, min(40, 30_000 // len(rows)))):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 16):
            own = order[lo : lo + 16]
            at, x = np.concatenate([place[i] for i in own]), np.concatenate([value[i] for i in own])
            sizes = np.array([len(place[i]) for i in own])
            head = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            vx = m.v[at] * x[:, None]
            total = np.add.reduceat(vx, head)
            z = m.w0 + np.add.reduceat(m.w[at] * x, head) + 0.5 * (total**2 - np.add.reduceat(vx**2, head)).sum(1)
            d = np.repeat((logistic(z) - y[own]) / len(own), sizes).astype(np.float32)
            dw = d * x
            dv = dw[:, None] * (np.repeat(total, sizes, 0) - vx)
            keys, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, dw).astype(np.float32) + 1e-5 * m.w[keys]
            dv = np.stack([np.bincount(back, dv[:, j]) for j in range(RANK)], 1).astype(np.float32) + 1e-4 * m.v[keys]
            gw[keys] += dw * dw
            gv[keys] += dv * dv
            m.w[keys] -= 0.1 * dw / np.sqrt(gw[keys])
            m.v[keys] -= 0.02 * dv / np.sqrt(gv[keys])
            d0 = float((logistic(z) - y[own]).mean())
            g0 += d0 * d0
            m.w0 -= 0.1 * d0 / g0**0.5
    return m


@F.arrow_udf(INPUTS)
def inputs_udf(text: pa.Array, stated: pa.Array) -> pa.Array:
    out = []
    stated = stated.fill_null(0).to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in text_blocks(text):
        own, place, x, stats = inputs(data, offsets, stated[lo:hi])
        edges = np.searchsorted(own, np.arange(hi - lo + 1))
        out += [{"at": place[a:b], "x": x[a:b], "stats": s} for a, b, s in zip(edges[:-1], edges[1:], stats, strict=True)]
    return pa.array(out, pa.struct([("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32())), ("stats", pa.list_(pa.float32()))]))


def scores(machine: Machine, text: pa.Array, stated: pa.Array) -> pa.Array:
    unkept()
    out = np.zeros(len(text))
    stated = stated.fill_null(0).to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in text_blocks(text):
        out[lo:hi] = logistic(machine.margins(*inputs(data, offsets, stated[lo:hi])))
    return pa.array(out)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from the labelled rows that are not held out; of more than ``sample``, those
    with the least hashes of doc_id.  The sample bounds what is broadcast and collected."""
    known = labels.where("quality is not null and crc32(cast(doc_id as string)) % 5 <> 0").select(F.col("doc_id").alias("id"), "quality", F.xxhash64("doc_id").alias("at"))
    # the least hashes lie below a bound: each task sends few rows, however many there are
    n = known.agg(F.count_distinct("id")).head()[0]
    low = known.where(F.col("at") <= min(2**63 - 1, (2 * sample + 64) * 2**64 // max(n, 1) - 2**63)).distinct()
    chosen = low.orderBy("at", "id", "quality").limit(sample).select("id", "quality")
    rows = (
        docs.select("doc_id", "text", stated(docs).alias("stated"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
        .select(inputs_udf("text", "stated").alias("f"), "quality", F.xxhash64("doc_id").alias("at"), "id")
        .orderBy("at", "id", F.xxhash64("f"), "quality").limit(sample).collect()
    )  # fmt: skip  # rows below the bound only: the sample, and the repeats of its ids
    return train([(r["f"]["at"], r["f"]["x"], r["f"]["stats"], int(r["quality"] > 0)) for r in rows])


def stated(docs: DataFrame) -> Column:
    """The length that the row states; 0 where it states none."""
    return (F.coalesce(F.col("n_chars"), F.lit(0)) if "n_chars" in docs.columns else F.lit(0)).cast("long")


def score(docs: DataFrame, machine: Machine) -> Column:
    return F.arrow_udf(lambda text, stated: scores(machine, text, stated), DoubleType())(F.col("text"), stated(docs))


def classify(docs: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs(doc_id, text[, n_chars])``.

    Null and empty texts have the score of their statistics, all zero; without labels every
    score is 1/2.  A row with a null doc_id is neither learned from nor held out.  A label that
    repeats counts once, unlike labels of one document each; rows that repeat are scored one by
    one.  Texts of any length are read whole; an empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    machine = machine or learn(docs, labels)
    out = docs.select("doc_id", held_out().alias("held_out"), score(docs, machine).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= LEAST).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows that score at least ``least``, columns as they are."""
    return docs.where(score(docs, learn(docs, labels)) >= least)
