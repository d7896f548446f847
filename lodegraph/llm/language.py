"""Language identification by a small byte convolutional network.

Bytes (A-Z lower-cased) are embedded, filters of widths 2, 3 and 4 slide over windows of
``WINDOW`` positions, each filter keeps its maximum, and a softmax layer turns the maxima
into classes.  The network is trained here, in numpy, on windows of at most ``SAMPLE`` labelled
texts: of each text ``EACH_TEXT`` windows, drawn by hash from all that tile it, or all.
A text is scored whole: its windows tile it, and the mean of their logits, weighted by
their lengths, gives its classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from .blocks import LOWER, mix, small_batches, text_blocks, unkept

WINDOW = 128
WIDTHS = (2, 3, 4)
EACH = 8
DIMS = 8
SAMPLE = 12_000
#: Windows of a text to learn from.
EACH_TEXT = 4
EPOCHS = 4
WIDE = max(WIDTHS)
#: Bytes of text tiled at a time; whole windows.
PIECE = 1 << 18
U = np.uint64
UNKNOWN = "und"
RESULT = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


@dataclass
class Network:
    classes: list[str]
    embed: np.ndarray  # 256 x DIMS; row 0 is the padding
    filters: np.ndarray  # WIDE * DIMS x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def maxima(self, windows: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each window of WINDOW + WIDE - 1 bytes."""
        n = len(windows)
        x = self.embed[windows].reshape(n, -1)
        rows = np.lib.stride_tricks.as_strided(x, (n, WINDOW, WIDE * DIMS), (x.strides[0], DIMS * 4, 4))
        y = (np.ascontiguousarray(rows).reshape(-1, WIDE * DIMS) @ self.filters).reshape(n, WINDOW, -1)
        half = WINDOW
        while half > 1:
            half //= 2
            y = np.maximum(y[:, :half], y[:, half : 2 * half])
        return y[:, 0]

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self.maxima(windows) + self.bias, 0) @ self.out + self.out_bias


def tiled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that tile each text, their texts' numbers and their lengths within the text."""
    size = np.diff(offsets)
    k = np.maximum(1, -(-size // WINDOW))
    text = np.repeat(np.arange(len(k)), k)
    nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    start = offsets[text] + nth * WINDOW
    at = start[:, None] + np.arange(WINDOW + WIDE - 1)
    held = np.append(LOWER[data], np.uint8(0))
    windows = held[np.minimum(at, len(data))]
    windows[at >= offsets[text + 1][:, None]] = 0
    return windows, text, np.clip(offsets[text + 1] - start, 1, WINDOW)


def tiles(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The windows of a block; those of a text of over PIECE bytes come in pieces."""
    if len(data) <= PIECE or len(offsets) > 2:
        yield tiled(data, offsets)
        return
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE + WIDE - 1]
        n = -(-min(PIECE, len(data) - at) // WINDOW)
        windows, own, size = tiled(piece, np.array([0, len(piece)]))
        yield windows[:n], own[:n], size[:n]


@F.arrow_udf(BinaryType())
def drawn(text: pa.Array, key: pa.Array) -> pa.Array:
    """EACH_TEXT windows of each text, or all, drawn by ``key`` from those that tile it whole."""
    out = []
    keys = key.to_numpy(zero_copy_only=False).view(U)
    for lo, hi, data, offsets in text_blocks(text, PIECE):
        held: list[list[tuple[int, bytes]]] = [[] for _ in range(hi - lo)]
        nth = 0
        for windows, own, _ in tiles(data, offsets):
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            at = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) + nth
            rank = mix(keys[lo:hi][own] + at.astype(U) * U(0x9E3779B97F4A7C15))
            for i, (a, b) in enumerate(zip(first, np.append(first[1:], len(own)), strict=True)):
                best = np.argsort(rank[a:b])[:EACH_TEXT] + a
                held[own[first[i]]] += [(int(rank[j]), windows[j].tobytes()) for j in best]
            nth += len(own)
        out += [b"".join(w for _, w in sorted(x)[:EACH_TEXT]) for x in held]
    return pa.array(out, pa.binary())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 0, epochs: int = EPOCHS) -> Network:
    """A network from all windows of the texts."""
    raw = [x.encode() for x in texts]
    windows, text, _ = tiled(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return fit(windows, [langs[i] for i in text], seed, epochs)


def fit(windows: np.ndarray, langs: list[str], seed: int = 0, epochs: int = EPOCHS) -> Network:
    """Adam on the cross entropy of single windows; classes weigh alike."""
    rng = np.random.default_rng(seed)
    classes = sorted(set(langs))
    n_filters = EACH * len(WIDTHS)
    used = np.zeros((WIDE, DIMS, n_filters), np.float32)
    for i, w in enumerate(WIDTHS):
        used[:w, :, i * EACH : (i + 1) * EACH] = 1
    used = used.reshape(-1, n_filters)
    p = {
        "embed": rng.normal(0, 0.3, (256, DIMS)), "filters": rng.normal(0, 0.3, used.shape) * used, "bias": np.zeros(n_filters),
        "out": rng.normal(0, 0.3, (n_filters, max(1, len(classes)))), "out_bias": np.zeros(max(1, len(classes))),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embed"][0] = 0
    net = Network(classes, p["embed"], p["filters"], p["bias"], p["out"], p["out_bias"])
    if len(classes) < 2:
        return net
    y = np.searchsorted(classes, langs)
    weight = (len(y) / len(classes) / np.maximum(np.bincount(y, minlength=len(classes)), 1))[y]
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    epochs = max(epochs, min(30, 400_000 // max(1, len(y))))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 128):
            own = order[lo : lo + 128]
            b, x = len(own), p["embed"][windows[own]].reshape(len(own), -1)
            rows = np.lib.stride_tricks.as_strided(x, (b, WINDOW, WIDE * DIMS), (x.strides[0], DIMS * 4, 4))
            z = (np.ascontiguousarray(rows).reshape(-1, WIDE * DIMS) @ p["filters"]).reshape(b, WINDOW, -1)
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0] + p["bias"]
            hid = np.maximum(top, 0)
            d = softmax(hid @ p["out"] + p["out_bias"])
            d[np.arange(b), y[own]] -= 1
            d *= (weight[own] / b)[:, None].astype(np.float32)
            g = {"out": hid.T @ d, "out_bias": d.sum(0)}
            back = (d @ p["out"].T) * (top > 0)
            patch = rows[np.arange(b)[:, None], at]  # b x filters x WIDE * DIMS
            g["filters"] = np.einsum("bf,bfk->kf", back, patch) * used
            g["bias"] = back.sum(0)
            to = (back[:, :, None] * p["filters"].T[None]).reshape(-1, DIMS)
            byte = windows[own][np.arange(b)[:, None, None], at[:, :, None] + np.arange(WIDE)].ravel()
            g["embed"] = np.stack([np.bincount(byte, to[:, j], 256) for j in range(DIMS)], 1).astype(np.float32)
            g["embed"][0] = 0
            t += 1
            for k, x in g.items():
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                p[k] -= (0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def classify(net: Network, text: pa.Array) -> pa.StructArray:
    """Language and score of each text; ``und`` and 0 for null texts and texts without a letter."""
    unkept()
    n = len(text)
    total = np.zeros((n, max(1, len(net.classes))))
    weight = np.zeros(n)
    for lo, _, data, offsets in text_blocks(text, PIECE):
        for windows, own, size in tiles(data, offsets):
            for at in range(0, len(own), 512):
                z = net.logits(windows[at : at + 512]) * size[at : at + 512, None]
                rows = own[at : at + 512] + lo
                np.add.at(total, rows, z)
                np.add.at(weight, rows, size[at : at + 512])
    p = softmax(total / np.maximum(weight, 1)[:, None])
    lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False) & bool(net.classes)
    best = p.argmax(1)
    lang = [net.classes[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)]
    score = np.where(lettered, p.max(1), 0.0)
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def shares(counts: dict[str, int], sample: int) -> dict[str, int]:
    """How many each
    language's rows to take: all have the same, what one lacks goes to the others."""
    out, left = {}, sample
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(counts) - i)))
        left -= out[lang]
    return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from the rows with a language that are not held out; of more than ``sample``, each
    language's rows with the least hashes of doc_id, by ``shares``.  No language is left out."""
    spark = docs.sparkSession
    known = docs.where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one a language
    if not counts:
        return train([], [])
    need = shares(counts, sample)
    # the least hashes lie below a bound, so that few rows are ranked and opened
    bound = {lang: min(2**63 - 1, (2 * n + 64) * 2**64 // counts[lang] - 2**63) for lang, n in need.items()}
    wanted = F.broadcast(spark.createDataFrame([(x, need[x], bound[x]) for x in need], "lang string, need long, bound long"))
    rows = known.select("lang", "text", F.xxhash64("doc_id").alias("at"), F.col("doc_id").alias("id"))
    low = rows.join(wanted, "lang").where("at <= bound").select("lang", "need", "at", "id", drawn("text", "at").alias("part"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at", "id", "part"))
    found = low.withColumn("nth", nth).where("nth <= need").orderBy("at", "id", "part", "lang").select("lang", "part").collect()
    missing = sorted(set(need) - {r["lang"] for r in found})  # rows of one repeated id, over the bound
    if missing:
        least = rows.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min(F.struct("at", "id", "text")).alias("r"))
        found += least.select("lang", drawn("r.text", "r.at").alias("part")).orderBy("lang").collect()
    width = WINDOW + WIDE - 1
    windows = np.frombuffer(b"".join(r["part"] for r in found), np.uint8).reshape(-1, width)
    return fit(windows, [r["lang"] for r in found for _ in range(len(r["part"]) // width)])


def predicted(docs: DataFrame, net: Network) -> Column:
    """A column struct<lang, score> of the column text."""
    return F.arrow_udf(lambda text: classify(net, text), RESULT)(F.col("text"))


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs(doc_id, text, lang)``.

    Null, empty and letterless texts are ``und`` with score 0; so is every text when nothing could be
    learned.  A row with a null doc_id is neither learned from nor held out; rows that repeat are
    rows of their own, learned from and answered one by one; of languages that score alike the
    first by name is given.  A text is read whole, in pieces if long; an empty table gives no rows;
    other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    net = net or learn(docs)
    return docs.select("doc_id", held_out().alias("held_out"), predicted(docs, net).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.5, net: Network | None = None) -> DataFrame:
    """The rows whose text is identified with at least ``least`` confidence, columns as they are;
    where nothing could be learned, all rows with a letter."""
    net = net or learn(docs)
    if not net.classes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    p = predicted(docs, net)
    return docs.where((p["lang"] != UNKNOWN) & (p["score"] >= least))
