"""Order MinHash fingerprints of documents, and their likeness.

A text's k-mers of ``KMER`` bytes are numbered by occurrence, so repeats count.  One hash of
(k-mer, number) deals them to ``BINS`` bins; in each bin the ``TUPLE`` least hashes are
selected, put in the order of their places in the text, and hashed as a tuple.  Two texts
share an entry if they share the selected k-mers and their order, which makes the share of
equal entries sensitive to edit distance, not to content alone.

The query also compares each text with an edited one that borrows from the next document in
descending order of doc_id.  Documents are dealt by ranges of doc_id; the first of each range
is sent to the range before it as well, so that every neighbour is at hand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

from .blocks import Rolling, cut, mix, release, text_blocks

KMER = 12
TUPLE = 2
BIN_BITS = 7
BINS = 1 << BIN_BITS
VALUE_BITS = 24
#: Texts in one block, and bits of a place in it: more bits only for a longer single text.
TEXTS = 4096
PLACE_BITS = 21
#: Bytes of text in one block, and compressed bytes opened at a time.
BLOCK = 1 << 18
#: Ranges of documents for each partition of the input.
RANGES = 4
U = np.uint64


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of BINS entries for each text of a block; 0 marks an empty bin.  A text below
    KMER bytes is its own only k-mer; an empty text has empty bins.  Rows depend on their
    texts alone."""
    n = len(offsets) - 1
    out = np.zeros((n, BINS), np.uint16)
    size = np.diff(offsets)
    if n == 0 or len(data) == 0:
        return out
    bits = max(PLACE_BITS, (len(data) - 1).bit_length())
    roll = Rolling(data, 53)
    own = np.minimum(size, KMER)
    counts = np.where(size > 0, size - own + 1, 0)
    text = np.repeat(np.arange(n), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][text]
    h = roll.spans(start, start + own[text])
    # number the occurrences of a k-mer within its text
    key = (h >> U(bits)) << U(bits) | start.astype(U)
    key.sort()
    place = (key & U((1 << bits) - 1)).astype(np.int64)
    owner = np.searchsorted(offsets, place, "right") - 1
    first = np.concatenate(([True], ((key[1:] ^ key[:-1]) >> U(bits) != 0) | (owner[1:] != owner[:-1])))
    nth = np.arange(len(key)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    g = mix((key >> U(bits)) * U(0x9E3779B97F4A7C15) + mix(nth.astype(U)))
    # the least of each text's bins: text | bin | value | place
    from_start = (place - offsets[:-1][owner]).astype(U)
    low = (g >> U(64 - BIN_BITS - VALUE_BITS)) << U(bits) | from_start
    order = (owner.astype(U) << U(BIN_BITS + VALUE_BITS + bits)) | low if n > 1 else low
    at = np.argsort(order)
    bin_key = order[at] >> U(VALUE_BITS + bits)
    head = np.flatnonzero(np.concatenate(([True], bin_key[1:] != bin_key[:-1])))
    tail = np.append(head[1:], len(at))
    picks = np.minimum(head[:, None] + np.arange(TUPLE), tail[:, None] - 1)
    chosen = at[picks]
    where, hashes = from_start[chosen], g[chosen]
    turn = np.argsort(where, axis=1, kind="stable")
    hashes = np.take_along_axis(hashes, turn, 1)
    entry = mix((tail - head < TUPLE).astype(U))
    for j in range(TUPLE):
        entry = mix(entry * U(31) + hashes[:, j])
    rows = owner[at[head]]
    bins = (g[at[head]] >> U(64 - BIN_BITS)).astype(np.int64)
    out[rows, bins] = (entry % U(65535)).astype(np.uint16) + 1
    return out


def sketch(texts: list[str]) -> np.ndarray:
    """Signatures of any texts, in blocks of bounded size."""
    out = []
    for lo in range(0, len(texts), TEXTS):
        for _, _, data, offsets in text_blocks(pa.array(texts[lo : lo + TEXTS], pa.string()), BLOCK):
            out.append(signatures(data, offsets))
    return np.concatenate(out) if out else np.zeros((0, BINS), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal entries among the bins that either text fills; 1 for two empty texts."""
    either = (a > 0) | (b > 0)
    filled = either.sum(1)
    return np.where(filled == 0, 1.0, ((a == b) & either).sum(1) / np.maximum(filled, 1))


def as_text(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature.astype(">u2")]


@F.arrow_udf(StringType())
def fingerprint_udf(text: pa.Array) -> pa.Array:
    return pa.array(as_text(sketch(text.fill_null("").to_pylist())), pa.string())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs(doc_id, text)``; null is the empty text."""
    return docs.select("doc_id", fingerprint_udf("text").alias("fingerprint"))


# -- neighbours ----------------------------------------------------------------------------


@F.arrow_udf(BinaryType())
def squeezed(text: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=1)
    return pa.array([pack.compress((x or "").encode()) for x in text.to_pylist()], pa.binary())


def ranges(docs: DataFrame, per: int = RANGES) -> list[int]:
    """Descending doc_ids at which ranges begin: quantiles, a few for each partition."""
    n = per * docs.rdd.getNumPartitions()
    shares = [i / n for i in range(1, n)]
    found = docs.where("doc_id is not null").select("doc_id").approxQuantile("doc_id", shares, 0.25 / n) if shares else []
    return sorted({int(x) for x in found}, reverse=True)


def with_next(docs: DataFrame, per: int = RANGES) -> DataFrame:
    """(range, guest, doc_id, t, z) of all documents: z the compressed text, t its hash.  Ranges
    descend by doc_id; rows without one come last, in 64 ranges by hash.  A guest is (a copy
    of) the first document of the range after, or of the first range in the last."""
    edges = np.array(ranges(docs, per)[::-1], np.int64)

    def range_of(doc_id: pa.Array, t: pa.Array) -> pa.Array:
        ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
        own = len(edges) - np.searchsorted(edges, ids, "right")
        none = len(edges) + 1 + ((t.to_numpy(zero_copy_only=False) >> 58) + 32)
        return pa.array(np.where(doc_id.is_null().to_numpy(zero_copy_only=False), none, own))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    own = own.withColumn("range", F.arrow_udf(range_of, LongType())("doc_id", "t"))
    # the first key of each range: a few rows for each partition of the input
    heads = own.groupBy("range").agg(F.max("doc_id").alias("id"), F.min(F.when(F.col("doc_id").isNull(), F.col("t"))).alias("t")).orderBy("range").collect()
    if not heads:
        return own.selectExpr("range", "false as guest", "doc_id", "t", "cast(null as binary) as z")
    before = {heads[i]["range"]: heads[i - 1]["range"] for i in range(len(heads))}
    first = {h["range"]: (h["id"], h["t"]) for h in heads}

    def places(own: pa.Array, doc_id: pa.Array, t: pa.Array) -> pa.Array:
        out = []
        for r, i, x in zip(own.to_pylist(), doc_id.to_pylist(), t.to_pylist(), strict=True):
            leads = first[r][0] == i if i is not None else first[r][1] == x
            out.append([r, -1 - before[r]] if leads else [r])
        return pa.array(out, pa.list_(pa.int64()))

    both = own.withColumn("to", F.explode(F.arrow_udf(places, "array<long>")("range", "doc_id", "t")))
    guest = F.col("to") < 0
    return both.select(F.when(guest, -1 - F.col("to")).otherwise(F.col("to")).alias("range"), guest.alias("guest"), "doc_id", "t", squeezed("text").alias("z"))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame, per: int = RANGES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next
    of every row of ``docs(doc_id, text)``.

    Null is the empty text.  The next document is that of the next smaller doc_id, after the
    last the first; rows of one doc_id are ordered by the hash of their text, and rows without
    one come last.  A document alone is its own next.  Other columns are not read.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: tuple[int, int | None, str, np.ndarray] | None = None  # a row whose next is still to come
        ended = -1  # the range whose guest has come
        for batch in batches:
            z = batch.column("z")
            keys = list(zip(batch.column("range").to_pylist(), batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), strict=True))
            for lo, hi in cut(np.concatenate(([0], np.cumsum(pc.binary_length(z).to_numpy(zero_copy_only=False)))), BLOCK):
                texts = [unpack.decompress(x.as_py()).decode() for x in z[lo:hi]]
                sigs = sketch(texts)
                rows = []
                for (r, guest, i), text, sig in zip(keys[lo:hi], texts, sigs, strict=True):
                    if r == ended:
                        continue  # further guests: rows that tie with the first
                    if held is not None:
                        rows.append((*held[1:], text, sig))
                    held = None if guest else (r, i, text, sig)
                    ended = r if guest else ended
                yield from emit(rows)
            release()

    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(rows), 512):
            part = rows[lo : lo + 512]
            edited = [text[: len(text) - len(text) // 2] + after[: len(text) // 2] for _, text, _, after, _ in part]
            own, own_edited, following = np.stack([r[2] for r in part]), sketch(edited), np.stack([r[4] for r in part])
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in part], pa.int64()), pa.array([len(r[1]) for r in part], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()), pa.array(as_text(own), pa.string()),
                pa.array(as_text(own_edited), pa.string()), pa.array(likeness(own, own_edited)), pa.array(likeness(own, following)),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows = with_next(docs, per).repartition("range")
    return rows.sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "t").mapInArrow(pairs, RESULT)
