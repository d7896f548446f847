"""Exact top-k inner products by Fagin's threshold algorithm over sorted lists.

Queries are broadcast, in slices of at most ``SLICE_BYTES``, to the partitions of the candidates,
which are packed into blocks as they are read.  A candidate block holds one sorted list of
its vectors per dimension.  For a query the lists are read in step, each from the end that
adds most to the score; what turns up is scored in full, and reading stops when the bound,
the score of a vector made of the values reached so far, is below the kth result of all blocks
of the partition so far.  Partitions give k rows a query, which a grouped top-k brings together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import durable

QUERY_BLOCK = 256
#: Bytes of query vectors broadcast at a time; more take further passes over the candidates.
SLICE_BYTES = 32 << 20
BLOCK = 8192
FIRST_DEPTH = 16
SCALE = 256
#: Sums of products below this are whole in a double.
EXACT = 2.0**53


def whole(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the components as whole numbers, of rows whose vectors are whole too."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return docs.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v"))


def packs(rows: DataFrame, size: int) -> DataFrame:
    """(dims, n, ids, vectors): blocks of at most ``size`` rows of one length, as they are read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            vectors = batch.column("v")
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                own = held.setdefault(int(d), [])
                own.append((ids[at], flat[starts[at][:, None] + np.arange(d)]))
                if sum(len(i) for i, _ in own) >= size:
                    yield from out(int(d), held.pop(int(d)), False)
        for d, own in held.items():
            yield from out(d, own, True)

    def out(d: int, own: list[tuple[np.ndarray, np.ndarray]], last: bool) -> Iterator[pa.RecordBatch]:
        ids, v = np.concatenate([i for i, _ in own]), np.concatenate([x for _, x in own])
        for lo in range(0, len(ids), size):
            i, x = ids[lo : lo + size].astype("<i8"), v[lo : lo + size].astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(i)], pa.int32()), pa.array([i.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["dims", "n", "ids", "vectors"])

    return rows.mapInArrow(pack, "dims int, n int, ids binary, vectors binary")


class Lists:
    """A candidate block: its vectors and, for every dimension, their order by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.v = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(vectors.T, self.order, 1)
        self.scored = 0  # rows, over all queries

    def top(self, own_id: int, q: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best by score, then smaller id, of this block and of ``best``, those of
        earlier ones; rows with own_id take no part."""
        n = len(self.ids)
        seen = self.ids == own_id
        used = np.flatnonzero(q)  # a list of weight 0 adds nothing, wherever it is read
        falling = q[used] > 0
        best_i, best_s = best or (np.zeros(0, np.int64), np.zeros(0, q.dtype))
        done, depth = 0, FIRST_DEPTH
        while True:
            depth = min(depth, n)
            if len(used) and depth < n:
                high = self.order[used[falling], n - depth : n - done].ravel()
                low = self.order[used[~falling], done:depth].ravel()
                fresh = np.zeros(n, bool)
                fresh[high] = fresh[low] = True
                rows = np.flatnonzero(fresh & ~seen)
            else:
                rows, depth = np.flatnonzero(~seen), n
            seen[rows] = True
            self.scored += len(rows)
            i, s = np.concatenate((best_i, self.ids[rows])), np.concatenate((best_s, self.v[rows] @ q))
            if len(s) > 4 * k:
                cut = np.partition(s, len(s) - k)[len(s) - k]
                i, s = i[s >= cut], s[s >= cut]
            at = np.lexsort((i, -s))[:k]
            best_i, best_s = i[at], s[at]
            if depth >= n:
                return best_i, best_s
            reached = np.where(falling, self.sorted[used, n - depth], self.sorted[used, depth - 1])
            if len(best_s) == k and reached @ q[used] < best_s[-1]:
                return best_i, best_s  # an unseen row could at most equal the bound
            done, depth = depth, 4 * depth


def unpacked(dims: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(vectors, "<i8").reshape(len(i), dims)


def slices(asked: DataFrame, most: int) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Query blocks (number of the first query, dims, ids, vectors), up to ``most`` bytes at a time."""
    held, size, number = [], 0, 0
    for r in asked.toLocalIterator():
        ids, v = unpacked(r["dims"], bytes(r["ids"]), bytes(r["vectors"]))
        if held and size + v.nbytes > most:
            yield held
            held, size = [], 0
        held.append((number, r["dims"], ids, v))
        number += len(ids)
        size += v.nbytes
    if held:
        yield held


def _searched(stored: DataFrame, asked: list[tuple[int, int, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(q, query_id, vec_id, score): the k best of each partition of candidates for each query."""
    held = stored.sparkSession.sparkContext.broadcast(asked)
    largest = lambda x: float(np.abs(x.astype(float)).max(initial=0))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        tops = [largest(v) for _, _, _, v in held.value]
        for batch in batches:
            for r in range(batch.num_rows):
                dims = batch.column("dims")[r].as_py()
                ids, v = unpacked(dims, *(batch.column(c)[r].as_py() for c in ("ids", "vectors")))
                most, made = largest(v), {}
                for (number, own, q_ids, q), top in zip(held.value, tops, strict=True):
                    if own != dims:
                        continue
                    kind = float if top * most * max(1, dims) < EXACT else np.int64
                    if kind not in made:
                        made[kind] = Lists(ids, v.astype(kind))
                    for j, (i, x) in enumerate(zip(q_ids, q.astype(kind), strict=True), number):
                        found_i, found_s = made[kind].top(i, x, k, best.get(j))
                        best[j] = found_i, found_s.astype(np.int64)  # whole in a double
        for number, _, q_ids, _ in held.value:
            own = [best.get(j) or (np.zeros(0, np.int64), np.zeros(0, np.int64)) for j in range(number, number + len(q_ids))]
            sizes = [len(i) for i, _ in own]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(number, number + len(own)), sizes)), pa.array(np.repeat(q_ids, sizes)),
                pa.array(np.concatenate([i for i, _ in own])), pa.array(np.concatenate([s for _, s in own])),
            ], names=["q", "query_id", "vec_id", "score"])

    return stored.mapInArrow(search, "q long, query_id long, vec_id long, score long")


def nearest(docs: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK, most: int = SLICE_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of ``docs(vec_id, embedding)`` of highest
    inner product with each row of ``queries``, ties to the smaller vec_id.

    Vectors that are null or hold a null or non-finite component, and rows without an id, take
    no part; vectors meet those of their own length only.  Rows with the query's vec_id are not
    its candidates.  A repeated query row has results of its own; a repeated candidate counts as
    often as it is there.  Sums beyond 2**53 are taken in 64-bit integers, which wrap.  Empty tables
    of either kind give no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    asked = durable(packs(whole(queries), query_block))
    stored = packs(whole(docs), block)
    each: DataFrame | None = None
    parts = slices(asked, most)
    part = next(parts, None)
    while part is not None:
        after = next(parts, None)
        own = _searched(stored, part, k)
        if each is not None or after is not None:
            own = durable(own)  # one slice is broadcast at a time
        each = own if each is None else each.union(own)
        part = after
    if each is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
