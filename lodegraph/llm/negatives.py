"""Hard negatives from k-means inverted lists with stored radii.

Centroids come from a bounded sample; every row goes to the list of its nearest one, and lists are
stored in blocks, each with the largest distance of its rows from the centroid.  By Cauchy-Schwarz
the inner product of an anchor with any row of a block is within |anchor| x radius of that with the
centroid.  A search visits the blocks that a task holds by that upper bound, skips those outside the
wanted window of scores, and stops when the bound is strictly below the kth score so far.  Anchors are
broadcast in slices of bounded size; a first look at their own lists alone gives each a score that
its kth result cannot be below, so that other tasks skip most lists at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import durable
from .topk import EXACT, SCALE

#: Lists, and the most rows that their centroids are learned from.
CLUSTERS, SAMPLE, ROUNDS = 64, 8192, 10
#: Rows of a block, bytes of blocks that a task holds at once, bytes of anchors broadcast at once.
BLOCK, HELD_BYTES, SLICE_BYTES = 2048, 32 << 20, 32 << 20
Centroids = dict[int, np.ndarray]


class Block(NamedTuple):
    """Rows of one list in the order of labels, or anchors (then ``first`` numbers them)."""

    dims: int
    cluster: int
    first: int
    radius: float
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray


def usable(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and whole components of the rows that have all of them."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return docs.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


def fit(rows: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Centroids:
    """Centroids for each length of vector, by Lloyd's rounds over at most ``sample`` rows whose
    hashes are least."""
    n = rows.count()
    h = F.pmod(F.xxhash64("vec_id"), F.lit(2**31))
    chosen = rows.where(h < 2**31 * min(1.0, 2 * sample / max(1, n))).orderBy(h, "vec_id").limit(sample)
    by_size: dict[int, list[list[int]]] = {}
    for r in chosen.select("v").collect():
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    out: Centroids = {}
    for dims, vectors in by_size.items():
        x = np.unique(np.array(vectors, float).reshape(len(vectors), dims), axis=0)
        c = x[np.random.default_rng(13).permutation(len(x))[:clusters]]
        for _ in range(ROUNDS):
            own = _nearest(x, c)
            c = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))]).reshape(-1, dims)
        out[dims] = c
    return out


def _of(centroids: Centroids, dims: int) -> np.ndarray:
    """Lengths that the sample has not shown have one list, around the origin."""
    return centroids.get(dims, np.zeros((1, dims)))


def _lengths(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, rows, vectors) of a batch, for each length of vector."""
    lists = batch.column("v")
    size = np.diff(lists.offsets.to_numpy())
    flat, start = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size)[:-1]))
    for dims in np.unique(size):
        at = np.flatnonzero(size == dims)
        yield int(dims), at, flat[start[at][:, None] + np.arange(dims)]


def listed(rows: DataFrame, centroids: Centroids, block: int = BLOCK) -> DataFrame:
    """The inverted lists of ``usable`` rows, as blocks; a list is sorted by label and may lie in
    several partitions, so that a list of a third of all rows is no task's alone."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cluster = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for d, at, x in _lengths(batch):
                dims[at], cluster[at] = d, _nearest(x.astype(float), _of(held.value, d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cluster)], names=[*batch.schema.names, "dims", "cluster"])

    dealt = rows.mapInArrow(assign, "vec_id long, label long, v array<bigint>, dims int, cluster int")
    # ranges, not hashes: a large list is cut by label and id
    dealt = dealt.repartitionByRange("dims", "cluster", "label", "vec_id").sortWithinPartitions("dims", "cluster", "label", "vec_id")
    return _packed(dealt, lambda dims: _of(held.value, dims), block)


def _packed(rows: DataFrame, centers: Callable[[int], np.ndarray], block: int) -> DataFrame:
    """Blocks of at most ``block`` rows of one length and list, from rows in that order."""

    def out(own: list[tuple[np.ndarray, np.ndarray, np.ndarray]], dims: int, cluster: int) -> pa.RecordBatch:
        ids, labels, v = (np.concatenate(x) for x in zip(*own, strict=True))
        far = v - centers(dims)[cluster]
        radius = float(np.sqrt((far * far).sum(1)).max())
        values: list[tuple[Any, pa.DataType]] = [(dims, pa.int32()), (cluster, pa.int32()), (radius, pa.float64()), *((x.astype("<i8").tobytes(), pa.binary()) for x in (ids, labels, v))]
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in values], names=["dims", "cluster", "radius", "ids", "labels", "vectors"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, size = (-1, -1), 0
        for batch in batches:
            ids, labels, lists = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "cluster"))
            for dims, rows_at, x in _lengths(batch):
                cuts = np.flatnonzero(np.diff(lists[rows_at])) + 1
                for part in np.split(np.arange(len(rows_at)), cuts):
                    key = dims, int(lists[rows_at[part[0]]])
                    if own and key != at:
                        yield out(own, *at)
                        own, size = [], 0
                    at, lo = key, 0
                    while lo < len(part):
                        some = part[lo : lo + block - size]
                        own.append((ids[rows_at[some]], labels[rows_at[some]], x[some]))
                        size, lo = size + len(some), lo + len(some)
                        if size == block:
                            yield out(own, *at)
                            own, size = [], 0
        if own:
            yield out(own, *at)

    return rows.mapInArrow(pack, "dims int, cluster int, radius double, ids binary, labels binary, vectors binary")


def _block(dims: int, cluster: int, radius: float, ids: bytes, labels: bytes, vectors: bytes, first: int = 0) -> Block:
    i = np.frombuffer(ids, "<i8")
    return Block(dims, cluster, first, radius, i, np.frombuffer(labels, "<i8"), np.frombuffer(vectors, "<i8").reshape(len(i), dims))


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[Block]]:
    """The blocks of a task, as many at a time as ``most`` bytes hold."""
    own: list[Block] = []
    size = 0
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("dims", "cluster", "radius", "ids", "labels", "vectors")), strict=True):
            own.append(_block(*r))
            size += own[-1].v.nbytes
            if size >= most:
                yield own
                own, size = [], 0
    if own:
        yield own


class Visit:
    """Blocks of one length met with the anchors of one block: bounds, and scores as whole numbers."""

    def __init__(self, anchors: Block, blocks: Sequence[Block], centroids: Centroids):
        self.anchors = anchors
        self.blocks = [b for b in blocks if b.dims == anchors.dims]
        if not self.blocks:
            return
        centers = _of(centroids, anchors.dims)
        q, own = anchors.v.astype(float), np.array([b.cluster for b in self.blocks])
        middle = (q @ centers.T)[:, own]
        spread = np.sqrt((q * q).sum(1))[:, None] * np.array([b.radius for b in self.blocks])
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-6  # more than the sums can be off
        self.upper, self.lower = middle + spread + slack, middle - spread - slack
        self.order = np.argsort(-self.upper, axis=1, kind="stable")
        self.home = own[None, :] == _nearest(q, centers)[:, None]
        largest = max(float(np.abs(b.v.astype(float)).max(initial=0)) for b in self.blocks) * float(np.abs(q).max(initial=0))
        self.kind = np.float64 if largest * max(1, anchors.dims) < EXACT else np.int64
        self.v = [b.v.astype(self.kind) for b in self.blocks]
        self.q = anchors.v.astype(self.kind)
        self.visited = 0  # blocks, over all anchors

    def scores(self, j: int, b: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the rows of block b of anchor j's label, or of all other labels."""
        self.visited += 1
        block, label = self.blocks[b], self.anchors.labels[j]
        lo, hi = np.searchsorted(block.labels, [label, label + 1])
        if same:
            i, s = block.ids[lo:hi], self.v[b][lo:hi] @ self.q[j]
        else:
            i, s = np.delete(block.ids, np.s_[lo:hi]), np.delete(self.v[b] @ self.q[j], np.s_[lo:hi])
        other = i != self.anchors.ids[j]
        return i[other], s[other].astype(np.int64)


Found = tuple[np.ndarray, np.ndarray]
NONE: Found = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _best(a: Found, i: np.ndarray, s: np.ndarray, k: int) -> Found:
    i, s = np.concatenate((a[0], i)), np.concatenate((a[1], s))
    if len(s) > 4 * k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        i, s = i[s >= cut], s[s >= cut]
    at = np.lexsort((i, -s))[:k]
    return i[at], s[at]


def search_same(visit: Visit, j: int, k: int, best: Found, floor: int | None, home: bool) -> Found:
    """The k best of anchor j's label, none below ``floor``; in its own list alone if ``home``."""
    for b in visit.order[j]:
        if home and not visit.home[j, b]:
            continue
        need = int(best[1][-1]) if len(best[1]) == k else floor
        if floor is not None and (need is None or need < floor):
            need = floor
        if need is not None and visit.upper[j, b] < need:
            break
        i, s = visit.scores(j, int(b), True)
        if need is not None:
            i, s = i[s >= need], s[s >= need]
        best = _best(best, i, s, k)
    return best


def search_other(visit: Visit, j: int, k: int, windows: list[tuple[int, int]], best: list[Found]) -> list[Found]:
    """For each window (least, most) of scores: the k best of other labels than anchor j's."""
    open_at = [w for w, (lo, hi) in enumerate(windows) if lo <= hi]
    if not open_at:
        return best
    best, top = list(best), max(windows[w][1] for w in open_at)
    for b in visit.order[j]:
        need = {w: int(best[w][1][-1]) if len(best[w][1]) == k else windows[w][0] for w in open_at}
        if visit.upper[j, b] < min(need.values()):
            break
        if visit.lower[j, b] > top:
            continue
        i, s = visit.scores(j, int(b), False)
        for w in open_at:
            fit_in = (s >= need[w]) & (s <= windows[w][1])
            if fit_in.any():
                best[w] = _best(best[w], i[fit_in], s[fit_in], k)
    return best


def _rows(names: Sequence[str], columns: Sequence[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))


def _positives(lists: DataFrame, slice_: Any, centroids: Any, k: int, floors: dict[int, int], home: bool, most: int) -> DataFrame:
    """(q, vec_id, score): at most k rows of the anchor's label for anchor number q, from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Found] = {}
        for blocks in _held(batches, most):
            for anchors in slice_.value:
                visit = Visit(anchors, blocks, centroids.value)
                for j in range(len(anchors.ids) if visit.blocks else 0):
                    q = anchors.first + j
                    best[q] = search_same(visit, j, k, best.get(q, NONE), floors.get(q), home)
        rows = [(q, int(i), int(s)) for q, own in best.items() for i, s in zip(*own, strict=True)]
        yield _rows(("q", "vec_id", "score"), list(zip(*rows, strict=True)) or [[], [], []])

    return lists.mapInArrow(run, "q long, vec_id long, score long")


def _negatives(lists: DataFrame, slice_: Any, centroids: Any, k: int, wanted: Any, most: int) -> DataFrame:
    """(q, p, negative_id, negative_score): at most k rows of other labels for each window p of anchor q, from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[Found]] = {}
        for blocks in _held(batches, most):
            for anchors in slice_.value:
                visit = Visit(anchors, blocks, centroids.value)
                for j in range(len(anchors.ids) if visit.blocks else 0):
                    q = anchors.first + j
                    windows = wanted.value.get(q, [])
                    best[q] = search_other(visit, j, k, windows, best.get(q, [NONE] * len(windows)))
        rows = [(q, p, int(i), int(s)) for q, own in best.items() for p, found in enumerate(own) for i, s in zip(*found, strict=True)]
        yield _rows(("q", "p", "negative_id", "negative_score"), list(zip(*rows, strict=True)) or [[], [], [], []])

    return lists.mapInArrow(run, "q long, p long, negative_id long, negative_score long")


def _slices(asked: DataFrame, most: int) -> Iterator[list[Block]]:
    """Blocks of numbered anchors, up to ``most`` bytes at a time."""
    held: list[Block] = []
    size = number = 0
    for r in asked.toLocalIterator():
        own = _block(r["dims"], 0, 0.0, bytes(r["ids"]), bytes(r["labels"]), bytes(r["vectors"]), number)
        if held and size + own.v.nbytes > most:
            yield held
            held, size = [], 0
        held.append(own)
        number, size = number + len(own.ids), size + own.v.nbytes
    if held:
        yield held


def _ranked(found: DataFrame, by: list[str], k: int, score: str, ident: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), ident)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    docs: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 5, low: int = 80, high: int = 100,
    clusters: int = CLUSTERS, sample: int = SAMPLE, block: int = BLOCK, held: int = HELD_BYTES, most: int = SLICE_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A score is the whole inner product with the anchor.  The positives of a row of ``anchors`` are the
    best ``positives`` rows of ``docs(vec_id, embedding, label)`` of its label; for each, the k best rows
    of other labels with low x positive_score <= 100 x negative_score <= high x positive_score follow.
    Ties go to the smaller vec_id.

    Rows with a null id, label or vector, or a null or non-finite component take no part; vectors meet
    those of their own length only.  Rows with the anchor's vec_id are neither its positives nor its
    negatives.  A repeated anchor has results of its own, a repeated row counts as often as it is there.
    A window that holds no score (as of a negative positive_score, with low below high) gives no rows,
    and so do empty tables.  Other columns, whatever their names, are not read.  Sums beyond 2**53 are
    taken in 64-bit integers, which wrap.
    """
    spark = docs.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(docs)
    centroids = fit(rows, clusters, sample)
    lists = durable(listed(rows, centroids, block))
    origin = lambda dims: np.zeros((1, dims))
    asked = durable(_packed(usable(anchors).withColumn("cluster", F.lit(0)), origin, block))
    shared, each = spark.sparkContext.broadcast(centroids), None
    for blocks in _slices(asked, most):
        slice_ = spark.sparkContext.broadcast(blocks)
        # what an anchor finds in its own list, its kth result cannot be below
        first = _ranked(_positives(lists, slice_, shared, positives, {}, True, held), ["q"], positives, "score", "vec_id")
        floors = {r["q"]: r["score"] for r in first.where(F.col("rank") == positives).collect()}
        found = _ranked(_positives(lists, slice_, shared, positives, floors, False, held), ["q"], positives, "score", "vec_id")
        pairs: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(found.collect(), key=lambda r: (r["q"], r["rank"])):  # of this slice
            pairs.setdefault(r["q"], []).append((r["vec_id"], r["score"]))
        windows = {q: [(-(-low * s // 100), high * s // 100) for _, s in own] for q, own in pairs.items()}
        named = [(q, p, int(b.ids[q - b.first]), i, s) for b in blocks for q in range(b.first, b.first + len(b.ids)) for p, (i, s) in enumerate(pairs.get(q, []))]
        if not named:
            continue
        negatives = _ranked(_negatives(lists, slice_, shared, k, spark.sparkContext.broadcast(windows), held), ["q", "p"], k, "negative_score", "negative_id")
        head = spark.createDataFrame(named, "q long, p long, anchor_id long, positive_id long, positive_score long")
        own = durable(negatives.join(F.broadcast(head), ["q", "p"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        each = own if each is None else each.union(own)
    return each if each is not None else spark.createDataFrame([], out)
