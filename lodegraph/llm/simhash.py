"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint is the majority vote of the XXH64 hashes of a text's word shingles.
Two fingerprints link when they differ in at most ``TAU`` bits.  To find the links,
the 64 bits are grouped so that correlated bits share a partition, every partition
gets a threshold of its own with sum ``TAU - partitions + 1`` (-1 leaves it out), and
pairs that agree within the threshold of a partition are verified on all 64 bits.
Thresholds come from dynamic programming on candidate counts estimated from the
partitions' value histograms over all fingerprints.

Copies of a text collapse to one fingerprint before any candidate is made.  A bucket
of over ``BLOCK`` fingerprints is split into blocks that are compared pair by pair,
and each comparison emits a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .blocks import LOWER, durable, small_batches, unkept
from .components import components

TAU = 4
SHINGLE = 4
SEED = 42
CHUNK_BITS = 16
BLOCK = 4096
#: What a shuffled probe row costs, in verified pairs.
PROBE_COST = 30.0
_LOWER = LOWER.tobytes()
U = np.uint64


def fingerprint(text: str | None) -> int:
    """Unsigned SimHash; 0 for a null text or one without words."""
    words = text.encode().translate(_LOWER).split() if text else []
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    size = min(SHINGLE, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 65536):
        span = zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in span], "<u8")
        votes += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprint_udf(text: pa.Array) -> pa.Array:
    unkept()
    return pa.array(np.array([fingerprint(x) for x in text.to_pylist()], U).view(np.int64))


# -- partitions and thresholds ------------------------------------------------------


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def take(fp: np.ndarray, places: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), U)
    for k, b in enumerate(places):
        out |= ((fp >> U(b)) & U(1)) << U(k)
    return out


def _fps(batch: pa.RecordBatch, name: str = "fp") -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(U)


def correlated_chunks(fps: DataFrame) -> list[list[int]]:
    """Four groups of 16 bits, each grown by the bit that correlates most with it."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65))
        for batch in batches:
            x = np.ones((batch.num_rows, 65), np.float32)
            x[:, :64] = bits_of(_fps(batch))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65)), pa.array(total.ravel())], names=["k", "v"])

    m = np.zeros(65 * 65)
    for k, v in fps.mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v")).collect():  # 4225 rows
        m[k] = v
    m = m.reshape(65, 65)
    n = max(m[64, 64], 1.0)
    mean = m[64, :64] / n
    cov = m[:64, :64] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, chunks = set(range(64)), []
    while left:
        own = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(own[0])
        while left and len(own) < CHUNK_BITS:
            own.append(max(sorted(left), key=lambda b: corr[b, own].sum()))
            left.discard(own[-1])
        chunks.append(sorted(own))
    return chunks


def distance_shares(fps: DataFrame, chunks: list[list[int]]) -> tuple[float, list[np.ndarray]]:
    """The number of fingerprints, and for each chunk the share of pairs at each distance."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(chunks), 1 << CHUNK_BITS), np.int64)
        for batch in batches:
            fp = _fps(batch)
            for i, places in enumerate(chunks):
                held[i] += np.bincount(take(fp, places).astype(np.int64), minlength=1 << CHUNK_BITS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held.ravel()[at])], names=["k", "v"])

    f = np.zeros(len(chunks) << CHUNK_BITS)
    for k, v in fps.mapInArrow(histogram, "k long, v long").groupBy("k").agg(F.sum("v")).collect():  # 4 * 2**16 rows at most
        f[k] = v
    f = f.reshape(len(chunks), -1)
    n = f[0].sum()
    ones = np.array([bin(x).count("1") for x in range(1 << CHUNK_BITS)])
    shares = []
    for own in f:
        pairs = _walsh(_walsh(own) ** 2) / (1 << CHUNK_BITS)
        shares.append(np.maximum(np.bincount(ones, weights=pairs), 0) / max(n * n, 1.0))
    return n, shares


def _walsh(x: np.ndarray) -> np.ndarray:
    x, h = x.astype(float), 1
    while h < len(x):
        y = x.reshape(-1, 2, h)
        x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], 1).reshape(-1)
        h *= 2
    return x


def allocate(n: float, chunks: list[list[int]], shares: list[np.ndarray], tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition: the cheaper of four partitions of one chunk and
    two of two chunks, each with its cheapest thresholds.  Chunks joined in one partition
    are taken as independent."""
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for per in (1, 2):
        parts = [sum(chunks[i : i + per], []) for i in range(0, len(chunks), per)]
        near = []
        for i in range(0, len(chunks), per):
            p = shares[i]
            for other in shares[i + 1 : i + per]:
                p = np.convolve(p, other)
            near.append(np.cumsum(p))
        spare = tau - len(parts) + 1
        cost = [{t: 0.0 if t < 0 else n * n * near[i][t] / 2 + PROBE_COST * n * sum(comb(len(bits), r) for r in range(t + 1)) for t in range(-1, tau + 1)} for i, bits in enumerate(parts)]
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (paid, own) in state.items():
                for t, price in c.items():
                    if paid + price < after.get(used + t, (np.inf, []))[0]:
                        after[used + t] = (paid + price, [*own, t])
            state = after
        paid, own = state[spare]
        if paid < best[0]:
            best = (paid, [(bits, t) for bits, t in zip(parts, own, strict=True) if t >= 0])
    return best[1]


# -- probe and verify ----------------------------------------------------------------


def signatures(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(bucket, fp): each fingerprint under its own value in every partition, and under the
    larger values within the threshold (of two values, one is the larger)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _fps(batch)
            for i, (places, t) in enumerate(plan):
                value = take(fp, places)
                base = U(i << 40)
                yield pa.RecordBatch.from_arrays([pa.array((value | base).view(np.int64)), pa.array(fp.view(np.int64))], names=["bucket", "fp"])
                masks = [sum(1 << b for b in own) for r in range(1, t + 1) for own in combinations(range(len(places)), r)]
                for at in range(0, len(masks), 32):
                    m = np.array(masks[at : at + 32], U)[:, None]
                    to = value[None, :] ^ m
                    row, col = np.nonzero(to > value[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array((to[row, col] | base).view(np.int64)), pa.array(fp[col].view(np.int64))], names=["bucket", "fp"])

    return fps.select("fp").mapInArrow(expand, "bucket long, fp long")


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of a[i] and b[i]; a label is the least row of its set."""
    while True:
        la, lb = label[a], label[b]
        on = la != lb
        if not on.any():
            return label
        a, b, la, lb = a[on], b[on], la[on], lb[on]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def forest(group: np.ndarray, fp: np.ndarray, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among rows of equal (adjacent) group that differ in tau bits or fewer."""
    n = len(fp)
    label = np.arange(n)
    ends = np.searchsorted(group, group, "right")
    rows, step, a, b, held = np.arange(n), 1, [], [], 0
    while True:
        rows = rows[rows + step < ends[rows]]
        if len(rows) == 0:
            break
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + step]) <= tau]
        a.append(near)
        b.append(near + step)
        held += len(near)
        if held > 500_000:
            label, a, b, held = unite(label, np.concatenate(a), np.concatenate(b)), [], [], 0
        step += 1
    if held:
        label = unite(label, np.concatenate(a), np.concatenate(b))
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def _verify(tau: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_f = np.zeros(0, np.int64), np.zeros(0, U)
        for batch in batches:
            held_g = np.concatenate((held_g, batch.column("part").to_numpy()))
            held_f = np.concatenate((held_f, _fps(batch)))
            if len(held_g) < 50_000:
                continue
            end = int(np.searchsorted(held_g, held_g[-1]))
            yield links(held_g[:end], held_f[:end])
            held_g, held_f = held_g[end:], held_f[end:]
        yield links(held_g, held_f)

    def links(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = forest(group, fp, tau)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return verify


def similar(fps: DataFrame, tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among distinct fingerprints whose components are those of all pairs at
    ``tau`` bits or fewer."""
    chunks = correlated_chunks(fps)
    n, shares = distance_shares(fps, chunks)
    rows = signatures(fps, allocate(n, chunks, shares, tau))
    hot = rows.groupBy("bucket").count().where(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("n"))
    mine, other = F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1))).cast("int"), F.col("o")
    rows = (
        rows.join(hot, "bucket", "left")
        .select("bucket", "fp", mine.alias("o0"), F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("o"))
        .select(F.xxhash64("bucket", F.least("o0", other), F.greatest("o0", other)).alias("part"), "fp")
    )
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(_verify(tau), "a long, b long").distinct()


def classes(rows: DataFrame, tau: int = TAU) -> DataFrame:
    """(fp, component_id, root) of every fingerprint in rows (doc_id, fp): the least doc_id that a
    chain of links reaches, null if all its documents' ids are null, and a fingerprint that stands
    for the component."""
    groups = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(similar(groups, tau))
    label = groups.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    label = durable(label)
    least = label.groupBy("root").agg(F.min("least").alias("component_id"))
    return label.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """doc_id, fp (signed) and component_id of every row of ``docs(doc_id, text)``.

    Null and wordless texts have fingerprint 0 and link like any other; repeated rows stay
    repeated; other columns are not read; an empty table gives no rows.
    """
    return _rooted(docs, tau).drop("root")


def _rooted(docs: DataFrame, tau: int) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = durable(docs.select("doc_id", fingerprint_udf("text").alias("fp")))
    return rows.join(classes(rows, tau), "fp")


def keep_one(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, that of the least doc_id; all
    columns stay.  Null ids come last; of rows with one id, any one stays."""
    found = _rooted(docs, tau).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = durable(found.select("doc_id", "fp", "root"))
    if chosen.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.join(chosen.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    # ids repeat or are null: rows are told apart by their fingerprints as well, and travel in a struct of their own
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row, F.col("doc_id").alias("id"), fingerprint_udf("text").alias("fp"))
    kept = chosen.distinct().toDF("kept_id", "kept_fp", "root")
    both = own.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("fp") == F.col("kept_fp"))).dropDuplicates(["root"])
    return both.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
