"""Removal of repeated passages with suffix arrays and longest-previous-factor arrays.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts elsewhere.

1. Every window of ``WIDTH`` bytes has an anchor: its leftmost minimal k-mer hash.  Equal
   windows have equal anchors at equal places, so only windows of one anchor hash can
   be equal.  Successive windows with one anchor make up a context (at most
   ``2 * WIDTH - KMER`` bytes), held as its 64-bit anchor and context hashes.
2. Anchor hashes that occur once are pruned by a Bloom filter that grows with those that repeat,
   up to ``FILTER_BITS``; false positives, or a full filter, cost time and change nothing.
   Equal contexts of a batch of texts are one row with a list of places.
3. The distinct contexts of an anchor, those that repeat as they are among them, lie together in one
   task, which builds the suffix array of their concatenation to depth ``WIDTH``.  A context
   that repeats stands in the array twice, as its first copy and as any later one.  Previous
   and next smaller positions in suffix order give each window an earlier or a later equal.
   An anchor of over ``GROUP`` distinct contexts, which would not fit a task, is divided by the
   anchor's place in the windows into ``STEPS`` ranges: windows of one range share the bytes around it,
   whose hash deals them anew, with their distinct stretches in place of contexts.  What is still
   crowded is divided once more, into single places.
4. Marked windows return to their texts by a join; whatever they cover is cut out.

``keep="none"`` removes every copy (by the longest factor before or after), and
``keep="first"`` all but the first in order of doc_id, null last, and place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .blocks import BLOCK_BYTES, Rolling, durable, mix, packed, release, small_batches, unkept, utf8

WIDTH = 200
KMER = 32
SPAN = WIDTH - KMER + 1
PLACE_BITS = 24
GROUP = 2048
#: Into so many ranges the places of a crowded anchor in its windows are cut, twice: SPAN is the square.
STEPS = 13
FILTER_BITS = 1 << 28
ITEM_BITS = 12
PROBES = 4
#: Rows of one Arrow batch of contexts, and context hashes a task remembers as sent.
ROWS, SENT = 16_384, 1 << 21
SEGMENT = 8 << 20
U = np.uint64


# -- anchors --------------------------------------------------------------------------


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    rows[: len(x)] = x
    rows = rows.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


class Anchors:
    """Contexts of one block: anchor hash h, context hash c, text number, place of the anchor
    in the block, first and last window start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, contexts: bool = True):
        none = np.zeros(0, np.int64)
        self.h, self.c = np.zeros(0, U), np.zeros(0, U)
        self.text = self.place = self.first = self.last = none
        if len(data) < WIDTH:
            return
        roll = Rolling(data, 11)
        kmers = mix(roll.windows(KMER))
        low = U((1 << PLACE_BITS) - 1)
        least = sliding_min((kmers & ~low) | np.arange(len(kmers), dtype=U), SPAN)
        room = np.repeat(offsets[1:], np.diff(offsets))[: len(least)] - np.arange(len(least))
        starts = np.flatnonzero(room >= WIDTH)
        if len(starts) == 0:
            return
        place = (least[starts] & low).astype(np.int64)
        new = np.concatenate(([True], (np.diff(place) != 0) | (np.diff(starts) != 1)))
        at = np.flatnonzero(new)
        self.first, self.last, self.place = starts[at], starts[np.append(at[1:], len(starts)) - 1], place[at]
        self.text = np.searchsorted(offsets, self.first, "right") - 1
        self.h = mix(kmers[self.place] + U(0x9E3779B97F4A7C15))  # minima lie low: mixed again they deal evenly
        if not contexts:
            return
        sides = ((self.place - self.first) << 8 | (self.place - self.last)).astype(U)
        self.c = mix(Rolling(data, 23).spans(self.first, self.last + WIDTH) + mix(sides + U(1)))


def segments(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Blocks (first row, end row, bytes, offsets, place of the first byte in its text); a
    text of over SEGMENT bytes comes in pieces that share WIDTH - 1 bytes."""
    unkept()
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1))
        size = int(offsets[hi] - offsets[lo])
        if size <= SEGMENT:
            yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], 0
        else:
            for at in range(0, max(1, size - WIDTH + 1), SEGMENT):
                piece = data[offsets[lo] + at : min(offsets[hi], offsets[lo] + at + SEGMENT + WIDTH - 1)]
                yield lo, hi, piece, np.array([0, len(piece)]), at
        lo = hi
    release()


# -- pruning filter -------------------------------------------------------------------


def _probes(h: np.ndarray, size: int) -> np.ndarray:
    g = mix(h ^ U(0x9E3779B97F4A7C15))
    step = (g >> U(32)) | U(1)
    return ((g & U(0xFFFFFFFF))[None, :] + np.arange(PROBES, dtype=U)[:, None] * step[None, :]) % U(size)


def segment_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> U(64 - buckets.bit_length() + 1)).astype(np.int64)


class Filter:
    """A Bloom filter in one segment for each bucket of the hash's top bits."""

    def __init__(self, buckets: int, size: int, parts: dict[int, bytes]):
        self.buckets, self.size = buckets, size
        self.bits = np.zeros((buckets, size // 8), np.uint8)
        for b, held in parts.items():
            self.bits[b] = np.frombuffer(held, np.uint8)
        self.bits = self.bits.ravel()

    @staticmethod
    def part(h: np.ndarray, size: int) -> bytes:
        bits = np.zeros(size, bool)
        bits[_probes(h, size).ravel()] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def holds(self, h: np.ndarray) -> np.ndarray:
        base = (segment_of(h, self.buckets) * self.size).astype(U)
        out = np.ones(len(h), bool)
        for own in _probes(h, self.size):
            at = base + own
            out &= (self.bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) == 1
        return out


def _condensed(h: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and whether each is there twice or was marked so."""
    if len(h) == 0:
        return h, many
    order = np.argsort(h)
    h, many = h[order], many[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[at], np.logical_or.reduceat(many, at) | (np.diff(np.append(at, len(h))) > 1)


def repeated_filter(docs: DataFrame, buckets: int, most: int = FILTER_BITS) -> Filter:
    """A filter of the anchor hashes that repeat, of ITEM_BITS bits each and ``most`` in all."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, _, data, offsets, _ in segments(batch.column("text")):
                held.append(Anchors(data, offsets, False).h)
                size += len(held[-1])
                if size > 500_000:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        h, many = _condensed(np.concatenate(held), np.zeros(sum(map(len, held)), bool))
        edges = np.searchsorted(segment_of(h, buckets), np.arange(buckets + 1))
        full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        cut = [[x[edges[b] : edges[b + 1]].tobytes() for b in full] for x in (h, many)]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in cut)], names=["bucket", "h", "many"])

    def reduced(table: pa.Table) -> pa.Table:
        h, many = _condensed(np.concatenate(packed(table["h"], U)), np.concatenate(packed(table["many"], bool)))
        h = h[many]
        return pa.table({"bucket": table["bucket"][:1], "n": [len(h)], "h": pa.array([h.tobytes()], pa.binary())})

    repeated = durable(
        docs.select("text")
        .mapInArrow(gather, "bucket int, h binary, many binary")
        .groupBy("bucket")
        .applyInArrow(reduced, "bucket int, n long, h binary")
    )
    fullest = repeated.agg(F.coalesce(F.max("n"), F.lit(0))).head()[0]  # hashes deal them evenly
    size = min(max(1 << 10, -(-fullest * ITEM_BITS // 64) * 64), most // buckets)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [Filter.part(np.frombuffer(x.as_buffer(), U), size) for x in batch.column("h")]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(bits, pa.binary())], names=["bucket", "bits"])

    rows = repeated.select("bucket", "h").mapInArrow(parts, "bucket int, bits binary").toLocalIterator()  # ``most`` bits at most
    return Filter(buckets, size, {r["bucket"]: r["bits"] for r in rows})


# -- contexts and suffix arrays ----------------------------------------------------------


OCC = "array<struct<doc_id:long,t:long,loc:long>>"


def occurrences(docs: DataFrame, buckets: int) -> DataFrame:
    """A row for each batch of texts and distinct context in it whose anchor may repeat: (h, c, occ, ctx).
    occ: where it is, in order of doc_id, null last, text hash and place; ctx: its bytes, unless
    the task has sent them with an earlier batch.  loc: place of the anchor << 16 | bytes from the
    first and last start."""
    repeated = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs, buckets))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, U)
        for batch in batches:
            ids, t = batch.column("doc_id"), batch.column("t")
            key = np.lexsort((t.to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
            rank = np.empty(len(key), np.int64)
            rank[key] = np.arange(len(key))
            found: list[tuple[np.ndarray, ...]] = []
            for lo, _, data, offsets, shift in segments(batch.column("text")):
                own = Anchors(data, offsets)
                keep = np.flatnonzero(repeated.value.holds(own.h))
                place, first, last = own.place[keep], own.first[keep], own.last[keep]
                loc = (place - offsets[own.text[keep]] + shift) << 16 | (place - first) << 8 | (place - last)
                found.append((own.h[keep], own.c[keep], own.text[keep] + lo, loc))
            if not found:
                continue
            h, c, text, loc = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((loc, rank[text], c, h))
            h, c, text, loc = h[order], c[order], text[order], loc[order]
            lead = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))) if len(h) else np.zeros(0, np.int64)
            edges = np.append(lead, len(h))
            mark = h[lead] ^ c[lead]
            fresh = np.ones(len(lead), bool)
            if len(sent) and len(mark):
                at = np.minimum(np.searchsorted(sent, mark), len(sent) - 1)
                fresh = sent[at] != mark
            sent = np.union1d(sent, mark) if len(sent) + len(mark) < SENT else np.unique(mark)
            data, offsets = utf8(batch.column("text"))
            for lo in range(0, len(lead), ROWS):
                hi = min(len(lead), lo + ROWS)
                a, b = edges[lo], edges[hi]
                start = offsets[text[lead[lo:hi]]] + (loc[lead[lo:hi]] >> 16)
                back, ahead = loc[lead[lo:hi]] >> 8 & 255, loc[lead[lo:hi]] & 255
                ctx = [data[s - x : s - y + WIDTH].tobytes() if own else None for s, x, y, own in zip(start.tolist(), back.tolist(), ahead.tolist(), fresh[lo:hi].tolist(), strict=True)]
                rows = pa.array(text[a:b])
                occ = pa.StructArray.from_arrays([ids.take(rows), t.take(rows), pa.array(loc[a:b])], names=["doc_id", "t", "loc"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[lead[lo:hi]].view(np.int64)), pa.array(c[lead[lo:hi]].view(np.int64)), pa.ListArray.from_arrays(pa.array((edges[lo : hi + 1] - a).astype(np.int32)), occ), pa.array(ctx, pa.binary())],
                    names=["h", "c", "occ", "ctx"],
                )

    return docs.mapInArrow(scan, f"h long, c long, occ {OCC}, ctx binary")


def suffix_ranks(data: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Ranks of the suffixes of at most 2**20 bytes by their first ``depth`` bytes, equal for
    equal prefixes: prefix doubling over sorts of packed (rank, rank, place) keys."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(depth, np.uint8))).astype(U)
    place, key = np.arange(n, dtype=U), np.zeros(n, U)
    for i in range(5):
        key = key << U(8) | padded[i : i + n]
    rank, have = _ranked(key << U(20) | place), 5
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros(n, U)
        after[: n - step] = rank[step:] if step < n else 0
        rank = _ranked((rank << U(40)) | (after << U(20)) | place)
        have += step
    return rank


def _ranked(key: np.ndarray) -> np.ndarray:
    key.sort()
    top = key >> U(20)
    rank = np.empty(len(key), U)
    rank[(key & U((1 << 20) - 1)).astype(np.int64)] = np.concatenate(([0], np.cumsum(top[1:] != top[:-1]))).astype(U)
    return rank


def factors(rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous and the longest next factor of the suffixes at each place, of
    these ranks, reach the depth of the ranks.  In suffix order with ties as they come from an
    unstable order, the previous (next) smaller position of an entry lies in its run of equal
    ranks unless the entry is a prefix (suffix) minimum of the run; likewise for larger positions."""
    order = np.argsort(rank, kind="stable")
    r, p = rank[order], place[order].astype(np.int64)
    run = np.concatenate(([0], np.cumsum(r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
    wide = 1 << 22

    def smaller(p: np.ndarray) -> np.ndarray:
        left = p > np.minimum.accumulate(p - run * wide) + run * wide
        back = (run[-1] - run)[::-1] if len(run) else run
        right = p[::-1] > np.minimum.accumulate(p[::-1] - back * wide) + back * wide
        return left | right[::-1]

    earlier, later = np.empty(len(p), bool), np.empty(len(p), bool)
    earlier[order], later[order] = smaller(p), smaller(wide - p)
    return earlier, later


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, first, other, before, later): bit maps of the windows of each context, of its first copy
    equal to a window elsewhere and to one of an earlier place, and of its later copies equal to one
    of an earlier place.  Rows (h, c, first, k, ctx) come by h and, within h, by first."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8_binary(table["ctx"].combine_chunks())
        h, twice = table["h"].to_numpy(), table["k"].to_numpy() > 1
        lo = 0
        while lo < len(h):
            hi = int(np.searchsorted(offsets, offsets[lo] + (1 << 20), "right")) - 1
            if hi < len(h):
                hi = int(np.searchsorted(h[lo : hi + 1], h[hi])) + lo  # no group is cut
            own, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            counts = np.diff(off) - WIDTH + 1
            edges = np.concatenate(([0], np.cumsum(counts)))
            starts = np.repeat(off[:-1] - edges[:-1], counts) + np.arange(counts.sum())
            again = np.flatnonzero(np.repeat(twice[lo:hi], counts))  # windows of contexts that repeat
            ranks = suffix_ranks(own)[starts]
            # a later copy has its first one's ranks, and a position of its own behind it
            earlier, later = factors(np.concatenate((ranks, ranks[again])), np.concatenate((2 * starts, 2 * starts[again] + 1)))
            copy = np.zeros(len(starts), bool)
            copy[again] = earlier[len(starts) :]
            maps = (earlier[: len(starts)] | later[: len(starts)], earlier[: len(starts)], copy)
            full = [np.add.reduceat(x, edges[:-1]) for x in maps]
            bits = [[_bits(x[edges[i] : edges[i + 1]], int(n[i])) for i in range(hi - lo)] for x, n in zip(maps, full, strict=True)]
            release()
            own = pa.Table.from_arrays([*(table[c][lo:hi] for c in ("h", "c", "first")), *(pa.array(x, pa.binary()) for x in bits)], names=["h", "c", "first", "other", "before", "later"])
            yield from own.filter(own["other"].is_valid()).combine_chunks().to_batches()
            lo = hi

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 20_000:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        h = table["h"].to_numpy()
        end = int(np.searchsorted(h, h[-1]))
        yield from flush(table[:end])
        held = table[end:].to_batches()
        size = table.num_rows - end
    if held:
        yield from flush(pa.Table.from_batches(held).combine_chunks())


def _bits(x: np.ndarray, n: int) -> bytes | None:
    """A bit map; none where no bit is set, and an empty one where all are."""
    return None if n == 0 else b"" if n == len(x) else np.packbits(x, bitorder="little").tobytes()


def utf8_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


FIRST = "struct<u:boolean,doc_id:long,t:long,loc:long>"
MARKS = f"h long, c long, first {FIRST}, other binary, before binary, later binary"
PARTS = f"h long, c long, own {FIRST}, ctx binary, ph long, pc long, first {FIRST}, k long, at int, n int"


def marks(found: DataFrame, group: int = GROUP) -> DataFrame:
    """MARKS of the contexts that have a window elsewhere.  ``group``: most contexts of an anchor in one
    suffix array, 2,048 at most."""
    if not 0 < group <= GROUP:
        raise ValueError(group)
    head = F.col("occ")[0]
    own = found.select("h", "c", F.size("occ").cast("long").alias("k"), F.struct(head["doc_id"].isNull().alias("u"), head["doc_id"].alias("doc_id"), head["t"].alias("t"), head["loc"].alias("loc")).alias("first"), "ctx")
    return _marked(own, SPAN, group)


def _marked(own: DataFrame, wide: int, group: int) -> DataFrame:
    """MARKS of rows (h, c, k, first, ctx), whose windows' anchors stand at ``wide`` places of them."""
    hot = durable(own.select("h", "c").distinct().groupBy("h").count().where(F.col("count") > group).select("h"))
    calm, crowded = own, None
    if not hot.isEmpty():
        calm, crowded = own.join(hot, "h", "left_anti"), own.join(hot, "h", "left_semi")
    both = [F.sum("k").alias("k"), F.min("first").alias("first"), F.first("ctx", ignorenulls=True).alias("ctx")]
    out = calm.repartition("h").groupBy("h", "c").agg(*both).sortWithinPartitions("h", "first").select("h", "c", "first", "k", "ctx").mapInArrow(_mark, MARKS)
    if crowded is None:
        return out
    # windows with their anchor in one place are equal or unlike as a whole: at one place no group has two contexts
    wide = max(1, wide // STEPS)
    parts = durable(ranges(crowded.groupBy("h", "c").agg(*both), wide))
    under = _marked(parts.select("h", "c", "k", F.col("own").alias("first"), "ctx").groupBy("h", "c").agg(*both), wide, group)
    # a part has one row of marks at most, so no more rows come out than parts went in
    each = parts.drop("ctx").join(under.withColumnRenamed("first", "least"), ["h", "c"])
    before = F.when(F.col("own").eqNullSafe(F.col("least")), F.col("before")).otherwise(F.col("later"))
    found = [F.collect_list(F.when(x.isNotNull(), F.struct("at", "n", x.alias("bits")))).alias(name) for x, name in ((F.col("other"), "other"), (before, "before"))]
    hits = each.groupBy("ph", "pc").agg(F.min("first").alias("first"), F.max("k").alias("k"), *found)
    before = F.when(F.size("before") > 0, bit_map("before"))
    return out.union(hits.select("ph", "pc", "first", bit_map("other"), before, F.when(F.col("k") > 1, F.lit(b""))))


def ranges(one: DataFrame, wide: int) -> DataFrame:
    """PARTS of the contexts (h, c, k, first, ctx): the stretch of the windows whose anchors stand at places
    ``wide`` * j to ``wide`` * (j + 1) - 1 of them, for each j.  h: hash of the bytes that all such windows
    share, so that equal windows meet under one; own: ``first`` with the sides of the stretch; ph, pc:
    hashes of the context; at, n: its first window and how many it has."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                rows = batch.slice(lo, 1024)
                data, offsets = utf8_binary(rows.column("ctx"))
                loc = np.array([x["loc"] for x in rows.column("first").to_pylist()], np.int64)
                back, ahead = loc >> 8 & 255, loc & 255
                count = back // wide - ahead // wide + 1
                row = np.repeat(np.arange(len(loc)), count)
                j = (ahead // wide)[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                top, end = np.minimum(back[row], (j + 1) * wide - 1), np.maximum(ahead[row], j * wide)
                at, place = back[row] - top, offsets[row] + back[row]
                roll = Rolling(data, 31)
                h = mix(roll.spans(place - j * wide, place - (j + 1) * wide + 1 + WIDTH) + mix(j.astype(U) + U(1)))
                c = mix(Rolling(data, 37).spans(place - top, place - end + WIDTH) + mix((top << 8 | end).astype(U) + U(1)))
                ctx = [data[a:b].tobytes() for a, b in zip((place - top).tolist(), (place - end + WIDTH).tolist(), strict=True)]
                taken = rows.take(pa.array(row))
                first = taken.column("first")
                own = pa.StructArray.from_arrays([*(first.field(x) for x in ("u", "doc_id", "t")), pa.array(loc[row] >> 16 << 16 | top << 8 | end)], names=["u", "doc_id", "t", "loc"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), own, pa.array(ctx, pa.binary()), taken.column("h"), taken.column("c"), first, taken.column("k"), pa.array(at.astype(np.int32)), pa.array((top - end + 1).astype(np.int32))],
                    names=["h", "c", "own", "ctx", "ph", "pc", "first", "k", "at", "n"],
                )

    return one.select("h", "c", "k", "first", "ctx").mapInArrow(cut, PARTS)


@F.arrow_udf(BinaryType())
def bit_map(parts: pa.Array) -> pa.Array:
    out = []
    for own in parts.to_pylist():
        bits = np.zeros(2 * WIDTH, bool)
        for x in own:
            held = x["bits"]
            bits[x["at"] : x["at"] + x["n"]] = np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little")[: x["n"]] if held else True
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return pa.array(out, pa.binary())


def repeats(docs: DataFrame, keep: str = "none", group: int = GROUP) -> DataFrame:
    """(doc_id, t, spans): for each text with repeated windows their contexts' (loc, bits),
    with no bits where every window of the context repeats."""
    if keep not in ("none", "first"):
        raise ValueError(keep)
    own = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    buckets = 1 << min(16, max(6, (2 * own.rdd.getNumPartitions() - 1).bit_length()))
    found = durable(occurrences(own, buckets))
    # a frequent context is a row for each batch that has it; neither side of the join is grouped by its
    # key, so that a hot one can be split
    rows = found.select("h", "c", "occ").join(marks(found, group), ["h", "c"]).withColumn("o", F.explode("occ"))
    if keep == "none":
        bits = F.col("other")
    else:
        at = F.struct(F.col("o.doc_id").isNull().alias("u"), F.col("o.doc_id").alias("doc_id"), F.col("o.t").alias("t"), F.col("o.loc").alias("loc"))
        bits = F.when(at.eqNullSafe(F.col("first")), F.col("before")).otherwise(F.col("later"))
    out = rows.select("o.doc_id", "o.t", "o.loc", bits.alias("bits")).where("bits is not null")
    return out.groupBy("doc_id", "t").agg(F.collect_list(F.struct("loc", "bits")).alias("spans"))


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of a text's n bytes the marked windows cover."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        loc = s["loc"]
        place, first, last = loc >> 16, loc >> 8 & 255, loc & 255
        if s["bits"]:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(s["bits"], np.uint8), bitorder="little")[: first - last + 1]) + (place - first)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WIDTH, -1)
        else:
            edge[place - first] += 1
            edge[place - last + WIDTH] -= 1
    return np.cumsum(edge[:-1]) > 0


@F.arrow_udf(BinaryType())
def squeezed(text: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=1)
    return pa.array([pack.compress((x or "").encode()) for x in text.to_pylist()], pa.binary())


TAKEN = ["n_bytes", "n_removed", "n_spans", "kept"]


def cut_repeats(docs: DataFrame, keep: str = "none", group: int = GROUP, text: bool = False) -> DataFrame:
    """All columns of ``docs`` but text, with n_bytes, n_removed, n_spans and the kept bytes, or with
    ``text`` the kept bytes as a string, without those of characters that a cut left incomplete.

    A null text counts as empty; texts below WIDTH bytes stay whole; a text of over SEGMENT bytes is
    read in pieces that overlap.  Of rows that repeat with one doc_id and text, ``keep="first"``
    clears all but one; rows of one doc_id and unlike texts are in order of their texts' hashes.
    An empty table gives no rows.  Kept bytes may be cut inside a character.  A column of docs
    that has the name of one of the result is an error.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    taken = [c for c in rest if c in TAKEN]
    if taken:
        raise ValueError(f"docs has columns of the result: {taken}")
    spans = repeats(docs, keep, group)
    # texts travel compressed: this shuffle is the largest
    own = docs.select(F.struct(*rest).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), squeezed("text").alias("z"))
    if keep == "first":
        own = numbered(own)
    else:
        own = own.withColumn("nth", F.lit(1))
    both = own.join(spans.toDF("sid", "st", "spans"), F.col("id").eqNullSafe(F.col("sid")) & (F.col("t") == F.col("st")), "left").select("row", "z", "nth", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unkept()
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for z, nth, spans in zip(batch.column("z"), batch.column("nth"), batch.column("spans"), strict=True):
                data = np.frombuffer(unpack.decompress(z.as_py()), np.uint8)
                gone = np.ones(len(data), bool) if nth.as_py() > 1 and len(data) >= WIDTH else covered(len(data), spans.as_py())
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                left = data[~gone].tobytes()
                out.append((len(data), int(gone.sum()), runs, left.decode(errors="ignore") if text else left))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string() if text else pa.binary()), strict=True))], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = "string" if text else "binary"
    out = both.mapInArrow(cut, f"row {both.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept {kind}")
    return out.select(*(F.col("row").getField(c).alias(c) for c in rest), *TAKEN)


def numbered(own: DataFrame) -> DataFrame:
    """``own(id, t, ..)`` with nth, 1 but for the rows that repeat an id and a text hash; those are
    told apart by their places among the rows, of which the least is 1 and the others 2."""
    ids = own.select("id", "t")
    again = durable(ids.groupBy("id", "t").count().where("count > 1").select(F.col("id").alias("rid"), F.col("t").alias("rt")))
    if again.isEmpty():
        return own.withColumn("nth", F.lit(1))
    own = durable(own.withColumn("row_no", F.monotonically_increasing_id()))
    least = own.join(again, F.col("id").eqNullSafe(F.col("rid")) & (F.col("t") == F.col("rt")), "left_semi").groupBy("id", "t").agg(F.min("row_no").alias("least"))
    least = durable(least.toDF("rid", "rt", "least"))
    both = own.join(least, F.col("id").eqNullSafe(F.col("rid")) & (F.col("t") == F.col("rt")), "left")
    return both.select("row", "id", "t", "z", F.when(F.col("row_no") > F.col("least"), F.lit(2)).otherwise(F.lit(1)).alias("nth"))


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
