"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list.  Every merge rank has a bucket of list positions
whose pair merges to that rank, and a bitmap of three levels says which buckets hold
something: find-first-set on each level gives the least rank.  An entry whose pair has
changed since is stale and skipped.  A merge costs a few word operations, so a pre-token of
n bytes costs about n of them, however long it is; a bucket is sorted once, when it is taken.  Pre-tokens of a block share the queue, so
that a bucket serves all of them at once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from itertools import accumulate, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .blocks import kept, small_batches, text_blocks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CACHE = 500_000
#: Characters of pre-tokens that share a queue; a longer pre-token has it alone.
LOT = 1 << 18
RESULT = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
#: Blanks and line feeds, then anything else: no pre-token crosses the start of such a stretch.
STRETCH = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Other white space, at which stretches could cut a pre-token.
OTHER_SPACE = re.compile(r"[^\S \n]")


class RankQueue:
    """Buckets of positions by rank under a three-level bitmap of 64-bit words."""

    def __init__(self, ranks: int):
        self.words = [[0] * (-(-ranks // 64**k)) for k in (1, 2, 3)]
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, places: list[int]) -> None:
        """Places for a rank, in any order."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += places
            return
        self.buckets[rank] = places
        for level in self.words:
            word, bit = rank >> 6, 1 << (rank & 63)
            if level[word] & bit:
                break
            level[word] |= bit
            rank = word

    def load(self, want: np.ndarray) -> None:
        """A bucket for every rank in ``want``, -1 for none, with its places in order."""
        order = np.argsort(want, kind="stable")
        ranks = want[order]
        first = int(np.searchsorted(ranks, 0))
        cuts = np.flatnonzero(np.diff(ranks[first:], prepend=-1)) + first
        places, stops = order.tolist(), [*cuts[1:].tolist(), len(want)][: len(cuts)]
        for rank, lo, hi in zip(ranks[cuts].tolist(), cuts.tolist(), stops, strict=True):
            self.push(rank, places[lo:hi])

    def least(self) -> int:
        """The least rank that has a bucket, or -1."""
        low, mid, high = self.words
        for k, word in enumerate(high):
            if word:
                break
        else:
            return -1
        k = k << 6 | (word & -word).bit_length() - 1
        word = mid[k]
        k = k << 6 | (word & -word).bit_length() - 1
        word = low[k]
        return k << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """The places of a rank from left to right; its bucket is gone."""
        bucket = self.buckets.pop(rank)
        for level in self.words:
            level[rank >> 6] &= ~(1 << (rank & 63))
            if level[rank >> 6]:
                break
            rank >>= 6
        bucket.sort()
        return bucket


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.queue = RankQueue(len(self.token))
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        self.double = np.full(1 << 16, -1)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.double[token[0] << 8 | token[1]] = rank
        self.known: dict[str, bytes] = {}
        self.past: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens, none of them empty.  They share one queue: a bucket holds places of
        all of them, and a find-first-set serves every merge of its rank."""
        data, starts = b"".join(pieces), [0, *accumulate(map(len, pieces))]
        codes, n = np.frombuffer(data, np.uint8).astype(np.int64), len(data)
        ids, pairs = self.single[codes].tolist(), np.full(n, -1)
        if n:
            pairs[:-1] = self.double[codes[:-1] << 8 | codes[1:]]
            pairs[np.array(starts[1:]) - 1] = -1
        # a part starts at i and ends at end[i], where the next one starts unless a pre-token does
        end, before, edge = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n + 1)
        for s in starts:
            edge[s] = 1
        for s in starts[:-1]:
            before[s] = -1
        want, get, queue = pairs.tolist(), self.ranks.get, self.queue
        held = queue.buckets
        queue.load(pairs)
        while (rank := queue.least()) >= 0:
            bucket = queue.take(rank)
            for k, i in enumerate(bucket):
                if want[i] != rank:
                    continue  # stale
                least = rank + 1
                j = end[i]
                e = end[i] = end[j]
                want[j], ids[i] = -1, rank
                if edge[e]:
                    want[i] = -1
                else:
                    before[e] = i
                    r = want[i] = get(data[i : end[e]], -1)
                    if r >= 0:
                        least = r
                        if r in held:
                            held[r].append(i)
                        else:
                            queue.push(r, [i])
                b = before[i]
                if b >= 0:
                    r = get(data[b:e], -1)
                    if r != want[b]:
                        want[b] = r
                        if r >= 0:
                            if r < least:
                                least = r
                            if r in held:
                                held[r].append(b)
                            else:
                                queue.push(r, [b])
                if least <= rank:  # the rest of the bucket has to wait
                    if k + 1 < len(bucket):
                        queue.push(rank, bucket[k + 1 :])
                    break
        out = []
        for i, stop in pairwise(starts):
            own = []
            while i < stop:
                own.append(ids[i])
                i = end[i]
            out.append(own)
        return out

    def ids_of(self, pieces: set[str]) -> dict[str, list[int]]:
        """Ids of each distinct pre-token; those that are no token and not known yet are merged
        together, in lots of a bounded number of bytes."""
        out, lot, size = {}, [], 0

        def flush() -> None:
            nonlocal lot, size
            out.update(zip(lot, self.merge([x.encode() for x in lot]), strict=True))
            lot, size = [], 0

        for piece in pieces:
            own = self.pieces.get(piece) or self.older.get(piece)
            if own is None:
                whole = self.ranks.get(piece.encode())
                own = None if whole is None else [whole]
            if own is not None:
                out[piece] = own
            else:
                if lot and size + len(piece) > LOT:
                    flush()
                lot.append(piece)
                size += len(piece)
        flush()
        for piece, own in out.items():
            if len(piece) <= 64:
                if len(self.pieces) >= CACHE:  # those that recur are taken over
                    self.older, self.pieces = self.pieces, {}
                self.pieces[piece] = own
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.  Stretches between blanks are encoded once
        and kept, if short; other white space than blanks and line feeds goes through the pattern
        whole."""
        split = [[x] if OTHER_SPACE.search(x) else STRETCH.findall(x) for x in texts]
        known, past = self.known, self.past
        lacking = set().union(*split).difference(known)
        fresh = {}
        for part in lacking:
            own = past.get(part)
            if own is None:
                fresh[part] = self.pattern.findall(part)
            else:
                known[part] = own  # those that recur are taken over
        ids = self.ids_of(set().union(*fresh.values()))
        for part, pieces in fresh.items():
            own = ids[pieces[0]] if len(pieces) == 1 else [i for piece in pieces for i in ids[piece]]
            known[part] = struct.pack(f"<{len(own)}I", *own)
        out = [b"".join(map(known.__getitem__, parts)) for parts in split]
        for part in fresh:
            if len(part) > 64:
                del known[part]
        if len(known) > CACHE:
            self.past, self.known = known, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def codec(path: str) -> Codec:
    return kept("codec", path, lambda path: Codec(load(path)))


def round_trip(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded bytes of every row of
    ``docs(doc_id, text)``.

    Null is the empty text, without ids.  Rows are taken as they come, repeated or without a
    doc_id; an empty table gives no rows; a text is encoded whole, however long; other columns,
    whatever their names, are not read.
    """
    small_batches(docs.sparkSession)

    def digests(text: pa.Array) -> pa.Array:
        own, out = codec(path), []
        for lo, hi, _, _ in text_blocks(text):
            for ids in own.encode_all(text[lo:hi].fill_null("").to_pylist()):
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
        n, a, b = zip(*out, strict=True) if out else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.arrow_udf(digests, RESULT)(F.col("text")).alias("r")).select("doc_id", "r.*")


def encoded(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id and the ids of every row, as an array."""
    from pyspark.sql.types import ArrayType

    def ids(text: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in own.encode_all(text.fill_null("").to_pylist())], pa.list_(pa.int64()))

    return docs.select("doc_id", F.arrow_udf(ids, ArrayType(LongType()))(F.col("text")).alias("ids"))
