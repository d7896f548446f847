"""Token counts of a byte-fallback piece model without materialising the ids of a text.

No piece of the model has a blank after another character, or a line feed, so no merge
crosses the start of a run of blanks or of a line: a text splits there into pre-tokens whose
counts add up.

1. Blocks of texts become frequencies: a block's distinct pre-tokens, and for each of its
   texts the numbers of those it has and how often.
2. A block's pre-tokens are dealt to buckets by their hashes, a row for each block and bucket, so
   that a frequent pre-token is as many entries as there are blocks, not as there are texts.
   A bucket has all entries of its pre-tokens: the pieces of each are counted once, and the
   counts go back to the blocks.
3. A block's counts are joined to its frequencies and summed over its texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, pairwise
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import durable, kept, release, small_batches, utf8

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096
#: Bytes of text in one block; a longer text is a block of its own.
BLOCK = 32 << 20
#: Texts beyond this many characters are split one pre-token at a time.
LONG = 1 << 20
PRETOKEN = re.compile(r"\n[^ \n]*| +[^ \n]*")
BLANK = "▁"


class PieceCounts:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
            raise ValueError("pieces of this model cross pre-tokens")

    def count(self, pretokens: list[str]) -> list[int]:
        """How many pieces each pre-token has.  The library puts a blank before what it encodes: it
        stands for a pre-token's first blank, or is taken off again.  It has no call that counts
        alone: the pieces of a few thousand pre-tokens are there for a moment."""
        out = []
        for lo in range(0, len(pretokens), 4096):
            part = pretokens[lo : lo + 4096]
            found = self.model.encode([x[1:] if x[0] == " " else x for x in part], num_threads=1)
            out += [1 if x == " " else len(own) - (x[0] == "\n") for x, own in zip(part, found, strict=True)]
        return out


def pretokens(text: str) -> Counter[str]:
    """The pre-tokens of a text and how often it has each; an empty text has none."""
    if not text:
        return Counter()
    text = " " + text.replace(BLANK, " ")
    return Counter(PRETOKEN.findall(text) if len(text) < LONG else (m.group() for m in PRETOKEN.finditer(text)))


def frequencies(docs: DataFrame, buckets: int, block: int = BLOCK) -> DataFrame:
    """(block, doc_ids, n_bytes, edges, at, n, parts): the texts of a block; of each text, between two
    edges, the numbers of its pre-tokens, as differences, and their frequencies; and for each
    bucket the numbers, lengths and characters of the block's pre-tokens."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        held = Block()
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for i, n, text in zip(batch.column("doc_id"), np.diff(offsets).tolist(), batch.column("text"), strict=True):
                held.add(i.as_py(), n, text.as_py() or "")
                if held.size >= block:
                    yield held.row(next(numbers), buckets)
                    held = Block()
        if held.doc_ids:
            yield held.row(next(numbers), buckets)
        release()

    return docs.select("doc_id", "text").mapInArrow(gather, "block long, doc_ids array<long>, n_bytes array<long>, edges binary, at binary, n binary, parts array<struct<bucket:int,places:binary,sizes:binary,words:binary>>")


class Block:
    """Texts as they come: their pre-tokens' numbers, ascending, and frequencies."""

    def __init__(self) -> None:
        self.words: defaultdict[str, int] = defaultdict(count().__next__)
        self.doc_ids: list[int | None] = []
        self.n_bytes: list[int] = []
        self.at: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, n_bytes: int, text: str) -> None:
        own = pretokens(text)
        at = np.fromiter(map(self.words.__getitem__, own), "<i4", len(own))
        order = np.argsort(at)
        self.doc_ids.append(doc_id)
        self.n_bytes.append(n_bytes)
        self.at.append(at[order])
        self.n.append(np.fromiter(own.values(), "<i4", len(own))[order])
        self.size += n_bytes

    def row(self, number: int, buckets: int) -> pa.RecordBatch:
        edges = np.cumsum([0, *map(len, self.at)]).astype("<i8")
        steps = np.diff(np.concatenate(self.at), prepend=np.int32(0))  # small, so that they compress
        words = list(self.words)
        own = np.fromiter((crc32(w.encode()) % buckets for w in words), np.int64, len(words))
        dealt = np.argsort(own, kind="stable")
        parts = []
        for at in np.split(dealt, np.flatnonzero(np.diff(own[dealt])) + 1) if words else []:
            held = [words[i] for i in at.tolist()]
            sizes = np.fromiter(map(len, held), "<i4", len(held))
            parts.append({"bucket": int(own[at[0]]), "places": squeeze(np.diff(at, prepend=0).astype("<i4")), "sizes": squeeze(sizes), "words": ZSTD.compress("".join(held).encode())})
        cols = [pa.array([squeeze(x)], pa.binary()) for x in (edges, steps, np.concatenate(self.n))]
        kind = pa.list_(pa.struct([("bucket", pa.int32()), ("places", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())]))
        return pa.RecordBatch.from_arrays([
            pa.array([number]), pa.array([self.doc_ids], pa.list_(pa.int64())), pa.array([self.n_bytes], pa.list_(pa.int64())), *cols, pa.array([parts], kind),
        ], names=["block", "doc_ids", "n_bytes", "edges", "at", "n", "parts"])


ZSTD = zstandard.ZstdCompressor(level=1)


def squeeze(x: np.ndarray) -> bytes:
    return ZSTD.compress(x.tobytes())


def opened(x: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), kind)


def piece_counts(parts: DataFrame, path: str = MODEL) -> DataFrame:
    """(block, places, pieces) of the rows of ``parts(block, bucket, places, sizes, words)``: within a
    bucket, which has all rows of its pre-tokens, each distinct one is counted once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept("piece counts", path, PieceCounts)
        known: dict[str, int] = {}
        last = -1
        for batch in batches:
            out = []
            for bucket, sizes, words in zip(batch.column("bucket").to_pylist(), batch.column("sizes"), batch.column("words"), strict=True):
                if bucket != last:
                    known, last = {}, bucket
                text, ends = opened(words, np.uint8).tobytes().decode(), np.cumsum(opened(sizes, "<i4")).tolist()
                held = [text[a:b] for a, b in pairwise([0, *ends])]
                fresh = [w for w in held if w not in known]
                known.update(zip(fresh, own.count(fresh), strict=True))
                out.append(squeeze(np.fromiter(map(known.__getitem__, held), "<i4", len(held))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("places"), pa.array(out, pa.binary())], names=["block", "places", "pieces"])

    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(counted, "block long, places binary, pieces binary")


def totals(blocks: DataFrame) -> DataFrame:
    """doc_id, n_bytes and n_tokens from the frequencies of blocks and ``counts``, the places and pieces
    of all of a block's pre-tokens."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                edges, steps, n = (opened(batch.column(c)[r], t) for c, t in (("edges", "<i8"), ("at", "<i4"), ("n", "<i4")))
                at = np.cumsum(steps)
                pieces = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
                for part in batch.column("counts")[r].values or ():
                    pieces[np.cumsum(opened(part["places"], "<i4"))] = opened(part["pieces"], "<i4")
                run = np.concatenate(([0], np.cumsum(pieces[at] * n)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[r].values, batch.column("n_bytes")[r].values, pa.array(run[edges[1:]] - run[edges[:-1]])], names=["doc_id", "n_bytes", "n_tokens"])

    return blocks.mapInArrow(summed, "doc_id long, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, path: str = MODEL, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs(doc_id, text)``.

    Null is the empty text, without tokens.  Rows are taken as they come, repeated or without a
    doc_id; an empty table gives no rows; a text is counted whole, however long; other columns,
    whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    buckets = 1 << min(16, max(6, (2 * docs.rdd.getNumPartitions() - 1).bit_length()))
    blocks = durable(frequencies(docs, buckets, block))
    each = piece_counts(blocks.select("block", F.inline("parts")), path)
    own = each.groupBy("block").agg(F.collect_list(F.struct("places", "pieces")).alias("counts"))
    out = totals(blocks.drop("parts").join(own, "block", "left"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
