"""Best-fit packing of tokenised documents by length patterns.

Documents become pieces of at most ``LIMIT`` tokens; what the driver sees is only the
histogram of their lengths.  Patterns of two to four documents that fill a sequence exactly
are enumerated, non-negative least squares fits their repeat counts to the histogram, the
counts are rounded, and what remains is packed by best fit decreasing on the histogram.
A piece finds its place from its rank among the pieces of its length, so the plan is
applied by one join-free pass; ranks are counted within salted parts of a length.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .blocks import LOWER, durable, kept, small_batches, text_blocks

LIMIT = 4096
PATTERNS = 8192
END_ID = 1
CACHE = 400_000
RANKED = 200_000
_LOWER = LOWER.tobytes()
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Small letters that no normal form changes, and signs that end words.
LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", ".,;:!?"
WORD = re.compile(f"([{LETTERS}]+)([{SIGNS}]*)").fullmatch
PIECES = ArrayType(StructType([StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]))
PLACE = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])


# -- tokens -----------------------------------------------------------------------------


class WordIds:
    """Ids of texts, tokenised once per distinct stretch between blanks.  The tokenizer drops
    white space and no token of it crosses white space, so stretches are independent."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {"": b""}, {}
        self.model, self.letters = self.tokenizer.model, self._letters()

    def _letters(self) -> dict[int, str] | None:
        """What the model reads for each of LETTERS, if it reads a run of them as one word and cuts it
        from SIGNS behind it."""
        split = lambda x: [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(x))]
        if not self.tokenizer.normalizer or not self.tokenizer.pre_tokenizer:
            return None
        own = {ord(c): "".join(split(c)) for c in LETTERS}
        whole = LETTERS.translate(own)
        plain = split(LETTERS) == [whole] and all(split(LETTERS + x) == [whole, *split(x)] for x in SIGNS)
        return own if plain else None

    def word(self, letters: str) -> bytes:
        """Ids of a run of LETTERS, of which the model itself tells the tokens: what comes before it,
        for texts of any kind, takes longer than the model."""
        ids = [t.id for t in self.model.tokenize(letters.translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: set[str]) -> None:
        """Encode the words not known yet, those of letters and signs behind them by the model, the others
        as one sequence of separate words.  When ``CACHE`` words
        are held they become the older ones, of which those that recur are taken over."""
        fresh = words - self.known.keys()
        if len(self.known) + len(fresh) > CACHE:
            self.older, self.known, fresh = self.known, {"": b""}, words
        new = []
        for w in fresh:  # in any order: words are encoded apart
            ids = self.older.get(w)
            if ids is None:
                new.append(w)
            else:
                self.known[w] = ids
        if self.letters:
            new = self._plain(new)
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(e.ids, "<u4").tobytes()
            edges = (4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            self.known.update((w, raw[a:b]) for w, a, b in zip(part, edges[:-1], edges[1:], strict=True))

    def _plain(self, new: list[str]) -> list[str]:
        """Learn the words of letters, or of letters and signs; the others are left."""
        rest, ended = [], []
        for w in new:
            own = WORD(w)
            if own is None:
                rest.append(w)
            elif own[2]:
                ended.append((w, own[1], own[2]))
            else:
                self.known[w] = self.word(w)
        tails = {}
        for w, letters, signs in ended:
            if signs not in tails:
                tails[signs] = np.array(self.tokenizer.encode(signs, add_special_tokens=False).ids, "<u4").tobytes()
            ids = self.known.get(letters)
            self.known[w] = (self.word(letters) if ids is None else ids) + tails[signs]
        return rest

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.  The tokenizer lower-cases: A-Z may go
        before it, unless that would make a special string."""
        cut = [(x if "<|" in x else x.encode().translate(_LOWER).decode()).replace("\n", " ").split(" ") for x in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]


def word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept("word ids", path, WordIds)


def pieces_of(ids: bytes, limit: int = LIMIT) -> list[dict[str, int]]:
    ids += np.array([END_ID], "<u4").tobytes()
    out = []
    for k, at in enumerate(range(0, len(ids), 4 * limit)):
        part = ids[at : at + 4 * limit]
        out.append({"piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)})
    return out


def pieces(docs: DataFrame, path: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row; a null text is the empty one."""

    def split(text: pa.Array) -> pa.Array:
        words, out = word_ids(path), []
        for lo, hi, _, _ in text_blocks(text):
            out += [pieces_of(ids, limit) for ids in words.ids(text[lo:hi].fill_null("").to_pylist())]
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        return pa.array(out, kind)

    return docs.select("doc_id", F.inline(F.arrow_udf(split, PIECES)(F.col("text"))))


# -- the plan ----------------------------------------------------------------------------


def enumerate_patterns(count: np.ndarray, limit: int, most: int = PATTERNS, seed: int = 0) -> np.ndarray:
    """Rows of up to four lengths (0: none) that sum to the limit: every pair, and triples and
    quadruples whose free lengths are drawn in proportion to the histogram."""
    rng = np.random.default_rng(seed)
    a = np.arange(1, limit // 2 + 1)
    found = [np.stack([a, limit - a, 0 * a, 0 * a], 1)]
    total = count[1:limit].sum()
    if total:
        p = count[1:limit] / total
        for parts in (3, 4):
            free = rng.choice(np.arange(1, limit), (4 * most, parts - 1), p=p)
            last = limit - free.sum(1)
            rows = np.zeros((4 * most, 4), np.int64)
            rows[:, : parts - 1], rows[:, parts - 1] = free, last
            found.append(np.sort(rows[last > 0], 1)[:, ::-1][: most // 2])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[(count[rows] * (rows > 0) > 0).sum(1) == (rows > 0).sum(1)]


def fit(rows: np.ndarray, count: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares of the pattern counts by accelerated projected gradients."""
    if len(rows) == 0:
        return np.zeros(0)
    held = rows > 0

    def spread(x: np.ndarray) -> np.ndarray:
        out = np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), len(count))
        out[0] = 0
        return out

    probe = np.ones(len(rows))
    for _ in range(20):  # largest eigenvalue
        probe = (spread(probe)[rows] * held).sum(1)
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    target = count.astype(float)
    target[0] = 0
    for _ in range(steps):
        gradient = ((spread(y) - target)[rows] * held).sum(1)
        new = np.maximum(y - gradient / norm, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def best_fit(count: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: the longest length starts a sequence, an exact fill
    by one or two more is preferred to the longest that fits, and the pattern repeats
    until one of its lengths runs out, so there are about as many steps as lengths."""
    count, plan = count.copy(), []
    count[0] = 0
    for top in range(limit, 0, -1):
        while count[top] > 0:
            own = [top]
            count[top] -= 1
            left = limit - top
            while left > 0:
                there = count[: left + 1] > 0
                if there[left]:
                    pick = [left]
                else:
                    two = np.flatnonzero(there & there[::-1])
                    two = two[(two < left) & ((2 * two != left) | (count[two] > 1))]
                    fits = np.flatnonzero(there)
                    if len(two):
                        pick = [int(two[-1]), left - int(two[-1])]
                    elif len(fits):
                        pick = [int(fits[-1])]
                    else:
                        break
                for k in pick:
                    count[k] -= 1
                    own.append(k)
                    left -= k
            lengths, times = np.unique(own, return_counts=True)
            more = int((count[lengths] // times).min())
            count[lengths] -= more * times
            plan.append((tuple(own), 1 + more))
    return plan


def make_plan(count: np.ndarray, limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of the patterns that hold each piece of the histogram once.  The fit
    is rounded to the nearest whole and down; the plan with fewer sequences stays.  Best fit
    packs what the rounded patterns leave."""
    count = count.astype(np.int64)
    full = [((limit,), int(count[limit]))] if count[limit] else []
    rest = count.copy()
    rest[limit] = 0
    rows = enumerate_patterns(rest, limit)
    x = fit(rows, rest)
    plans = []
    for shift in (0.5, 0):
        left, plan = rest.copy(), []
        repeats = np.floor(x + shift).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] == 0:
                break
            own = rows[i][rows[i] > 0]
            lengths, times = np.unique(own, return_counts=True)
            n = int(min(repeats[i], (left[lengths] // times).min()))
            if n > 0:
                left[lengths] -= n * times
                plan.append((tuple(int(k) for k in own), n))
        plans.append(plan + best_fit(left, limit))
    return full + min(plans, key=lambda plan: sum(n for _, n in plan))


def slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys length << 40 | first rank, with the first sequence and the offset there."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for own, n in plan:
        offset = 0
        for k in own:
            at = rank.get(k, 0)
            rows.append((k << 40 | at, base, offset))
            rank[k] = at + n
            offset += k
        base += n
    out = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """Add rank, the place of a row among those of its length, from 0."""
    parts = max(1, -(-total // RANKED))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    before = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    return rows.withColumn("own", own).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own")).drop("part", "own", "before")


def pack(docs: DataFrame, path: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of
    ``docs(doc_id, text)``.

    Null and empty texts are pieces of the end id alone.  Rows that repeat, or whose doc_id is
    null, are packed one by one; an empty table gives no rows; a text of any length is tokenised
    whole and cut into pieces; pieces of one length are ordered by doc_id, piece and ids; other
    columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    rows = durable(pieces(docs, path, limit))
    count = np.zeros(limit + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most ``limit`` rows
        count[r["length"]] = r["count"]
    keys, base, offset = slots(make_plan(count, limit))

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        own = length.to_numpy(zero_copy_only=False) << 40
        rank = rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, own | rank, "right") - 1
        return pa.StructArray.from_arrays([pa.array(base[at] + (own | rank) - keys[at]), pa.array(offset[at])], names=["sequence_id", "offset"])

    out = ranked(rows, int(count.sum())).withColumn("at", F.arrow_udf(place, PLACE)("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
