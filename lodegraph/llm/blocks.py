"""Helpers shared by the operators: Arrow text blocks, hashing, durable tables.

Texts reach Python as Arrow batches.  ``text_blocks`` cuts each batch into
blocks of a few megabytes (a longer document is a block of its own), so that
numpy temporaries stay bounded whatever the batch size.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch, in place of Spark's default: texts are long, and a task holds several batches.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"
U64 = np.uint64
#: The six ASCII white-space bytes 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where unset, one of our own, but only if driver
    and executors are one process: on a cluster each executor would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` from here on, unless the session has a size of its own."""
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


_KEPT: dict[tuple[str, str], object] = {}


def kept(kind: str, path: str, make: Callable[[str], T]) -> T:
    """``make(path)``, kept by a worker from task to task until it needs something else: a worker
    that serves several operators holds the tables of one."""
    if (kind, path) not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[kind, path] = make(path)
    return _KEPT[kind, path]  # type: ignore[return-value]


def unkept() -> None:
    """Drop what ``kept`` holds: for operators that need no tables of their own."""
    _KEPT.clear()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that a
    lost executor does not undo.  The files go when the application ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lodegraph-{uuid.uuid4().hex}"
    df.write.parquet(at)
    atexit.register(_forget, spark, at)
    return spark.read.schema(df.schema).parquet(at)


def _forget(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has gone: the folder's owner clears it
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    buffers = column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def release() -> None:
    """Give freed memory back to the system, where the C library can: a worker that waits for its
    next task keeps little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive blocks of a column."""
    data, offsets = utf8(column)
    for lo, hi in cut(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
    release()


def texts_of(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


# -- hashing ---------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@lru_cache(8)
def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256).astype(U64) | U64(1)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; a worker keeps those for a block's length only."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        base = (int(np.random.default_rng(12).integers(1, 2**62)) << 3) | 5
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b & (2**64 - 1), U64)
            out[0] = 1
            both.append(np.multiply.accumulate(out, out=out))
        if size > BLOCK_BYTES + 1:
            return both[0], both[1]
        _POWERS[:] = [(both[0], both[1])]
    return _POWERS[0]


class Rolling:
    """Polynomial hashes of any substrings of one block, from prefix sums."""

    def __init__(self, data: np.ndarray, seed: int):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(byte_values(seed)[data] * up[: len(data)], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        """The hash of each substring of ``width`` bytes, unmixed."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U64)
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def words_of(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and the number of words of each text.
    Words are runs of bytes not ``outside``, by default ASCII white space; none crosses two texts."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    solid = ~outside[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    first[inner] = solid[inner]  # a text begins: so may a word
    before = inner[inner > 0] - 1
    last[before] = solid[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return start, end, counts


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts (or sums of weights)."""
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if weights is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(weights, at)


def found(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if len(table) == 0:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def packed(column: pa.Array, dtype: str) -> list[np.ndarray]:
    """Arrays of a binary column."""
    return [np.frombuffer(x.as_buffer(), dtype) if x.is_valid else np.zeros(0, dtype) for x in column]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
