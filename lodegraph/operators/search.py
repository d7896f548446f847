"""Ranked retrieval over token sets: document frequencies, scores, vector top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from .lineage import settle


def query_terms(text: str) -> list[str]:
    """The distinct terms of a question, without stop words unless nothing else is left."""
    import re

    raw = [t for t in re.split(r"[^a-z0-9]+", text.lower()) if len(t) > 1]
    terms = list(dict.fromkeys(t for t in raw if t not in STOP_WORDS)) or list(dict.fromkeys(raw))
    return terms


def matches(docs: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """(key, term): the terms that a document has, as a token or, from three letters on, as the start
    of one.  The terms are few: they stand in the plan, and documents are read once."""
    own = docs.select(key, tokens(F.col(text)).alias("_tokens"))

    def has(term: str) -> Column:
        return F.exists("_tokens", lambda t: t.startswith(term) if len(term) >= 3 else t == term)

    hit = [F.when(has(w), F.lit(w)) for w in terms]
    return own.select(key, F.explode(F.array_compact(F.array(*hit))).alias("term"))


def frequencies(docs: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """(term, df, idf), idf = ln((N + 1) / (df + 1)) + 1, of every term."""
    n = docs.agg(F.count("*").alias("n"))
    found = matches(docs, terms, key, text).groupBy("term").agg(F.count("*").alias("df"))
    every = docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    own = every.join(found, "term", "left").na.fill(0, ["df"]).join(F.broadcast(n))
    return own.select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def search(docs: DataFrame, question: str, key: str, text: str, limit: int = 12) -> DataFrame:
    """(key, score, matched): 10 for each matched term's idf and 120 for all terms, of documents with
    enough of them, best first."""
    terms = query_terms(question)
    least = len(terms) if len(terms) <= 1 else min(3, -(-len(terms) // 3))
    weights = F.broadcast(frequencies(docs, terms, key, text).select("term", "idf"))  # a row for each term
    own = matches(docs, terms, key, text).join(weights, "term").groupBy(key).agg(F.sum(10 * F.col("idf")).alias("s"), F.count("*").alias("matched"))
    score = F.round(F.col("s") + F.col("matched") / len(terms) * 120, 6)
    return own.where(F.col("matched") >= least).select(key, score.alias("score"), "matched").orderBy(F.desc("score"), key).limit(max(1, min(100, limit)))


def per_owner(rows: DataFrame, owner: str, order: list, k: int) -> DataFrame:
    """The first k rows of each owner; Spark cuts each partition to k before the exchange."""
    nth = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= k)


def _packs(rows: DataFrame, size: int) -> DataFrame:
    """(dims, ids, vectors): blocks of at most ``size`` rows(id, v) of one length, as they are read."""

    def out(d: int, ids: list[int], vectors: list[list[float]]) -> pa.RecordBatch:
        cells = [[d], [np.array(ids, "<i8").tobytes()], [np.array(vectors, "<f8").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["dims", "ids", "vectors"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                own = held.setdefault(len(v), ([], []))
                own[0].append(i)
                own[1].append(v)
                if len(own[0]) == size:
                    yield out(len(v), *held.pop(len(v)))
        for d, own in held.items():
            yield out(d, *own)

    return rows.mapInArrow(pack, "dims int, ids binary, vectors binary")


def _unpacked(ids: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and norms."""
    i = np.frombuffer(ids, "<i8")
    v = np.frombuffer(vectors, "<f8").reshape(len(i), dims)
    return i, v, np.sqrt(_products(v, v))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first component on, so that they do not depend on blocks."""
    s = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for d in range(a.shape[-1]):
        s += a[..., d] * b[..., d]
    return s


def _best(q: tuple, rows: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, similarity in millionths) of the k best rows of a block for each query."""
    (_, x, x_norm), (ids, v, v_norm) = q, rows
    norm = x_norm[:, None] * v_norm[None]
    cos = np.divide(_products(x[:, None], v[None]), norm, out=np.zeros_like(norm), where=norm != 0)
    near = (np.sign(cos) * np.floor(np.abs(cos) * 1e6 + 0.5)).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    mixed = (-near[:, order] << 20) + np.arange(len(ids))  # ties to the smaller id
    k = min(k, len(ids))
    top = np.partition(mixed, k - 1, axis=1)[:, :k].ravel()
    return np.repeat(np.arange(len(x)), k), ids[order[top & (1 << 20) - 1]], -(top >> 20)


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = 2048, query_block: int = 256, at_once: int = 256) -> DataFrame:
    """(query_id, rank, key, similarity): the k rows most alike by cosine to each row of ``queries``,
    the query's own among them; cosines to six digits, ties to the smaller key.

    Keys are whole numbers.  Vectors meet those of their own length; vectors with a null or
    non-finite component have no cosine, and rows without a key no name: they take no part.
    ``at_once`` blocks of queries are broadcast to one pass over the rows.
    """

    def fine(df: DataFrame) -> DataFrame:
        x = F.col(vector)
        ok = F.col(key).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return df.where(ok).select(F.col(key).cast("long").alias("id"), x.cast("array<double>").alias("v"))

    asked = fine(queries)
    asked = asked.repartition(max(1, -(-asked.count() // query_block)))
    asked = settle(_packs(asked, query_block).select(F.monotonically_increasing_id().alias("b"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    names = [r["b"] for r in asked.select("b").collect()]  # one a block
    stored = _packs(fine(rows), block)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                q = _unpacked(r["q_ids"], r["q_vectors"], r["dims"])
                own = _unpacked(r["ids"], r["vectors"], r["dims"])
                for lo in range(0, len(q[0]), 64):  # the products of 64 queries and a block at a time
                    part = tuple(x[lo : lo + 64] for x in q)
                    at, ids, near = _best(part, own, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["b"])), pa.array(at + lo), pa.array(part[0][at]), pa.array(ids), pa.array(near)], names=["b", "place", "query_id", "id", "near"])

    found = None
    for lo in range(0, max(1, len(names)), at_once):
        own = stored.join(F.broadcast(asked.where(F.col("b").isin(names[lo : lo + at_once]))), F.col("dims") == F.col("q_dims"))
        own = own.select("dims", "ids", "vectors", "b", "q_ids", "q_vectors").mapInArrow(meet, "b long, place long, query_id long, id long, near long")
        found = own if found is None else found.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("b", "place").orderBy(F.desc("near"), "id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), (F.col("near") / 1e6).alias("similarity"))
