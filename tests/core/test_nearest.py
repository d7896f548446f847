import math
import random

from lodegraph.operators import search
from lodegraph.plans import catalog


def cosine(a, b):
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0


def brute(rows, queries, k):
    out = set()
    for q, x in queries:
        best = sorted((-round(cosine(x, v), 6), i) for i, v in rows if len(v) == len(x))[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


def test_every_query_has_its_nearest_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(1, 500)]
    rows += [(i, [0.5] * 8) for i in range(600, 660)] + [(700, [0.0] * 8), (800, [1.0, 2.0]), (801, [2.0, 1.0])]
    odd = [(0, None), (900, [1.0] * 7 + [float("nan")]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    queries = [r for r in rows if r[0] % 100 == 0]
    got = search.nearest(df, df.where("vec_id % 100 = 0"), "vec_id", "embedding", 5, block=64, query_block=3, at_once=2).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.similarity) for r in got} == brute(rows, queries, 5) and len(got) == 5 * (len(queries) - 1) + 2
    assert search.nearest(df, df.where("false"), "vec_id", "embedding").count() == 0

    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    each = catalog.QUERIES["nearest_vectors_each"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in each} == {x[:3] for x in brute(rows, queries, 5)}
    # the row of the least id has no vector: the search is for the next one
    one = catalog.QUERIES["nearest_vectors"](spark, str(tmp_path)).collect()
    assert {r.vec_id for r in one} == {x[2] for x in brute(rows, rows[:1], 5)}
