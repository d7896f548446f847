import math

import numpy as np
import pytest
from lodegraph.llm import topk


def brute(rows, queries, k):
    fine = [(i, np.array([math.floor(float(x) * 256) for x in v])) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in fine:
        if not queries(qi):
            continue
        found = sorted(((-int(v @ q), i) for i, v in fine if i != qi and len(v) == len(q)))[:k]
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, 6))]) for i in range(400)]
    rows += [(1000 + i, [0.25] * 6) for i in range(40)]  # ties
    rows += [(2000, [0.0] * 6), (2050, [-1.0] * 6), (2100, [3e5] * 6)]  # no list matters; no positive list; large sums
    rows += [(3000, None), (3050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3100, [float("nan")] * 6), (3150, [float("inf")] * 6), (3200, [1.0, 2.0]), (3250, []), (None, [1.0] * 6), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, query_id string").repartition(4)
    got = topk.nearest(docs, docs.where("vec_id % 50 = 0"), 5, block, 3, 1 << 20 if block == 64 else 100)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], lambda i: i % 50 == 0, 5)


def test_early_stop_reads_little():
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, (4000, 8))
    v[17] = v[23] = 50
    own = topk.Lists(np.arange(4000), v)
    ids, _ = own.top(-1, np.ones(8), 2)
    assert ids.tolist() == [17, 23]
    assert own.scored < 200  # of 4,000
    later = topk.Lists(np.arange(4000, 8000), rng.normal(0, 1, (4000, 8)))
    ids, _ = later.top(-1, np.ones(8), 2, (np.array([17, 23]), np.array([400.0, 400.0])))
    assert ids.tolist() == [17, 23] and later.scored < 200  # the bound of earlier blocks stops it


def test_pipeline_query_shape(spark):
    """The registered query gives whole results through the operator."""
    from lodegraph.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute([(i, [np.float32(x) for x in v]) for i, v in rows], lambda i: i % 50 == 0, 5)
    assert sorted(tuple(r) for r in queries.op7_exact_top_k(spark, sf).collect()) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.nearest(none, none).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk.nearest(one, one).count() == 0
