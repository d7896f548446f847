import math

import numpy as np
import pytest
from lodegraph.llm import negatives, queries


def plain(rows, anchors, positives=5, k=5, low=80, high=100):
    """The definition, over all pairs of rows (vec_id, embedding, label)."""

    def whole(table):
        for i, x, label in table:
            if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
                yield i, label, [math.floor(256 * float(np.float32(c))) for c in x]

    out, own = [], list(whole(rows))
    for i, label, q in whole(anchors):
        scored = [(sum(a * b for a, b in zip(q, v, strict=True)), j, m) for j, m, v in own if j != i and len(v) == len(q)]
        scored.sort(key=lambda r: (-r[0], r[1]))
        for p, positive, _ in [r for r in scored if r[2] == label][:positives]:
            fitting = [r for r in scored if r[2] != label and low * p <= 100 * r[0] <= high * p][:k]
            out += [(i, positive, rank, j, p, s) for rank, (s, j, _) in enumerate(fitting, 1)]
    return sorted(out)


def table(seed=3, n=400, dims=6, groups=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dims))
    own = middle[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, dims))
    return [(int(i), [float(x) for x in v], int(rng.integers(0, 4))) for i, v in enumerate(own)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("clusters", "block", "held", "most"), [(1, 50, 1 << 20, 1 << 20), (8, 16, 600, 1 << 20), (40, 2048, 1 << 20, 500)])
def test_equals_all_pairs(spark, clusters, block, held, most):
    rows = table() + [(1000 + i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], i % 3) for i in range(90)]  # a large group of copies
    rows += [(2000, None, 1), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2002, [math.nan] * 6, 1), (2003, [math.inf] * 6, 2), (2004, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(2005, [], 1), (2006, [], 2), (2007, [0.0] * 6, 0), (2008, [1.0, 2.0], 1), (2009, [1.0, 2.0], 1), (2010, [1.0, 1.9], 2), (7, rows[9][1], 3)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA + ", rank string, dims int").repartition(7)
    asked = [r for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] >= 2000)] + [rows[20]]
    anchors = spark.createDataFrame(asked, SCHEMA)
    got = negatives.mined(docs, anchors, clusters=clusters, sample=200, block=block, held=held, most=most)
    assert sorted(map(tuple, got.collect())) == plain(rows, asked)


@pytest.mark.parametrize(("low", "high", "positives", "k"), [(100, 100, 3, 2), (0, 200, 1, 7), (-50, 90, 2, 1)])
def test_other_windows(spark, low, high, positives, k):
    rows = table(4, 200)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = negatives.mined(docs, docs.where("vec_id % 9 = 0"), positives, k, low, high, clusters=12)
    assert sorted(map(tuple, got.collect())) == plain(rows, [r for r in rows if r[0] % 9 == 0], positives, k, low, high)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(table(n=20), SCHEMA)
    assert negatives.mined(none, some).collect() == [] and negatives.mined(some, none).collect() == []
    assert negatives.mined(some, some.limit(1)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_bounds_spare_lists():
    """Most lists of well parted groups are never visited."""
    rng = np.random.default_rng(1)
    middle = 100 * np.eye(32)
    blocks, centers = [], middle.copy()
    for c in range(32):
        v = np.rint(middle[c] + rng.normal(size=(50, 32))).astype(np.int64)
        radius = float(np.sqrt(((v - centers[c]) ** 2).sum(1)).max())
        blocks.append(negatives.Block(32, c, 0, radius, np.arange(50) + 50 * c, np.sort(rng.integers(0, 3, 50)), v))
    anchors = negatives.Block(32, 0, 0, 0.0, np.array([10_000]), np.array([1]), middle[:1].astype(np.int64))
    visit = negatives.Visit(anchors, blocks, {32: centers})
    ids, scores = negatives.search_same(visit, 0, 5, negatives.NONE, None, False)
    assert visit.visited == 1 and (ids < 50).all() and (np.diff(scores) <= 0).all()
    visit.visited = 0
    best = negatives.search_other(visit, 0, 5, [(0, 3000)], [negatives.NONE])  # the near list scores too high: outside the window
    assert len(best[0][0]) == 5 and (best[0][0] >= 50).all()
    assert visit.visited < 32


def test_registered_query(spark, tmp_path):
    rows = [(10 * i, v, label) for i, v, label in table(8, 300)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op13_hard_negatives"](spark, str(tmp_path))
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert sorted(map(tuple, got.collect())) == plain(moved, [r for r in moved if r[0] % 100 == 0])
