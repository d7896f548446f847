import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from lodegraph.llm import queries, resampling

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, percent=10, most=1, least=20, buckets=10_000, seed=2024):
    """The definition, document by document."""
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    source, aim = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in docs:
        for x in runs(text, most)[1]:
            source[bucket(x)] += 1
    for text in target:
        for x in runs(text, most)[1]:
            aim[bucket(x)] += 1
    s, t = float(source.sum()), float(aim.sum())
    out = []
    for i, text in docs:
        words, own = runs(text, most)
        gain = [math.floor(1000 * math.log((aim[b] + 1.0) * (s + buckets) / ((source[b] + 1.0) * (t + buckets)))) for b in map(bucket, own)]
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    drawn = percent * sum(r[4] for r in out) // 100
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(order, 1):
        r[4] = place if place <= drawn else None
    return sorted((tuple(None if x is False else x for x in r) for r in out), key=str)


def texts(n, seed=5):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta,", "GAMMA", "delta-9", "ñandú", "eta", "tau\x00x", "日本", "x" * 100, "İstanbul"]
    return [" ".join(rng.choice(words, int(rng.integers(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 3])
def test_equals_the_definition(spark, most):
    own = [(int(i) * 7919 % 1009 - 300, t) for i, t in enumerate(texts(200))]
    own += [(5, own[0][1]), (5, own[0][1]), (None, own[1][1]), (None, None), (9001, ""), (9002, None), (2**62, "beta " * 30_000), (-(2**62), "w" * 200_000)]
    target = ["Beta beta tau delta", None, "", "日本 eta"]
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in own], "doc_id long, text string, n_words int, rank string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (0, 10, 100):
        got = resampling.resampled(docs, aim, percent=percent, runs=most, buckets=500)
        assert [c for c, _ in got.dtypes] == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
        assert sorted(map(tuple, got.collect()), key=str) == plain(own, target, percent, most, buckets=500)


def test_one_score_in_many_ranges(spark):
    """Documents of one score, among them many of one id, are numbered without gaps."""
    own = [(i, "a b") for i in range(-700, 700)] + [(3, "a b")] * 300
    docs = spark.createDataFrame(own, "doc_id long, text string")
    got = resampling.resampled(docs, docs, percent=100, least_words=2, buckets=50)
    assert sorted(map(tuple, got.collect()), key=str) == plain(own, [t for _, t in own], 100, least=2, buckets=50)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, len(own) + 1))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert resampling.resampled(none, some).collect() == []
    assert sorted(map(tuple, resampling.resampled(some, none, percent=100).collect())) == plain([(1, "a b c " * 10)], [], 100)


def test_crc_of_spans():
    data = np.frombuffer("ab\x00é".encode() + b"q" * 200, np.uint8)
    start, end = np.array([0, 1, 3, 4, 0]), np.array([2, 1, 5, 204, 204])
    got = resampling.crc32(data, start, end, np.zeros(5, np.uint32))
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


def test_registered_query(spark, tmp_path):
    own = list(enumerate(texts(60)))
    spark.createDataFrame(own, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "eta eta beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.QUERIES["op11_importance_resampling"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == plain(own, ["eta eta beta"])
