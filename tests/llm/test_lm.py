import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from lodegraph.llm import lm

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    lower = (text or "").encode().translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256)))
    return [*WORD.findall(lower), None]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain(rows):
    train = [tokens(t) for i, t in rows if i is not None and not held_out(i)]
    uni = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["start", *t], t, strict=False))
    total, kinds = sum(uni.values()), len(uni)
    least = lambda c: int(lm.least_of(lm.level_of(np.array([c])))[0])
    most = lambda c: int(lm.most_of(lm.level_of(np.array([c])))[0])
    out = {}
    for i, text in rows:
        own, base, score = tokens(text), 0.0, 0.0
        for v, w in zip(["start", *own], own, strict=False):
            base += math.log10((uni[w] + 1) / (total + kinds + 1))
            p = (least(uni[w]) + 1) / (total + kinds + 1)
            score += math.log10((least(pairs[v, w]) + lm.MU * p) / ((len(train) if v == "start" else most(uni[v])) + lm.MU))
        out[i] = (held_out(i), len(own), sum(uni[w] > 0 for w in own), total, base, score)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    names = ["the", "The", "İx", "é", *(f"w{i}" for i in range(60))]
    made = [(i, " \t\n"[i % 3].join(rng.choice(names, int(rng.integers(0, 80)), p=np.r_[0.3, 0.1, 0.05, 0.05, np.full(60, 0.5 / 60)]))) for i in range(300)]
    return [*made, (1000, None), (1001, ""), (1002, "unseen " * 40), (1003, "the w1 " * 20_000), (1004, "a\x1cb c\x85d"), (None, "the null")]


@pytest.mark.parametrize("bits,words", [(1 << 30, 1 << 23), (40_000, 1 << 23), (1 << 30, 20)])
def test_against_brute_force(spark, monkeypatch, rows, bits, words):
    monkeypatch.setattr(lm, "ITEM_BITS", 64)  # next to no false positives
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    model = lm.fitted(docs, bits, words)
    assert (model.slices > 1) == (bits < 1 << 20 or words < 100)
    want = plain(rows)
    got = lm.scored(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        own = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == own[:4]
        assert r.base_score == pytest.approx(own[4], rel=1e-9) and r.score == pytest.approx(own[5], rel=1e-4)


def test_pairs_help_where_order_repeats(spark):
    rows = [(i, "one two three four five six " * 30) for i in range(40)]
    got = lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.score > r.base_score for r in got)


def test_words_are_not_in_the_filter(spark):
    """Levels of words are those of their exact counts: only pairs take bits and probes."""
    rows = [(i, " ".join(f"v{i * j % 89}" for j in range(200))) for i in range(30)]
    own = [tokens(t) for _, t in rows]
    pairs = Counter(p for t in own for p in zip(["start", *t], t, strict=False))
    model = lm.learn(spark.createDataFrame(rows, "doc_id long, text string").select("text"))
    assert model.table.selectExpr("sum(items)").head()[0] == lm.level_of(np.array(list(pairs.values()))).sum()
    held = model.slice(0)
    assert held.numbers.sum() == sum(map(len, own)) and (held.level(held.words) > 0).mean() < 0.1


def test_levels_come_back_and_few_are_false():
    rng = np.random.default_rng(3)
    h = lm.mix(np.arange(1, 40_001).astype(np.uint64))
    level = lm.level_of(rng.integers(1, 300, 20_000))
    size = int(level.sum()) * lm.ITEM_BITS // 64 * 64
    own = lm.Slice(0, 1, size, np.frombuffer(lm.segment(h[:20_000], level, size), np.uint8), h[:0], np.zeros(0, np.int64))
    own.buckets = 1
    lm_level = own.level(h)
    assert (lm_level[:20_000] >= level).all() and (lm_level[:20_000] == level).mean() > 0.99 and (lm_level[20_000:] == 0).mean() > 0.99


def test_probabilities_sum_to_at_most_one():
    pairs, uni = Counter({"a": 57, "b": 23, "c": 1}), Counter({"a": 313, "b": 77, "c": 12, "d": 1001})
    total = sum(uni.values())
    p = lambda w: (lm.least_of(lm.level_of(np.array([uni[w]])))[0] + 1) / (total + len(uni) + 1)
    c = lambda w: lm.least_of(lm.level_of(np.array([pairs[w]])))[0]
    most = lm.most_of(lm.level_of(np.array([sum(pairs.values())])))[0]
    assert sum((c(w) + lm.MU * p(w)) / (most + lm.MU) for w in ["a", "b", "c", "d", "new"]) <= 1


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scored(none).count() == 0
    untrained = lm.scored(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in untrained] == [(3, 0, 0, 0.0)]
