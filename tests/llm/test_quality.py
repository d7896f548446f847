import numpy as np
import pytest
from lodegraph.llm import quality


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(500):
        good = bool(rng.integers(0, 2))
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(rng.integers(5, 80))]
        docs.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), 5))
        labels.append((i, int(good), 0))
    docs += [(1000, None, None), (1001, "", 0), (None, "words and words", 15), (1002, "a b\n" * 50_000, 4), (3, "abc abd", 7)]
    labels += [(None, 1, 0), (9999, 0, 0), (1000, None, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, n_chars long").selectExpr("*", "1 as score", "2 as quality", "3 as id"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edges(tables):
    docs, labels = tables
    got = quality.classify(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 200 < kept.count() < 300


def test_nothing_to_learn_from(tables):
    docs, labels = tables
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert quality.classify(docs.drop("n_chars"), labels).count() == docs.count()


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    size = quality.WORDS + quality.STATS
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)), np.zeros(quality.STATS), np.ones(quality.STATS))
    raw = [b"One two\nthree two. ", b"", b"x"]
    text, place, x, stats = quality.inputs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.array([3, 0, 1]))
    for i in range(3):
        own = text == i
        at = np.concatenate((place[own], quality.WORDS + np.arange(quality.STATS)))
        v = np.concatenate((x[own], m.scaled(stats[i])))
        want = m.w0 + m.w[at] @ v + sum(m.v[at[a]] @ m.v[at[b]] * v[a] * v[b] for a in range(len(at)) for b in range(a))
        assert np.isclose(m.margins(text, place, x, stats)[i], want)
