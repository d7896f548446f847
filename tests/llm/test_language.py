import numpy as np
import pyarrow as pa
import pytest
from lodegraph.llm import language

PARTS = {"a": ["thing", "ion", "the ", "er "], "b": ["sch", "ung ", "ein ", "ö"], "c": ["que ", "ño", "los ", "ció "]}


def text(rng, lang, n):
    return "".join(rng.choice(PARTS[lang], n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, text(rng, lang, int(rng.integers(20, 200))), lang) for i, lang in enumerate(rng.choice(list(PARTS), 600))]
    rows += [(1000, None, "a"), (1001, "", "a"), (1002, " 12 ++\n", "b"), (None, text(rng, "b", 60), "b"), (1003, text(rng, "c", 9000), None), (1004, text(rng, "a", 50), "a"), (1004, text(rng, "a", 50), "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as p", "'x' as lang_pred")


def test_held_out_accuracy_and_edges(docs):
    got = language.identify(docs).collect()
    assert len(got) == docs.count()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    own = [r for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert any(r.held_out for r in own) and not all(r.held_out for r in own)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in own if r.held_out]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "c" and by[None].lang_pred == "b" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and 1002 not in {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(docs):
    none = docs.where("false")
    assert language.identify(none).count() == 0
    net = language.learn(none)
    assert {r.lang_pred for r in language.identify(docs, net).collect()} == {"und"}


def test_windows_tile_whole_texts():
    raw = [b"", b"Ab" * 300, b"x", b"y" * language.WINDOW]
    windows, own, size = language.tiled(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, b in enumerate(raw):
        back = b"".join(w[: language.WINDOW].tobytes() for w in windows[own == i])
        assert back.rstrip(b"\0") == b.lower()
    assert size.min() >= 1


def test_responses_match_plain_convolution():
    net = language.train(["abc def"] * 4, list("xyxy"), epochs=1)
    windows = np.random.default_rng(1).integers(0, 256, (3, language.WINDOW + language.WIDE - 1)).astype(np.uint8)
    want = [[max(float(net.embed[w[i : i + language.WIDE]].ravel() @ net.filters[:, f]) for i in range(language.WINDOW)) for f in range(net.filters.shape[1])] for w in windows]
    assert np.allclose(net.maxima(windows), want, atol=1e-4)
    assert language.classify(net, pa.array([], pa.string())).to_pylist() == []


def test_a_rare_language_is_learned(spark):
    rng = np.random.default_rng(1)
    rows = [(i, text(rng, "ab"[i % 2], 80), "ab"[i % 2]) for i in range(3000)] + [(i, text(rng, "c", 80), "c") for i in range(5000, 5006)]
    rows += [(9002, text(rng, "a", 80), "d") for _ in range(900)]  # one id: all hashes are the same
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language.learn(docs, 40).classes) == {"a", "b", "c", "d"}
    assert language.shares({"a": 100, "b": 3, "c": 50}, 40) == {"b": 3, "c": 18, "a": 19}


def test_rows_stay_without_languages(docs):
    kept = language.keep_identified(docs.withColumn("lang", language.F.lit(None).cast("string")))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3  # null, empty and letterless


def test_windows_to_learn_from_are_drawn_over_whole_texts(spark, monkeypatch):
    long = "".join(f"{i:07d} " for i in range(200_000))  # longer than a piece
    docs = spark.createDataFrame([(i, long) for i in range(12)] + [(99, "short"), (100, "")], "doc_id long, text string")
    got = docs.select("doc_id", language.drawn("text", language.F.xxhash64("doc_id")).alias("w")).collect()
    width = language.WINDOW + language.WIDE - 1
    at = [int(bytes(r.w)[i : i + 7]) for r in got if r.doc_id < 99 for i in range(0, len(r.w), width)]
    assert len(at) == 12 * language.EACH_TEXT and min(at) < 50_000 and max(at) > 150_000
    assert [len(r.w) for r in got if r.doc_id >= 99] == [width, width]


def test_long_texts_are_tiled_in_pieces_alike(monkeypatch):
    raw = np.frombuffer(bytes(np.random.default_rng(0).integers(1, 255, 5000).astype(np.uint8)), np.uint8)
    want = language.tiled(raw, np.array([0, 5000]))
    monkeypatch.setattr(language, "PIECE", 1024)
    got = [np.concatenate(x) for x in zip(*language.tiles(raw, np.array([0, 5000])))]
    assert all(np.array_equal(a, b) for a, b in zip(got, want))
