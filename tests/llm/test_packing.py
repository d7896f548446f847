import zlib

import numpy as np
import pytest
from lodegraph.llm import packing
from tokenizers import Tokenizer

TEXTS = [None, "", "Hello  World\n\nit's 12 o'clock<|endoftext|>x <|startoftext|> y", "İstanbul ΣΑΣ straße \x1c\x85\xa0 x\ty é ́z", "ab " * 9000, "q" * 20_000, "日本語 テスト 😀", "a\r\nb \n c"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join("".join(rng.choice(list("abcdeé"), 5)) for _ in range(int(rng.integers(1, 900))))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "again"), (1, rows[1][1]), (7, rows[1][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank", "3 as part").repartition(5)


def test_pieces_and_sequences(docs):
    tok = Tokenizer.from_file(packing.TOKENIZER)
    got = packing.pack(docs).collect()
    want = []
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 4096) + 2


def test_empty_table(docs):
    assert packing.pack(docs.where("false")).count() == 0


@pytest.mark.parametrize("scale", [1, 40, 3000])
def test_plan_holds_each_length_once(scale):
    rng = np.random.default_rng(scale)
    limit = 512
    count = np.bincount(np.minimum(rng.lognormal(4.8, 0.8, 400 * scale).astype(int) + 1, limit), minlength=limit + 1)
    plan = packing.make_plan(count, limit)
    back = np.zeros(limit + 1, np.int64)
    for own, n in plan:
        assert sum(own) <= limit and n > 0
        np.add.at(back, list(own), n)
    assert (back == count).all()
    least = max(-(-int(count @ np.arange(limit + 1)) // limit), count[limit // 2 + 1 :].sum())
    assert sum(n for _, n in plan) <= least * 1.01 + 2


def test_ranks_are_a_permutation_across_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    rows = spark.range(100).selectExpr("id as doc_id", "0 as piece", "id as ids_crc32", "id as start", "id % 3 as length")
    got = {}
    for r in packing.ranked(rows, 100).collect():
        got.setdefault(r.length, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def test_words_of_letters_go_to_the_model_alone():
    own = packing.WordIds(packing.TOKENIZER)
    tok, passed = own.tokenizer, []

    class Watched:
        def encode(self, x, **how):
            passed.extend(x if isinstance(x, list) else [x])
            return tok.encode(x, **how)

    own.tokenizer = Watched()
    rng = np.random.default_rng(4)
    make = lambda letters, n: "".join(rng.choice(list(letters), n))
    plain = [make("abcdeéßøÿ", int(n)) + make(".,;:!?", int(m)) for n, m in zip(rng.integers(1, 20, 500), rng.integers(0, 3, 500), strict=True)]
    other = [make("abé'.,<|>3\u0301\u0130", int(n)) for n in rng.integers(1, 9, 500)] + ["it's,", "a.b", "a\u0301.", "b.\u0338", "\u0958,", "\u00b5", "\u00f7", "x,'s"]
    text = " ".join([*plain, *other])
    assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert not [w for w in passed if w.strip(packing.SIGNS) and packing.WORD(w)]
