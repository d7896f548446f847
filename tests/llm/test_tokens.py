import hashlib

import numpy as np
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from lodegraph.llm import bpe, counting
from public_tokenizers import PATTERN

TEXTS = [None, "", " ", "  ", "\n", " \n ", "Hello  World\n\n it's 12 <s> </s> <unk> <|endoftext|>", "▁ a▁▁b ▁", "tab\tx \x1c \x85\xa0 end ", "日本語 テスト 😀👩‍👩‍👧", "q" * 30_000, " " * 500 + "x" + "\n" * 70, "ab" * 5000 + " é" * 300, "!\x1c! don't\r\n\r\n   we'll"]
text = st.text(st.one_of(st.sampled_from(" \n\t'▁ab1!é日"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load(bpe.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=counting.MODEL)


@pytest.fixture(scope="module")
def counter():
    return counting.PieceCounts(counting.MODEL)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as r")


def test_bpe_round_trip_matches_the_library(docs, library):
    want = []
    for r in docs.collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=key) == sorted(want, key=key)
    assert bpe.round_trip(docs.where("false")).count() == 0
    assert {r.doc_id: r.ids for r in bpe.encoded(docs).collect()}[6] == library.encode_ordinary(TEXTS[6])


@settings(max_examples=400, deadline=None)
@given(text)
def test_bpe_matches_on_any_text(library, x):
    own = bpe.codec(bpe.RANKS)
    ids = own.encode(x)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(x)
    assert own.decode(ids).decode() == x


def test_rank_queue_gives_ranks_and_places_in_order():
    rng = np.random.default_rng(0)
    queue, held = bpe.RankQueue(50_000), {}
    for _ in range(3000):
        if rng.random() < 0.6 or not held:
            rank, place = int(rng.integers(0, 50_000) // rng.choice([1, 500])), int(rng.integers(0, 1000))
            held.setdefault(rank, []).append(place)
            queue.push(rank, [place])
        else:
            assert queue.least() == min(held)
            assert queue.take(min(held)) == sorted(held.pop(min(held)))
    while held:
        assert queue.take(queue.least()) == sorted(held.pop(min(held)))
    assert queue.least() == -1


def test_counts_match_the_library(docs, model):
    want = sorted(((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in docs.collect()))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in counting.token_counts(docs).collect())
    assert got == want
    assert counting.token_counts(docs.where("false")).count() == 0


@settings(max_examples=400, deadline=None)
@given(text)
def test_counts_match_on_any_text(model, counter, x):
    found = counting.pretokens(x)
    pieces = counter.count(list(found)) if found else []
    assert sum(n * k for n, k in zip(found.values(), pieces, strict=True)) == len(model.encode(x))


def test_each_pretoken_is_counted_once_and_joined(spark, docs):
    """Every block has its own words; the words of all are distinct before pieces are counted."""
    blocks = counting.frequencies(docs.repartition(3), 8, block=64)
    assert blocks.count() > 3
    want = set().union(*(counting.pretokens(r.text or "") for r in docs.collect()))
    rows = blocks.select("block", counting.F.inline("parts")).collect()
    words = []
    for r in rows:
        text, ends = counting.zstandard.decompress(bytes(r.words)).decode(), np.cumsum(np.frombuffer(counting.zstandard.decompress(bytes(r.sizes)), "<i4"))
        words += [(text[a:b], r.bucket) for a, b in zip([0, *ends[:-1]], ends)]
    assert {w for w, _ in words} == want and len(words) > len(want)  # blocks share pre-tokens
    assert len(set(words)) == len(want)  # all entries of one are in one bucket
    assert sorted(counting.token_counts(docs, block=64).collect(), key=str) == sorted(counting.token_counts(docs).collect(), key=str)
