import os
import tempfile
import zlib

import corpus_pipeline
import numpy as np
import pytest
from lodegraph.llm import language, packing, quality, simhash, suffix

SF = "/root/testdata/sf0.001"
KIND = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Inputs and output of the stages: each is held against its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], SF).write.parquet(os.path.join(top, str(k)))
        found.append(spark.read.parquet(os.path.join(top, str(k))))
    return found


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    for df in stages[:-1]:
        assert df.columns == KIND and df.schema.simpleString() == stages[0].schema.simpleString()


def test_rejected_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = quality.classify(stages[0], labels).where("predicted = 1")
    assert ids(stages[1]) == ids(scores)
    langs = language.identify(stages[1]).where("lang_pred <> 'und' and score >= 0.5")
    assert ids(stages[2]) == ids(langs)
    assert len(ids(stages[2])) > 0.5 * len(ids(stages[0]))


def test_one_of_each_group_stays(stages):
    fps = sorted((r.doc_id, simhash.fingerprint(r.text)) for r in stages[2].collect())
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(fps):
        for j, b in fps[:k]:
            if bin(a ^ b).count("1") <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert ids(stages[3]) == sorted({find(i) for i, _ in fps})


def test_later_copies_are_cut(stages):
    seen, want = set(), {}
    for r in sorted(stages[3].collect(), key=lambda r: r.doc_id):
        raw = (r.text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - suffix.WIDTH + 1):
            w = raw[i : i + suffix.WIDTH]
            if w in seen:
                gone[i : i + suffix.WIDTH] = True
            seen.add(w)
        want[r.doc_id] = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode(errors="ignore")
    got = {r.doc_id: r for r in stages[4].collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_all_that_stays_is_packed(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.TOKENIZER)
    want = []
    for r in stages[4].collect():
        own = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k, at, len(own[at : at + 4096]), zlib.crc32(own[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(own), 4096))]
    got = stages[5].collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row int"
    rows = [(1, None, None, None, None, "x", 1), (None, "", "en", "a", 0, None, None), (None, "word " * 200, "en", "a", -5, None, 2), (2, "é" * 400, "fr", None, 400, "y", 3), (2, "é" * 400, "fr", None, 400, "y", 3)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()) if name != "best_fit_packing" else []
            own = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            if name == "suffix_array_dedup":  # a row that repeats is cleared, others are periodic within
                assert [x[:2] for x in got] == [x[:2] for x in own] and all(len(a[2]) <= len(b[2]) for a, b in zip(got, own))
            elif name == "simhash_near_dedup":  # null and empty texts are one class, repeats another
                assert len(got) == (3 if own else 0)
            elif name != "best_fit_packing":
                assert set(got) <= set(own)
            else:  # each row is a piece of its own at least, gapless from 0
                rows = out.collect()
                assert len(rows) == len(own) and (not rows or min(r.offset for r in rows) == 0)
