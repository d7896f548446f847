"""The registered queries op1 and op5 on a small table, against their contracts by brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from lodegraph.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(300)] + ["Ä", "B c", "É1"]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [text(int(n)) for n in rng.integers(1, 120, 25)]
    long = text(200)
    shared = text(90)
    rows += [long, long.replace(" ", "\t", 3), long.upper(), long + " tail", "x " + long, text(40) + " " + shared + " " + text(30), shared + shared, "", "  ", None, "one two", "ONE  two"]
    own = [(3 * k - 7, t) for k, t in enumerate(rows)]
    at = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(own, "doc_id long, text string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at, own


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1(spark, documents):
    at, own = documents
    prints = {i: fingerprint(t) for i, t in own}
    component = {i: i for i, _ in own}
    for _ in own:  # until nothing changes: as many rounds as rows at most
        component = {i: min(component[j] for j in prints if bin(prints[i] ^ prints[j]).count("1") <= 4) for i in prints}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op1_simhash_near_dedup"](spark, at).collect()}
    assert got == {i: (f"{prints[i]:016x}", component[i]) for i in prints}
    assert len(set(component.values())) < len(component)


def test_op5(spark, documents):
    at, own = documents
    texts = {i: (t or "").encode() for i, t in own}
    seen = {}
    for i, data in texts.items():
        for k in range(len(data) - 199):
            seen.setdefault(data[k : k + 200], []).append((i, k))
    gone = {i: np.zeros(len(d), bool) for i, d in texts.items()}
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i][k : k + 200] = True
    want = {}
    for i, data in texts.items():
        g = gone[i]
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        want[i] = (len(data), int(g.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~g].tobytes()).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op5_suffix_array_dedup"](spark, at).collect()}
    assert got == want and sum(x[1] > 0 for x in want.values()) > 4
