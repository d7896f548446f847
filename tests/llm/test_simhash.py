import re

import numpy as np
import xxhash
from lodegraph.llm import simhash


def brute(texts):
    out = []
    for x in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        out.append(sum(1 << b for b in range(64) if 2 * sum(y >> b & 1 for y in h) > len(h)))
    return out


def classes(ids, fps):
    fps = np.array(fps, np.uint64)
    label = list(range(len(ids)))
    moved = True
    while moved:
        moved = False
        for i in range(len(ids)):
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)
            low = min((label[j] for j in near), key=lambda k: ids[k])
            for j in near:
                if label[j] != low:
                    label[j], moved = low, True
    return [ids[k] for k in label]


def test_fingerprint_matches_brute_force():
    texts = [None, "", " \n", "One", "a b c", "A b\tc  d", "é È a b c d e f a b c d", "x " * 3000, "\x1ca b\xa0c d e"]
    assert [simhash.fingerprint(x) for x in texts] == brute(texts)


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    fps = list(base) + [0, 0]
    for b in base[:30]:
        for _ in range(4):
            fps.append(b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False))))
    ids = [int(i) for i in rng.permutation(len(fps))]
    rows = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in zip(ids, fps)], "doc_id long, fp long")
    want = dict(zip(ids, classes(ids, fps)))
    split = simhash.components(simhash.similar(rows.select("fp").distinct(), block=8))
    whole = simhash.components(simhash.similar(rows.select("fp").distinct()))
    assert sorted(split.collect()) == sorted(whole.collect())
    got = {r.doc_id: r.component_id for r in rows.join(simhash.classes(rows), "fp").collect()}
    assert got == want


def test_every_plan_of_thresholds_finds_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    other = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, 4, replace=False))) for b in base]
    fps = spark.createDataFrame([(int(x.view(np.int64)),) for x in [*base, *other]], "fp long")
    chunks = [list(range(i, i + 16)) for i in range(0, 64, 16)]
    shares = [np.bincount([bin(x).count("1") for x in range(65536)]) / 65536.0] * 4
    small, large = simhash.allocate(100, chunks, shares), simhash.allocate(1e9, chunks, shares)
    assert {len(p) for p, _ in small} != {len(p) for p, _ in large}
    for plan in (small, large):
        seen = {}
        for r in simhash.signatures(fps, plan).collect():
            seen.setdefault(r.bucket, set()).add(r.fp)
        pairs = {(a, b) for g in seen.values() for a in g for b in g}
        assert all((int(a.view(np.int64)), int(b.view(np.int64))) in pairs for a, b in zip(base, other))


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([(3, "a b c d e"), (1, "A b c d e"), (None, "A b c d e"), (7, None), (7, " "), (9, "q r s t")], "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    got = sorted(((r.doc_id or 0), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 1), (1, 1), (3, 1), (7, 7), (7, 7), (9, 9)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 7, 9]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_classes_of_one_id_or_none(spark, monkeypatch):
    """1 and 1 are linked through 2 alone: one row of the three stays; so it is without ids.  Unlike
    rows of one id, or without ids, are classes of their own."""
    monkeypatch.setattr(simhash, "fingerprint_udf", lambda c: simhash.F.col(c).cast("long"))
    far = 255 << 40
    linked = [(1, 0), (1, 255), (2, 15), (None, far), (None, far + (255 << 20)), (None, far + (15 << 20))]
    alone = [(1, 0xFFFF << 44), (None, 0xFFFF << 28)]
    kept = lambda rows: sorted(r.doc_id or 0 for r in simhash.keep_one(spark.createDataFrame([(i, str(x)) for i, x in rows], "doc_id long, text string")).collect())
    assert kept(linked) == [0, 1]
    names = "doc_id long, text string, _fp string, _root int, _id int, fp string, root int, id int, kept_id int, `a.b` int"
    odd = spark.createDataFrame([(1, "0", "x", 1, 2, "y", 3, 4, 5, 6), (1, "255", "x", 1, 2, "y", 3, 4, 5, 6), (2, "15", "z", 1, 2, "y", 3, 4, 5, 6)], names)
    (row,) = simhash.keep_one(odd).collect()
    assert row.asDict().keys() == {*odd.columns} and (row["doc_id"], row["_fp"], row["_root"], row["a.b"]) == (1, "x", 1, 6)
    assert kept(linked + alone) == [0, 0, 1, 1]
