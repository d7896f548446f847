import numpy as np
import pyarrow as pa
import pytest
from lodegraph.llm import suffix


def brute(rows, keep):
    """rows: (order key, bytes), in any order; the kept bytes of each."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    seen, out = {}, {}
    for i in order:
        b = rows[i][1]
        for p in range(len(b) - suffix.WIDTH + 1):
            seen.setdefault(b[p : p + suffix.WIDTH], []).append((i, p))
    for i in order:
        b = rows[i][1]
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - suffix.WIDTH + 1):
            at = seen[b[p : p + suffix.WIDTH]]
            if len(at) > 1 and (keep == "none" or at[0] != (i, p)):
                gone[p : p + suffix.WIDTH] = True
        out[i] = np.frombuffer(b, np.uint8)[~gone].tobytes()
    return out


def texts():
    rng = np.random.default_rng(1)
    make = lambda n: "".join(rng.choice(list("abcdefgh éß  "), n))
    a, b, c = make(300), make(700), make(150)
    own = [a, a + b, make(90) + a[20:270] + make(80), b + c, make(400) + c + make(100), "x" * 520, "ab" * 300 + make(50), "", make(199), a[:200], make(300)]
    own += [make(120) + b[100:400] + make(int(n)) for n in rng.integers(0, 300, 8)]
    return own + [a + b, None, b[:250] + a[-250:]]


def test_brute_force_both_ways_and_crowded_anchors(spark):
    rows = [(i * 7 % 23, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for keep in ("none", "first"):
        want = brute([(i, (t or "").encode()) for i, t in rows], keep)
        want = {rows[k][0]: v for k, v in want.items()}
        for group in (2048, 2):
            got = {r.doc_id: bytes(r.kept) for r in suffix.cut_repeats(docs, keep, group).collect()}
            assert got == want


def test_rows_that_repeat_nulls_and_clashing_columns(spark):
    t = texts()[1]
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None), (3, "short")], "doc_id long, text string").selectExpr("*", "5 as h", "'q' as row", "7 as t", "9 as u")
    first = suffix.cut_repeats(docs, "first")
    assert sorted(len(r.kept) for r in first.collect()) == [0, 0, 0, 5, len(t.encode())]
    assert first.columns == ["doc_id", "h", "row", "t", "u", "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted(r.n_removed for r in suffix.cut_repeats(docs).collect()) == [0, 0] + 3 * [len(t.encode())]
    assert suffix.cut_repeats(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        suffix.cut_repeats(docs.withColumnRenamed("h", "kept"))


def test_contexts_that_repeat_go_through_the_factor_step(spark):
    """An exact copy is marked by the suffix array: without _mark nothing is."""
    t = texts()[1]
    docs = spark.createDataFrame([(1, t), (2, t), (3, texts()[-2])], "doc_id long, text string")
    own = docs.selectExpr("doc_id", "xxhash64(text) as t", "text")
    found = suffix.occurrences(own, 64)
    got = suffix.marks(found).collect()
    assert got and all(r.other == b"" and r.later == b"" and r.before is None for r in got if r["first"].doc_id == 1)
    assert {(r.h, r.c) for r in got} <= {(r.h, r.c) for r in found.collect()}


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 500)
    text = texts()[1] * 3
    n = len(text.encode())
    starts = []
    for _, _, data, offsets, shift in suffix.segments(pa.array([text])):
        own = suffix.Anchors(data, offsets)
        for a, b in zip(own.first, own.last):
            starts += [shift + x for x in range(a, b + 1)]
    assert starts == list(range(n - suffix.WIDTH + 1))


def test_longest_factors_follow_their_definition():
    data = np.frombuffer(b"abcabcabcxabcab" * 3, np.uint8)
    depth = 7
    starts = np.arange(len(data) - depth + 1)
    earlier, later = suffix.factors(suffix.suffix_ranks(data, depth)[starts], starts)
    words = [data[i : i + depth].tobytes() for i in starts]
    assert list(earlier) == [w in words[:i] for i, w in enumerate(words)]
    assert list(later) == [w in words[i + 1 :] for i, w in enumerate(words)]


def test_crowded_anchors_are_cut_by_ranges_of_places(spark):
    """Near copies of one passage: rows grow with their number, not with their windows or pairs."""
    near, rng = 120, np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefgh "), 700))
    rows = []
    for i in range(near):
        at, to = int(rng.integers(0, 690)), "".join(rng.choice(list("xyz"), 4))
        rows.append((i, text[:at] + to + text[at:]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = suffix.occurrences(docs.selectExpr("doc_id", "xxhash64(text) as t", "text"), 64)
    head = "struct(occ[0].doc_id is null as u, occ[0].doc_id as doc_id, occ[0].t as t, occ[0].loc as loc)"
    one = one.where("ctx is not null").dropDuplicates(["h", "c"]).selectExpr("h", "c", "1L as k", f"{head} as first", "ctx")
    windows, contexts = one.selectExpr(f"sum(length(ctx) - {suffix.WIDTH} + 1)", "count(*)").head()
    parts = suffix.ranges(one, suffix.STEPS)
    assert parts.selectExpr("sum(n)").head()[0] == windows
    assert parts.count() <= windows / suffix.STEPS + 2 * contexts
    for keep in ("none", "first"):
        want = brute([(i, t.encode()) for i, t in rows], keep)
        got = {r.doc_id: bytes(r.kept) for r in suffix.cut_repeats(docs, keep, 4).collect()}
        assert got == want
