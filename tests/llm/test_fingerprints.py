import hashlib

import numpy as np
from lodegraph.llm import fingerprints as fp


def plain(text):
    """Entries of one text, k-mer by k-mer, by the definition."""
    raw = text.encode()
    if not raw:
        return [0] * fp.BINS
    data = np.frombuffer(raw, np.uint8)
    width, seen, bins = min(fp.KMER, len(raw)), {}, {}
    bits = max(fp.PLACE_BITS, (len(raw) - 1).bit_length())
    roll = fp.Rolling(data, 53)
    for i in range(len(raw) - width + 1):
        h = roll.spans(np.array([i]), np.array([i + width])) >> fp.U(bits)
        n = seen.get(int(h[0]), 0)
        seen[int(h[0])] = n + 1
        g = fp.mix(h * fp.U(0x9E3779B97F4A7C15) + fp.mix(np.array([n], fp.U)))
        bins.setdefault(int(g[0]) >> 64 - fp.BIN_BITS, []).append((int(g[0]) >> 64 - fp.BIN_BITS - fp.VALUE_BITS, i, g))
    out = [0] * fp.BINS
    for b, own in bins.items():
        own = sorted(own, key=lambda x: x[:2])
        chosen = sorted((own + own[:1])[: fp.TUPLE] if len(own) == 1 else own[: fp.TUPLE], key=lambda x: x[1])
        e = fp.mix(np.array([len(own) < fp.TUPLE], fp.U))
        for _, _, g in chosen:
            e = fp.mix(e * fp.U(31) + g)
        out[b] = int(e[0] % fp.U(65535)) + 1
    return out


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgé"), 4)) for _ in range(n))


def test_signatures_by_definition_whatever_the_block():
    rng = np.random.default_rng(0)
    texts = ["", "short", "ab" * 300, "😀é" * 9, *(words(rng, int(n)) for n in rng.integers(1, 120, 30)), "x" * 12, "y" * 13]
    together = fp.sketch(texts)
    assert [list(map(int, r)) for r in together] == [plain(t) for t in texts]
    assert (together[5] == fp.sketch([texts[5]])[0]).all()


def test_order_matters_and_edits_cost():
    rng = np.random.default_rng(1)
    a, b = words(rng, 400), words(rng, 400)
    parts = a.split(" ")
    one, small, swapped, other = fp.sketch([a, a.replace(parts[50], "zz", 1), " ".join(parts[200:] + parts[:200]), b])
    like = lambda x: float(fp.likeness(one[None], x[None])[0])
    assert like(one) == 1 and like(small) > 0.9 > like(swapped) > like(other)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), words(rng, int(rng.integers(0, 90)))) for i in rng.permutation(300) * 7]
    rows += [(5000, None), (5001, ""), (5002, "é"), (-9, "😀" * 50), (9000, words(rng, 30_000))]
    docs = spark.createDataFrame([(*r, 0, True) for r in rows], "doc_id long, text string, range int, guest boolean").repartition(6)
    got = {r.doc_id: r for r in fp.compare(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = fp.sketch([text, edited, after])
        want = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *fp.as_text(np.stack([a, b])), float(fp.likeness(a[None], b[None])[0]), float(fp.likeness(a[None], c[None])[0]))
        assert tuple(got[i]) == want


def test_edges(spark):
    schema = "doc_id long, text string"
    assert fp.compare(spark.createDataFrame([], schema)).count() == 0
    alone = fp.compare(spark.createDataFrame([(1, "abc def")], schema)).collect()
    assert [(r.near_next, r.edited_sha256) for r in alone] == [(1.0, hashlib.sha256(b"abc abc").hexdigest())]
    rows = [(None, f"text {i % 3}") for i in range(60)] + [(4, "same")] * 20 + [(3, "end")]
    got = fp.compare(spark.createDataFrame(rows, schema).repartition(5)).collect()
    assert len(got) == 81 and len({r.fingerprint for r in got}) == 5
    assert len(fp.fingerprints(spark.createDataFrame(rows, schema)).distinct().collect()) == 5
