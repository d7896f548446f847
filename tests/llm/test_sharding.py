import hashlib
import zlib
from collections import Counter

import pytest
from lodegraph.llm import queries, sharding


def digest(x, n, seed=2024):
    return int(hashlib.sha256(f"{seed}:{'' if x is None else x}".encode()).hexdigest()[:n], 16)


def plain(rows, shards):
    """(doc_id, size, crc, shard, slot) of rows (doc_id, text, source), by sorting everything."""
    own = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "" if s is None else f"={s}") for i, t, s in rows]
    of, ranked = Counter(r[3] for r in own), []
    for source in of:
        mine = sorted((r for r in own if r[3] == source), key=lambda r: (digest(r[0], 15), r[0] is not None, r[0] or 0, r[1:]))
        start = (digest(source, 8) + 0.5) / 4294967296
        ranked += [((place - start) / of[source], source, r) for place, r in enumerate(mine, 1)]
    ranked.sort(key=lambda x: x[:2])
    n, out = len(ranked), []
    for place, (_, _, r) in enumerate(ranked):
        shard = place * shards // n
        out.append((*r[:3], shard, place - -(-shard * n // shards)))
    return sorted(out, key=str)


ROWS = [(i, f"text {i} é", "hot" if i % 3 else f"s{i % 11}") for i in range(500)]
ODD = [(7, "same", "hot")] * 40 + [(None, None, None), (None, "", None), (None, "x", "hot"), (900, "y" * 100_000, "rare"), (901, None, "one"), (902, "", "two")]


@pytest.mark.parametrize("parts", [1, 16, 4096])
def test_equals_a_full_sort(spark, parts):
    docs = spark.createDataFrame(ROWS + ODD, "doc_id long, text string, source string").repartition(6)
    narrow = docs.selectExpr("doc_id", "source", "octet_length(coalesce(text, '')) + 1L as size", "crc32(coalesce(text, '')) as text_crc32")
    got = sharding.interleaved(narrow, 7, ties=["size", "text_crc32"], parts=parts)
    assert sorted((tuple(r[c] for c in ("doc_id", "size", "text_crc32", "shard", "slot")) for r in got.collect()), key=str) == plain(ROWS + ODD, 7)


def test_every_shard_has_the_mixture(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    got = sharding.assigned(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted(sizes) == list(range(8))
    for shard, size in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(size))
    for source, n in Counter(s for _, _, s in ROWS).items():
        for shard in range(8):
            assert abs(sum(r["source"] == source and r["shard"] == shard for r in got) - n / 8) <= 2


def test_rare_sources_do_not_crowd_one_shard(spark):
    docs = spark.createDataFrame([(i, "t", f"only{i}") for i in range(800)], "doc_id long, text string, source string")
    firsts = Counter(r["shard"] for r in sharding.interleaved(docs, 8, parts=64).collect())
    assert set(firsts.values()) == {100}


def test_names_nulls_and_empty_tables(spark):
    odd = spark.createDataFrame([(1, "a", "s", 5, "kept", "r", 2.0), (2, "b", None, 6, None, "q", None)], "doc_id long, text string, source string, shard int, _row string, _by string, `a.b` double")
    got = sharding.interleaved(odd, 3)
    assert got.columns == ["doc_id", "text", "source", "_row", "_by", "a.b", "shard", "slot"]
    assert sorted((r["doc_id"], r["_row"], r["a.b"]) for r in got.collect()) == [(1, "kept", 2.0), (2, None, None)]
    assert sharding.assigned(odd.limit(0)).collect() == []


def test_only_built_in_functions(spark):
    docs = spark.createDataFrame(ROWS[:20], "doc_id long, text string, source string")
    plan = sharding.assigned(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapPartitions"))


def test_shards_as_files(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    sharding.write_shards(docs, f"{tmp_path}/out", 4, files=6)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in back.collect()) == ROWS
    assert Counter(r["shard"] for r in back.collect()) == {k: 125 for k in range(4)}


def test_registered_query(spark, tmp_path):
    spark.createDataFrame(ROWS + ODD, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_interleaved_sharding"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "size", "text_crc32", "shard", "slot")) for r in got), key=str) == plain(ROWS + ODD, 8)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
