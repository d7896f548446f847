import hashlib
import os

import pytest
from lodegraph.sources import files, render
from lodegraph.streaming import events as streams


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("space")
    own = {
        "web/package.json": "{}", "web/sub/package.json": "{}", "web/src/a.test.ts": "x", "web/src/a.ts": "x", "api/go.mod": "module a",
        "api/node_modules/x/package.json": "{}", "README.md": "text\r\n#  Title \n# Second", "api/empty.md": "",
        "r.info": "SF:a.ts\nDA:1,0\nDA:1,2\nDA:2,0\nend_of_record\nSF:b.ts\nDA:1,1\nDA:x,1\nend_of_record",
        "c.out": "mode: set\na.go:1.1,2.2 3 1\na.go:1.1,2.2 3 0\na.go:3.1,4.2 2 0",
    }
    for name, text in own.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode())
    return str(root), own


def test_listing_roots_and_reports(spark, folder):
    root, own = folder
    found = files.list_files(spark, root, content=True)
    assert {r.path for r in found.select("path").collect()} == {p for p, text in own.items() if text and "node_modules" not in p}
    assert {r.root for r in files.project_roots(found).collect()} == {"web", "api"}
    lines = files.texts(found)
    assert [tuple(r) for r in files.titles(lines).collect()] == [("README.md", "Title")]
    assert sorted(map(tuple, files.lcov(lines.where("path = 'r.info'")).collect())) == [("r.info", "a.ts", 2, 1), ("r.info", "b.ts", 1, 1)]
    assert [tuple(r) for r in files.go_profile(lines).collect()] == [("c.out", "a.go", 5, 3)]
    assert ("web", "ts", "test", 1, "web/src/a.test.ts") in {tuple(r) for r in files.inventory(found).collect()}


def test_archive_problems(spark, folder):
    root, own = folder
    now = files.manifest(files.list_files(spark, root, content=True))
    assert {r.path: r.sha256 for r in now.collect()}["api/go.mod"] == hashlib.sha256(b"module a").hexdigest()
    then = now.where("path <> 'c.out'").selectExpr("path", "size + if(path = 'r.info', 1, 0) as size", "sha256")
    listed = then.union(spark.createDataFrame([("gone", 1, "00")], "path string, size long, sha256 string"))
    assert sorted(map(tuple, files.verify(listed, now).collect())) == [("c.out", "extra"), ("gone", "missing"), ("r.info", "mismatched")]
    assert files.verify(now, now).count() == 0


def test_written_lines_are_in_order(spark, tmp_path):
    nodes = spark.createDataFrame([("b",), ("1a-x",), ('q"',)], "id string")
    edges = spark.createDataFrame([("b", "1a-x", "event-pub-sub")], "src string, dst string, kind string")
    render.write(render.dot(nodes, edges), str(tmp_path / "g"))
    parts = sorted(p for p in os.listdir(tmp_path / "g") if p.endswith(".txt"))
    got = "".join((tmp_path / "g" / p).read_text() for p in parts).splitlines()
    assert got == ["digraph workspace {", "  rankdir=LR;", "  node [shape=box];", '  "1a-x";', '  "b";', '  "q\\"";', '  "b" -> "1a-x" [label="event-pub-sub", style=dashed];', "}"]
    assert '  n_1a_x["1a-x"]' in {r.line for r in render.mermaid(nodes, edges).collect()}
    assert '    <node id="q&quot;"/>' in {r.line for r in render.graphml(nodes, edges).collect()}


def stream(spark, at, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def test_watch_remembers_the_last_version(spark, tmp_path):
    own = stream(spark, str(tmp_path / "in"), [[("w", 1, "a"), ("v", 1, "x")], [("w", 3, "b"), ("w", 2, "a")], [("w", 4, "b")]], "workspace string, seq long, digest string")
    streams.drained(streams.watch(own).writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "state"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [("v", 1, "ready", "x"), ("w", 1, "ready", "a"), ("w", 2, "unchanged", "a"), ("w", 3, "changed", "b"), ("w", 4, "unchanged", "b")]


def test_published_deltas_are_linked(spark, tmp_path):
    own = stream(spark, str(tmp_path / "in"), [[("a", "1"), ("b", "1")], [("a", "2"), ("c", "1")]], "id string, v string")
    streams.drained(own.writeStream.foreachBatch(streams.publisher(spark, str(tmp_path / "g"), "id", ["v"])), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "g/events")).collect()
    assert sorted((r.revision, r.event, r.id, r.change) for r in got) == [(0, "snapshot", "a", "added"), (0, "snapshot", "b", "added"), (1, "delta", "a", "updated"), (1, "delta", "b", "removed"), (1, "delta", "c", "added")]
    first, second = ({(r.base_hash, r.hash) for r in got if r.revision == n} for n in (0, 1))
    assert {h for _, h in first} == {b for b, _ in second} and len(first) == len(second) == 1
