import itertools
import random

import pytest
from lodegraph.operators import changes, graph, merge, search


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(n,) for n in ("api", "cli", "core", "web", "worker")], "node string")
    edges = spark.createDataFrame([("web", "api"), ("worker", "api"), ("api", "core"), ("cli", "core")], "src string, dst string")
    return nodes, edges


def test_centrality(small):
    found = {r.node: r for r in graph.degrees(*small).join(graph.hotspots(*small), "node").join(graph.betweenness(*small), "node").collect()}
    core, api = found["core"], found["api"]
    assert (core.fan_in, core.fan_out, core.reach, core.hotspot, core.betweenness) == (2, 0, 4, True, 0.0)
    assert (api.fan_in, api.fan_out, api.reach, api.hotspot, api.betweenness) == (2, 1, 2, True, 2.0)


def test_shortest_paths_are_the_smallest(spark):
    rng = random.Random(3)
    names = "abcdefg"
    links = {(a, b) for a, b in itertools.permutations(names, 2) if rng.random() < 0.25}
    edges = spark.createDataFrame(sorted(links), "src string, dst string")
    got = {(r.origin, r.node): (r.distance, list(r.path), r.ways) for r in graph.traverse(edges, spark.createDataFrame([(n,) for n in names], "origin string")).collect()}
    want = {}
    for n in range(1, len(names) + 1):
        for p in itertools.permutations(names, n):
            if all(x in links for x in itertools.pairwise(p)):
                d, best, ways = want.get((p[0], p[-1]), (n - 1, list(p), 0))
                if d == n - 1:
                    want[p[0], p[-1]] = (d, min(best, list(p)), ways + 1)
    assert got == want


def test_cycles_and_dangling(spark, small):
    nodes, edges = small
    assert graph.cyclic_core(edges).count() == 0
    looped = edges.union(spark.createDataFrame([("core", "web"), ("core", "core")], "src string, dst string"))
    assert {(r.src, r.dst) for r in graph.cyclic_core(looped).collect()} == {("web", "api"), ("api", "core"), ("core", "web")}
    odd = edges.union(spark.createDataFrame([("x", "api"), ("api", "y"), ("x", "y")], "src string, dst string"))
    assert {(r.src, r.dst, r.missing) for r in graph.dangling(nodes, odd).collect()} == {("x", "api", "from"), ("api", "y", "to"), ("x", "y", "both")}


def test_edge_precedence(spark):
    rows = spark.createDataFrame([("a", "b", "inferred", 1, 1), ("a", "b", "contract", 2, 2), ("a", "b", "inferred", 1, 3), ("a", "b", "contract", 2, 4)], "src string, dst string, source string, rank int, seq int")
    assert [(r.source, r.evidence) for r in merge.merge_edges(rows, ["src", "dst"]).collect()] == [("contract", 3)]


def test_diff_with_nulls(spark):
    base = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, v string")
    head = spark.createDataFrame([(1, None), (2, None), (4, "z")], "id int, v string")
    assert sorted(map(tuple, changes.keyed_diff(base, head, "id", ["v"]).collect())) == [(2, "updated", "v"), (3, "removed", ""), (4, "added", "")]


def test_rare_terms_beat_stop_words(spark):
    docs = spark.createDataFrame([(i, f"check windows {i}") for i in range(40)] + [(99, "userAuthentication")], "id int, text string")
    assert search.search(docs, "how do we check who a user is", "id", "text", 5).head().id == 99
