import json
import random
from collections import defaultdict

import pytest
from lodegraph.operators import connection, cycles, freshness, graph, impact, sequence
from lodegraph.plans import catalog
from pyspark.sql import functions as F

EDGE = "src long, dst long"


def random_links(seed, n, share):
    rng = random.Random(seed)
    return sorted((a, b) for a in range(n) for b in range(n) if rng.random() < share)


def distances(n, links):
    after = defaultdict(set)
    for a, b in links:
        after[a].add(b)
    far = {}
    for s in range(n):
        far[s, s], level, d = 0, {s}, 0
        while level:
            d += 1
            level = {b for a in level for b in after[a] if (s, b) not in far}
            far |= {(s, b): d for b in level}
    return far


def brute_betweenness(n, links):
    """By the number of shortest ways between all pairs."""
    far = distances(n, links)
    ways = {}
    for s, t in sorted(far, key=lambda k: far[k]):
        ways[s, t] = 1 if s == t else sum(ways[s, a] for a, b in links if b == t and a != t and (s, a) in far and far[s, a] == far[s, t] - 1)
    out = dict.fromkeys(range(n), 0.0)
    for (s, t), d in far.items():
        for v in range(n):
            if v not in (s, t) and (s, v) in far and (v, t) in far and far[s, v] + far[v, t] == d:
                out[v] += ways[s, v] * ways[v, t] / ways[s, t]
    return out


def components(n, links):
    far = distances(n, links)
    return {v: min(w for w in range(n) if (v, w) in far and (w, v) in far) for v in range(n)}


def frames(spark, n, links):
    return spark.createDataFrame([(i,) for i in range(n)], "node long"), spark.createDataFrame(links, EDGE)


@pytest.mark.parametrize(("seed", "share", "batch"), [(1, 0.08, 100_000), (2, 0.2, 3)])
def test_betweenness_of_random_graphs(spark, seed, share, batch):
    links = random_links(seed, 14, share)
    got = {r.node: r.betweenness for r in graph.betweenness(*frames(spark, 14, links), batch=batch).collect()}
    assert got == pytest.approx(brute_betweenness(14, links), abs=0.00051)


def test_betweenness_without_edges(spark):
    nodes, edges = frames(spark, 3, [(1, 1)])
    assert {r.node: r.betweenness for r in graph.betweenness(nodes, edges).collect()} == {0: 0.0, 1: 0.0, 2: 0.0}


@pytest.mark.parametrize(("seed", "share"), [(3, 0.05), (4, 0.1)])
def test_components_of_random_graphs(spark, seed, share):
    links = random_links(seed, 20, share)
    nodes, edges = frames(spark, 20, links)
    assert dict(map(tuple, cycles.strong_components(nodes, edges).collect())) == components(20, links)
    both = links + [(b, a) for a, b in links]
    ends = {x for e in links for x in e}
    assert dict(map(tuple, cycles.weak_components(edges).collect())) == {v: c for v, c in components(20, both).items() if v in ends}


def test_chain_of_components(spark):
    """Components one behind the other, the least nodes at the far end, and a ring of 30."""
    links = [(30 + i, 30 + (i + 1) % 30) for i in range(30)] + [(45, 20), (20, 21), (21, 20), (21, 10), (10, 11), (11, 10), (11, 5), (70, 45)]
    nodes, edges = frames(spark, 80, links)
    assert dict(map(tuple, cycles.strong_components(nodes, edges).collect())) == components(80, links)


def test_cycles_as_a_walk_closes_them():
    walk = cycles.back_edge_cycles
    assert walk([("b", "c"), ("c", "a"), ("a", "b")]) == [["a", "b", "c", "a"]]
    assert walk([("a", "b"), ("b", "c")]) == []
    assert walk([("a", "a"), ("b", "a")]) == [["a", "a"]]
    # entered at d, and c is left before it closes a way of its own
    assert walk([("a", "d"), ("d", "b"), ("b", "d"), ("b", "c"), ("c", "b"), ("c", "d")]) == [["b", "c", "b"], ["b", "c", "d", "b"], ["b", "d", "b"]]
    assert walk([(1, 2), (2, 3), (3, 1), (1, 3)]) == [[1, 2, 3, 1]]  # the edge to a node that is done closes none


def test_cycles_by_component(spark):
    links = [("b", "c"), ("c", "a"), ("a", "b"), ("x", "y"), ("y", "x"), ("y", "z"), ("q", "q"), ("l", "m")]
    edges = spark.createDataFrame(links, "src string, dst string")
    got = {(r.component, r.edges, ">".join(r.cycle)) for r in cycles.cycles(edges).collect()}
    assert got == {("a", 3, "a>b>c>a"), ("x", 3, "x>y>x"), ("q", 1, "q>q")}
    # of over two edges: by strong components, the ring of three is reported
    got = {(r.component, r.edges, r.cycle and ">".join(r.cycle)) for r in cycles.cycles(edges, most=2).collect()}
    assert got == {("a", 3, None), ("x", 2, "x>y>x"), ("q", 1, "q>q")}
    assert cycles.cycles(edges.limit(0)).collect() == []


def test_integrity(spark):
    nodes = spark.createDataFrame([(n,) for n in ("api", "web", "standalone")], "node string")
    row = lambda links: tuple(graph.integrity(nodes, spark.createDataFrame(links, "src string, dst string")).head())
    assert row([("web", "api")]) == (True, 3, 1, 0, 0, 1)
    assert row([("web", "api"), ("api", "web")]) == (False, 3, 2, 1, 0, 1)
    assert row([("api", "ghost"), ("phantom", "api"), ("web", "api")]) == (False, 3, 3, 0, 2, 1)


def brute_connection(relations, a, b):
    """The walk that visits neighbours in order of node, then relation, and stops at b."""
    around = defaultdict(list)
    for i, x, y in relations:
        around[x].append((y, i, "forward"))
        around[y].append((x, i, "reverse"))
    came, queue = {a: None}, [a]
    for at in queue:
        for other, i, way in sorted(around[at]):
            if other not in came:
                came[other] = (at, i, way)
                queue.append(other)
    out = []
    while b in came and came[b]:
        at, i, way = came[b]
        out.append((at, b, i, way))
        b = at
    return out[::-1]


@pytest.mark.parametrize("seed", [5, 6])
def test_connections(spark, seed):
    rng = random.Random(seed)
    relations = [(f"r{rng.randrange(1000)}-{k}", rng.randrange(25), rng.randrange(25)) for k in range(34)] + [("z", 30, 31), ("y", 31, 30), ("x", 31, 31)]
    pairs = [(k, rng.randrange(26), rng.randrange(26)) for k in range(20)] + [(20, 30, 31), (21, 3, 30), (22, 4, 4), (23, 99, 3), (24, None, 3)]
    got = connection.connections(spark.createDataFrame(pairs, "query long, a long, b long"), spark.createDataFrame(relations, "id string, src long, dst long"))
    rows = sorted(map(tuple, got.collect()))
    want = [(q, hop, *step) for q, a, b in pairs if a is not None for hop, step in enumerate(brute_connection(relations, a, b), 1)]
    assert rows == sorted(want) and max(r[1] for r in rows) > 2


def test_connections_of_nothing(spark):
    none = connection.connections(spark.createDataFrame([(1, 2, 3)], "query long, a long, b long"), spark.createDataFrame([], "id string, src long, dst long"))
    assert none.collect() == [] and none.columns == ["query", "hop", "source", "target", "relation", "direction"]


def test_a_change_reaches_all_that_depend_on_it(spark):
    links = [("web", "api"), ("api", "core"), ("core", "api"), ("tool", "lib"), ("web", "ghost")]  # with a cycle
    edges = spark.createDataFrame(links, "src string, dst string")
    own = {"web": "1", "api": "2", "core": "3", "tool": "4", "lib": "5"}

    def hashes(states, edges=edges):
        rows = freshness.transitive_hashes(spark.createDataFrame(sorted(states.items()), "node string, own_hash string"), edges).collect()
        return {r.node: r.transitive_hash for r in rows}, {r.node: r.dependencies for r in rows}

    before, counts = hashes(own)
    assert counts == {"web": 3, "api": 1, "core": 1, "tool": 1, "lib": 0}
    assert hashes(own, edges.repartition(3))[0] == before
    changed = lambda after: {k for k in before if before[k] != after[k]}
    assert changed(hashes(own | {"core": "9"})[0]) == {"web", "api", "core"}
    assert changed(hashes(own | {"lib": "9"})[0]) == {"tool", "lib"}
    # a further way to what is reached already changes nothing, a further end does
    more = edges.union(spark.createDataFrame([("web", "core")], "src string, dst string"))
    assert changed(hashes(own, more)[0]) == set()
    assert changed(hashes(own, edges.union(spark.createDataFrame([("core", "lib")], "src string, dst string")))[0]) == {"web", "api", "core"}


def test_canonical_json(spark):
    rows = spark.sql("""select named_struct('b', 1, 'a', array(named_struct('z', 'x"y', 'Y', null), null), 'é', named_struct('q', 2, 'p', true)) as s""")
    text = rows.select(freshness.canonical_json(rows, "s")).head()[0]
    assert list(json.loads(text)) == ["a", "b", "é"] and text == '{"a":[{"z":"x\\"y"},null],"b":1,"é":{"p":true,"q":2}}'


def test_following_rows_across_stretches(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(4), rng.randrange(60), k, rng.randrange(9)) for k in range(200)] + [(9, 5, 999, 1)]
    df = spark.createDataFrame(rows, "owner long, t long, id long, v long")
    got = {r.id: r.next for r in sequence.following(df, "owner", F.floor(F.col("t") / 7), ["t", "id"], "v").collect()}
    want = {}
    for owner in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == owner))
        want |= {a[1]: b[2] if b else None for a, b in zip(own, [*own[1:], None], strict=True)}
    assert got == want


def test_registered_cycles_are_those_of_the_whole_graph(spark):
    """The walk by components closes what one walk over the whole graph does."""
    at = "/root/testdata/sf0.001"
    links = [(r.src, r.dst) for r in catalog.QUERIES["visit_moves"](spark, at).collect()]
    got = [r.cycle for r in catalog.QUERIES["visit_cycles"](spark, at).collect()]
    assert sorted(got) == sorted(">".join(map(str, c)) for c in cycles.back_edge_cycles(links)) and len(got) > 100
    found = catalog.QUERIES["visit_integrity"](spark, at).head()
    known = {r.node for r in catalog.visit_queries.visits(spark, at).where("event_type = 'purchase'").collect()}
    sound = [x for x in links if set(x) <= known]
    assert tuple(found) == (False, len(known), len(links), len(cycles.back_edge_cycles(sound)), len(links) - len(sound), len(known - {x for e in sound for x in e}))


def test_impact_goes_down_with_the_first_step(spark):
    """A chain of dependents, a hotspot, and a cycle."""
    nodes = spark.createDataFrame([(n,) for n in ("core", "api", "web", "tool", "lib", "alone")], "node string")
    links = [("api", "core", "package"), ("api", "core", "import"), ("web", "api", "import"), ("tool", "api", "contract"), ("lib", "tool", "import"), ("core", "api", "import"), ("web", "ghost", "x")]
    edges = spark.createDataFrame(links, "src string, dst string, kind string")
    found = lambda *changes: {r.node: (r.scope, r.source, r.distance, r.via, ">".join(r.path), r.hotspot, r.risk) for r in impact.impact(spark.createDataFrame(changes, "node string, kind string, severity string"), nodes, edges).collect()}
    got = found(("core", "changed", "info"), ("core", "changed", "warning"), ("gone", "removed", "info"))
    assert got == {
        "core": ("direct", "core", 0, None, "core", True, "critical"), "gone": ("direct", "gone", 0, None, "gone", False, "high"), "api": ("transitive", "core", 1, "import", "core>api", True, "high"),
        "web": ("transitive", "core", 2, "import", "core>api>web", False, "high"), "tool": ("transitive", "core", 2, "contract", "core>api>tool", False, "high"), "lib": ("transitive", "core", 3, "import", "core>api>tool>lib", False, "high"),
    }
    got = found(("tool", "changed", "info"), ("alone", "added", "critical"), ("web", "changed", "info"))
    assert got["lib"] == ("transitive", "tool", 1, "import", "tool>lib", False, "low") and got["alone"][-1] == "critical" and got["web"][-1] == "medium" and len(got) == 4
    assert found((None, "changed", "info")) == {}
    summary = lambda rows: tuple(impact.impact_summary(spark.createDataFrame(rows, "scope string, distance int, risk string")).head())
    assert summary([("direct", 0, "medium"), ("transitive", 3, "high")]) == (1, 1, 3, "high") and summary([]) == (0, 0, 0, "none")
