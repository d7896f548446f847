import itertools

import pytest
from lodegraph.plans import catalog

LINKS = [(i, i + 1) for i in range(11)] + [(0, 12), (12, 2), (5, 13), (13, 7), (9, 3), (14, 0)]
N = 15


def routes(nodes, links):
    """All shortest paths of each pair, by walks of growing length."""
    found = {(n, n): [(n,)] for n in nodes}
    level = list(found.values())
    while level:
        walks = [p + (b,) for paths in level for p in paths for a, b in links if a == p[-1]]
        fresh = {}
        for p in walks:
            if (p[0], p[-1]) not in found:
                fresh.setdefault((p[0], p[-1]), []).append(p)
        found |= fresh
        level = list(fresh.values())
    return found


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A supplier and a customer in each nation, and an order of one line for every link."""
    at = str(tmp_path_factory.mktemp("tables"))
    rows = {
        "nation": ("n_nationkey long", [(i,) for i in range(N)]),
        "supplier": ("s_suppkey long, s_nationkey long", [(i, i) for i in range(N)]),
        "customer": ("c_custkey long, c_nationkey long", [(i, i) for i in range(N)]),
        "part": ("p_partkey long", [(0,), (1,), (2,)]),
        "orders": ("o_orderkey long, o_custkey long", [(k, b) for k, (_, b) in enumerate(LINKS)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_returnflag string", [(k, k % 2, a, 10.0, 0.0, "R" if k % 3 else "A") for k, (a, _) in enumerate(LINKS)]),
    }
    for name, (schema, own) in rows.items():
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def test_every_pair_of_nations_is_an_edge(spark, tables):
    run = lambda name: catalog.QUERIES[name](spark, tables).collect()
    best = routes(range(N), LINKS)
    assert max(len(p[0]) for p in best.values()) > 9  # further than the eight links of the twins
    assert {(r.src, r.dst) for r in run("whole_trade_edges")} == set(LINKS)
    assert {(r.origin, r.node): (r.distance, r.path, r.ways) for r in run("whole_shortest_paths")} == {k: (len(p[0]) - 1, ">".join(map(str, min(p))), len(p)) for k, p in best.items()}
    assert {(r.origin, r.node): r.distance for r in run("whole_transitive_dependents")} == {(b, a): len(p[0]) - 1 for (a, b), p in best.items()}
    through = dict.fromkeys(range(N), 0.0)
    for paths in best.values():
        for p in paths:
            for v in p[1:-1]:
                through[v] += 1 / len(paths)
    assert {r.node: r.betweenness for r in run("whole_betweenness")} == pytest.approx(through, abs=0.001)
    profile = {r.node: r for r in run("whole_operational_profile")}
    # nation 14 sells to one only, in a line that is not returned: 8 * fan_out + 8 * authoritative
    assert (profile[14].risk, profile[14].level, profile[14].priority) == ((16.0, "low", "normal") if LINKS.index((14, 0)) % 3 == 0 else (8.0, "low", "normal"))
    assert profile[11].fan_in == 1 and profile[11].reach == sum(b == 11 and a != 11 for a, b in best)


def test_authoritative_edges_raise_the_risk(spark):
    from lodegraph.operators import graph

    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    edges = spark.createDataFrame([(0, 1, True), (1, 2, False), (2, 0, True), (2, 2, True)], "src long, dst long, authoritative boolean")
    assert dict(map(tuple, graph.authoritative(nodes, edges).collect())) == {0: 2, 1: 1, 2: 2, 3: 0}


def test_supply_graph_of_all_keys(spark, tables):
    run = lambda name: catalog.QUERIES[name](spark, tables).collect()
    links = {(f"customer:{b}", f"order:{k}") for k, (_, b) in enumerate(LINKS)} | {(f"order:{k}", f"part:{k % 2}") for k in range(len(LINKS))} | {(f"part:{k % 2}", f"supplier:{a}") for k, (a, _) in enumerate(LINKS)}
    nodes = [f"{kind}:{i}" for kind, n in (("customer", N), ("order", len(LINKS)), ("part", 3), ("supplier", N)) for i in range(n)]
    best = routes(nodes, links)
    assert {(r.src, r.dst) for r in run("supply_edges")} == links
    assert {(r.origin, r.node): (r.distance, r.ways) for r in run("supply_dependents")} == {(b, a): (len(p[0]) - 1, len(p)) for (a, b), p in best.items()}
    assert {r.node: (r.fan_in, r.fan_out) for r in run("supply_degree")} == {n: (sum(b == n for _, b in links), sum(a == n for a, _ in links)) for n in nodes}
    assert {r.node: r.reach for r in run("supply_hotspots")} == {n: sum(b == n != a for a, b in best) for n in nodes}
    through = dict.fromkeys(nodes, 0.0)
    for paths in best.values():
        for p, v in itertools.chain.from_iterable(zip(itertools.repeat(p), p[1:-1]) for p in paths):
            through[v] += 1 / len(paths)
    assert {r.node: r.betweenness for r in run("supply_betweenness")} == pytest.approx(through, abs=0.001)
