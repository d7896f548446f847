"""Answers: what a question asks for by kind, overviews, diversified answers against a plain fold, budgets."""

import random

from lodegraph.operators import ranking


def things(spark, rows):
    own = [(i, k, label, i, a, p, n, m) for i, k, label, a, p, n, m in rows]
    return spark.createDataFrame(own, "id string, kind string, label string, key string, aliases array<string>, project string, file_count long, mechanism string")


def test_aspects_and_broad_questions():
    assert ranking.aspects(["owners", "runtime", "x"]) == ["core", "ownership"]
    # 'owners' and 'container' ask for a kind, but do not make a question broad
    assert not ranking.is_broad(["owners", "container", "document"]) and ranking.is_broad(["owner", "api", "docs"])


def test_a_kind_that_is_asked_for_matches_without_terms(spark):
    own = things(spark, [
        ("1", "language", "go", [], None, 20_000, None), ("2", "language", "c", [], None, 50, None), ("3", "language", "r", [], None, None, None), ("4", "package", "app_core", [], None, 1, None),
        ("5", "package", "scores", [], None, 1, None), ("6", "protocol", "x", [], None, 1, "N-API Core"), ("7", "api", "y", [], None, 1, "protobuf 3"), ("8", "owner", "me", [], None, 1, None),
    ])
    score = lambda question: {r.id: r.score for r in ranking.matches(own, question).collect()}
    assert score("languages") == {"1": 1900.0, "2": 905.0, "3": 900.0}
    got = score("runtime schema")
    assert got.keys() == {"4", "6", "7"} and got["4"] == 700.0 and got["6"] == 300.0 and got["7"] == 750.0
    # three terms that are not broad: a kind alone is not enough
    assert score("owner of apple pears trees") == {}
    assert score("owner docs workflow apple")["8"] >= 850


def test_a_question_that_is_its_scope_gives_an_overview(spark):
    own = things(spark, [("p", "project", "shop", [], "shop", None, None), ("s", "service", "till", [], "shop", None, None), ("o", "owner", "team", [], None, None, None), ("q", "owner", "other", [], None, None, None), ("x", "unknown", "z", [], "shop", None, None), ("y", "api", "w", [], "else", None, None)])
    links = spark.createDataFrame([("o", "p"), ("q", "y")], "src string, dst string")
    part = ranking.scoped(own, links, "shop")
    assert {r.id for r in part.collect()} == {"p", "s", "o", "x"}
    assert [(r.id, r.score) for r in ranking.ranked(part, "Shop", scope="shop").orderBy("place").collect()] == [("p", 1000.0), ("s", 900.0), ("o", 500.0)]
    assert [r.id for r in ranking.ranked(part, "shop till", scope="shop").collect()] == ["s"]
    assert ranking.scoped(own.limit(0), links, "shop").collect() == []


def test_answered_equals_a_fold_over_all_matches(spark):
    rng = random.Random(11)
    for n, kinds, labels in ((0, 1, 1), (40, 2, 3), (300, 5, 4), (300, 3, 200), (200, 6, 400)):
        rows = [(f"e{i:03d}", f"k{rng.randrange(kinds)}", rng.choice("aA") + str(rng.randrange(labels)), float(rng.randrange(1, 9)), 1) for i in range(n)]
        found = spark.createDataFrame(rows, "id string, kind string, label string, score double, matched int")
        order = [r.id for r in found.orderBy(*ranking._best()).collect()]
        by = {r[0]: r for r in rows}
        led, kinds_led, labels_led = [], [], set()
        for i in order:
            _, kind, label, _, _ = by[i]
            if kinds_led.count(kind) < 2 and label.lower() not in labels_led:
                led.append(i)
                kinds_led.append(kind)
                labels_led.add(label.lower())
        want = (led + [i for i in order if i not in led])[:12]
        assert [r.id for r in ranking.answered(found, 12).orderBy("pick").collect()] == want


def test_budgets_count_what_is_left_out(spark):
    own = things(spark, [(f"e{k:02d}", "thing", f"red {k}", [str(a) for a in range(10)], None, None, None) for k in range(30)])
    links = spark.createDataFrame([(f"l{k:02d}{j}", f"e{k:02d}", f"e{(k + j) % 30:02d}") for k in range(30) for j in range(1, 6)], "id string, src string, dst string")
    few = ranking.ranked(own, "red", 10)
    got = ranking.budgeted(ranking.matches(own, "red"), links, own, few).head().asDict()
    chosen = {r.id for r in few.collect()}
    owners = {}
    for r in sorted(links.collect(), key=lambda r: r.id):
        who = r.src if r.src in chosen else r.dst if r.dst in chosen else None
        if who and len(owners.setdefault(who, [])) < 4:
            owners[who].append(r)
    kept = sorted((r for x in owners.values() for r in x), key=lambda r: r.id)
    other = {e for r in kept[:24] for e in (r.src, r.dst)} - chosen
    assert got == {"total_matches": 30, "entities": 10, "relations": 24, "omitted_relations": len(kept) - 24, "related": min(24, len(other)), "omitted_related": max(0, len(other) - 24), "omitted_aliases": 20, "truncated": True}
