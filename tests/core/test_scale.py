"""What travels: texts are written where they are read, and results are those of the plain way."""

import json
import re

from lodegraph.functions.text import tokens
from lodegraph.operators import connection, ranking
from lodegraph.plans import report_queries, search_queries
from lodegraph.sources import audits, contracts
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def exchanged(df):
    """The columns that each exchange of a plan deals out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bExchange hashpartitioning", line)]


OUTPUTS = [
    ("a", "python", json.dumps([{"name": "p", "version": None, "vulns": [{"id": "I"}]}, {"name": "P", "version": "1", "vulns": [{"id": "I", "aliases": ["J"]}]}])),
    ("b", "ruby", json.dumps({"results": [{"id": "B", "criticality": "high", "gem": {"name": "g"}}, {"id": "B", "gem": {"name": "G"}}, {"id": "C", "severity": 3}]})),
    ("c", "go", '{"osv":{"id":"G"}}\n{"finding":{"osv":"G","trace":[{"module":"m"}]}}'),
    ("d", "php", json.dumps({"advisories": {"v/q": {"link": "D", "severity": " Medium "}}})),
    ("e", "node", json.dumps({"vulnerabilities": {"x": {"severity": "odd", "isDirect": True, "fixAvailable": False}}, "metadata": {"vulnerabilities": {"low": 2, "total": 2}}})),
    ("f", "rust", "{"),
]


def test_audits_added_up_as_they_are_read(spark):
    own = spark.createDataFrame(OUTPUTS, "audit string, runtime string, output string")
    assert sorted(audits.severity_counts(audits.summed(own)).collect()) == sorted(audits.severity_counts(audits.entries(own)).collect())
    merged = audits.subjects(audits.entries(own)).groupBy("audit").agg(F.count("*"), F.count("version"), F.count_if("direct"), F.sum(F.size("advisories")), F.sum(F.size("severities")))
    assert sorted(map(tuple, audits.packages(own).collect())) == sorted(map(tuple, merged.collect()))


def test_texts_of_audits_do_not_travel(spark):
    # lines are dealt to suppliers as numbers and states, then counts of a whole audit travel
    assert len(exchanged(report_queries.audits(spark, SF))) == 1
    assert len(exchanged(report_queries.audit_subjects(spark, SF))) == 1


def test_texts_of_coverage_do_not_travel(spark):
    # the formats share one exchange of numbers
    own = report_queries.coverage_reports(spark, SF)
    own.collect()
    plan = own._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert sum("Exchange hashpartitioning(l_suppkey" in x and "ReusedExchange" not in x for x in final.splitlines()) == 1


def test_schemas_are_looked_up_in_their_document(spark):
    body = {"components": {"schemas": {"Order": {}, "OrderList": {}, "a/b": {}, "b": {}, "Gone": {}}}, "paths": {"/x": {"get": {"y": "#/s/OrderList"}, "put": {"y": "#/s/a/b"}, "post": {"y": "Order"}}}}
    found = spark.createDataFrame([("p", "f", 0, "t", json.dumps(body))], "project string, path string, doc int, title string, body string")
    got = {(r.method, r.schema) for r in contracts.schema_references(found).collect()}
    assert got == {("GET", "Order"), ("GET", "OrderList"), ("PUT", "a/b"), ("PUT", "b")}
    # lines and parts meet, lines go to suppliers; no pieces of texts travel
    assert len(exchanged(report_queries.api_references(spark, SF))) <= 3


def test_spaced_tokens_have_what_tokens_have(spark):
    texts = ["redSteel ring", "RED-steelRing", "a b aa", "x1Y2z", "r\u00e9d stee1", "", "  ", None, "fooBarBAZ9q", "aB"]
    terms = ["red", "steel", "ring", "bar", "aa", "re", "bb", "y2z", "y2", "baz", "ab", "fo"]
    own = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    plain = lambda t: F.exists(tokens(F.col("x")), lambda w: w.startswith(t) if len(t) >= 3 else w == t)
    got = own.select("k", *(ranking._has(ranking._spaced(F.col("x")), t) for t in terms), *map(plain, terms)).collect()
    assert all(tuple(r)[1 : 1 + len(terms)] == tuple(r)[1 + len(terms) :] for r in got)
    assert sum(v is True for r in got for v in tuple(r)[1 : 1 + len(terms)]) > 10


def test_matches_are_found_once(spark):
    # neither the catalogue nor the scores are in the plan of what is done with the matches
    few = search_queries.answer_budget(spark, SF)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "file_count" not in plan and few.collect()[0].total_matches > 0


def test_a_broad_answer_reads_its_matches_once(spark):
    own = search_queries.broad_answer(spark, SF)
    assert "documents.parquet" not in own._jdf.queryExecution().executedPlan().toString() and own.count() == 24


def test_relations_are_not_turned_round_or_shuffled(spark):
    relations = spark.createDataFrame([("r1", 1, 2), ("r0", 2, 1), ("r1", 1, 2), ("r2", 2, 3), ("r3", 3, 3), ("r4", None, 1)], "id string, src long, dst long")
    rows = spark.createDataFrame([(7, 2), (8, 3)], "query long, node long")
    own = connection._steps(rows, relations)
    assert not exchanged(own)
    assert {tuple(r) for r in own.collect()} == {(7, 2, 1, "r0", "forward"), (7, 2, 1, "r1", "reverse"), (7, 2, 3, "r2", "forward"), (8, 3, 2, "r2", "reverse")}
    # relations that are told twice are one
    pairs = spark.createDataFrame([(7, 1, 3)], "query long, a long, b long")
    got = sorted(tuple(r) for r in connection.connections(pairs, relations).collect())
    assert got == [(7, 1, 1, 2, "r0", "reverse"), (7, 2, 2, 3, "r2", "forward")]
