import json

import pytest
from lodegraph.sources import contracts
from pyspark.sql import functions as F

OPEN = {"openapi": "3.1.0", "info": {"title": "Shop", "version": "2"}, "components": {"schemas": {"Order": {}, "OrderList": {}, "Gone": {}}}, "paths": {"/a/~b": {"parameters": [], "GET": {"operationId": "list", "tags": ["x", "y"], "r": {"$ref": "#/components/schemas/OrderList"}}, "post": {"deprecated": True}}, "/none": {"summary": "x"}}}
KUBE = """apiVersion: v1
kind: Secret
metadata: {name: keys}
data: {b: c2VjcmV0, a: eA==}
---
- no object
---
apiVersion: apps/v1
kind: StatefulSet
metadata: {name: db, namespace: prod}
---
apiVersion: v1
kind: Service
metadata: {name: web}
---
apiVersion: v1
kind: List
"""
FILES = {
    "api/openapi.json": json.dumps(OPEN), "api/swagger.v1.yaml": "swagger: '2.0'\ndefinitions: {User: {}}\npaths: {/u: {get: {x: '#/definitions/User'}}}\n", "api/openapi.yml": "a: [", "k8s/all.yaml": KUBE,
    ".github/workflows/ci.yml": "name: Build\non: [push, pull_request]\njobs:\n  test: {}\n  build: {}\n", ".gitlab-ci.yml": "stages: [x]\n.hidden: {}\nlint: {}\nimage: y\n", "Jenkinsfile": "stage('B') { }\n stage ( \"A\" ) {}\n", "azure-pipelines.yml": "stages: [deploy, deploy]\n", ".circleci/config.yml": "version: 2\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("p", k, v) for k, v in FILES.items()], "project string, path string, content string")


def test_documents(files):
    got = {(r.path, r.doc): r.body for r in contracts.structured(files.where("path not like '.%' and path <> 'Jenkinsfile'")).collect()}
    assert got["api/openapi.yml", 0] is None and [k[1] for k in sorted(got) if k[0] == "k8s/all.yaml"] == [0, 1, 2, 3]
    assert json.loads(got["api/openapi.json", 0]) == OPEN


def test_apis(files):
    found = contracts.apis(contracts.structured(files.where("path like 'api/%'")))
    assert {(r.path, r.title, r.version, r.specification) for r in found.collect()} == {("api/openapi.json", "Shop", "2", "3.1.0"), ("api/swagger.v1.yaml", "p API", None, "2.0")}
    assert {(r.title, r.schema) for r in contracts.schemas(found).collect()} == {("Shop", "Order"), ("Shop", "OrderList"), ("Shop", "Gone"), ("p API", "User")}
    ends = {(r.method, r.route): (r.pointer, r.operation_id, r.deprecated, r.tags) for r in contracts.endpoints(found).collect()}
    assert ends == {("GET", "/a/~b"): ("/paths/~1a~1~0b/GET", "list", None, ["x", "y"]), ("POST", "/a/~b"): ("/paths/~1a~1~0b/post", None, True, None), ("GET", "/u"): ("/paths/~1u/get", None, None, None)}
    assert {(r.method, r.route, r.schema) for r in contracts.schema_references(found).collect()} == {("GET", "/a/~b", "Order"), ("GET", "/a/~b", "OrderList"), ("GET", "/u", "User")}


def test_manifests(files):
    got = [tuple(r) for r in contracts.manifests(contracts.structured(files.where("path like 'k8s/%'"))).select("kind", "namespace", "name", "entity_kind", "relation", "secret", "keys").orderBy("kind").collect()]
    assert got == [("Secret", "default", "keys", "environment", "contains", True, ["a", "b"]), ("Service", "default", "web", "service", "contains", False, None), ("StatefulSet", "prod", "db", "deployment", "deploys", False, None)]


def test_workflows(files):
    got = {r.path: (r.label, r.jobs, r.triggers) for r in contracts.workflows(files).collect()}
    assert got == {".github/workflows/ci.yml": ("Build", ["build", "test"], ["push", "pull_request"]), ".gitlab-ci.yml": (".gitlab-ci.yml", ["lint"], []), "Jenkinsfile": ("Jenkinsfile", ["B", "A"], []), "azure-pipelines.yml": ("azure-pipelines.yml", ["deploy"], []), ".circleci/config.yml": ("config.yml", ["pipeline"], [])}


def test_classes_of_files(spark):
    want = {"x/openapi.v2.json": "openapi", "a.proto": "interface", "asyncapi.yaml": "interface", "Dockerfile.dev": "infrastructure", "m/main.tf": "infrastructure", "c/chart.yaml": None, "c/Chart.yaml": "infrastructure", "docs/adr/1.md": "decision", "x/readme.md": "documentation", ".github/workflows/a.yml": "ci", "b/Jenkinsfile": None, "src/a.ts": None}
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", contracts.file_class(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in got} == want
