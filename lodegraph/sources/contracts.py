"""Authored contracts: OpenAPI documents, Kubernetes manifests and CI workflows as rows.

Files are a table (project, path, content).  ``structured`` reads JSON and YAML into one JSON text a document;
everything after that is built-in JSON functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pointer_escape

try:
    import yaml
except ImportError:  # then YAML files have no documents
    yaml = None

# Shapes of file names, HTTP methods, and keys of a GitLab file that are no jobs.
OPENAPI = r"(?i)(?:^|/)(?:openapi|swagger)(?:\.[^./]+)?\.(?:json|ya?ml)$"
INTERFACE = r"(?i)\.(?:graphql|gql|proto)$|(?:^|/)asyncapi(?:\.[^./]+)?\.(?:json|ya?ml)$"
INFRASTRUCTURE = r"(?:^|/)(?i:Dockerfile(?:\.[^/]+)?)$|(?i:\.tf)$|(?:^|/)Chart\.yaml$"
DOCUMENTATION = r"(?i)(?:^|/)(?:README|ARCHITECTURE|CONTRIBUTING|SECURITY)\.md$"
WORKFLOW = r"(?i)^\.github/workflows/.+\.ya?ml$|^(?:\.gitlab-ci\.ya?ml|azure-pipelines\.ya?ml|Jenkinsfile|bitbucket-pipelines\.ya?ml|\.woodpecker\.ya?ml)$|^\.circleci/config\.ya?ml$"
DECISION = r"(?i)(?:^|/)(?:adr|adrs|decisions)/.+\.md$|(?:^|/)ADR[-_0-9].+\.md$"
METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]
NO_JOBS = ["stages", "variables", "workflow", "include", "default", "image", "services", "cache", "before_script", "after_script"]


def file_class(path: Column) -> Column:
    """What a path makes a candidate of: openapi, interface, infrastructure, ci, decision or documentation; null for none."""
    shapes = {"openapi": OPENAPI, "interface": INTERFACE, "infrastructure": INFRASTRUCTURE, "ci": WORKFLOW, "decision": DECISION, "documentation": DOCUMENTATION}
    return F.coalesce(*(F.when(path.rlike(shape), F.lit(name)) for name, shape in shapes.items()))


def _loader() -> Any:
    """A loader for which only true and false are truth values: ``on`` is a key like any other."""

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(tag, shape) for tag, shape in v if tag != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    return Loader


def documents_of(path: str, text: str) -> list[str] | None:
    """The objects of a file as JSON; other documents are dropped, and a file that cannot be read gives None."""
    try:
        if path.lower().endswith(".json"):
            found = [json.loads(text)]
        elif yaml is not None:
            found = list(yaml.load_all(text, _loader()))
        else:
            return None
        return [json.dumps(d, separators=(",", ":"), ensure_ascii=False, default=str) for d in found if isinstance(d, dict)]
    except (ValueError, RecursionError) + ((yaml.YAMLError,) if yaml is not None else ()):
        return None


def structured(files: DataFrame) -> DataFrame:
    """(project, path, doc, body): the documents of JSON and YAML files by their place, from 0; a file that cannot be read
    has one row with a null body."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for project, path, text in zip(*(batch.column(c).to_pylist() for c in ("project", "path", "content")), strict=True):
                found = documents_of(path or "", text or "")
                rows += [(project, path, 0, None)] if found is None else [(project, path, n, body) for n, body in enumerate(found)]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["project", "path", "doc", "body"])

    return files.select(F.col("project").cast("string").alias("project"), "path", "content").mapInArrow(read, "project string, path string, doc int, body string")


def _at(path: str, body: str = "body") -> Column:
    return F.get_json_object(body, path)


DOC = ["project", "path", "doc"]


def apis(documents: DataFrame) -> DataFrame:
    """(project, path, doc, title, version, specification, body) of the documents that are OpenAPI or Swagger."""
    own = documents.where(_at("$.openapi").isNotNull() | _at("$.swagger").isNotNull())
    return own.select(*DOC, F.coalesce(_at("$.info.title"), F.concat("project", F.lit(" API"))).alias("title"), _at("$.info.version").alias("version"), F.coalesce(_at("$.openapi"), _at("$.swagger")).alias("specification"), "body")


def _schemas() -> Column:
    return F.from_json(F.coalesce(_at("$.components.schemas"), _at("$.definitions")), "map<string,string>")


def schemas(found: DataFrame) -> DataFrame:
    """(project, path, doc, title, schema, pointer) of ``apis``."""
    own = found.select(*DOC, "title", F.explode(F.map_keys(_schemas())).alias("schema"))
    return own.withColumn("pointer", F.concat(F.lit("/components/schemas/"), "schema"))


def _named(operation: Column, names: Column) -> Column:
    """Those of a document's names that stand behind a slash in a text: what follows each slash is cut at the lengths
    that names have and looked up among them, whatever their number; names with a slash of their own are searched."""
    parts = F.split(operation, "/")
    after = F.slice(parts, F.lit(2), F.size(parts))
    lengths = F.array_distinct(F.transform(names, lambda n: F.length(n)))
    cut = F.flatten(F.transform(after, lambda x: F.transform(lengths, lambda k: F.substr(x, F.lit(1), k))))
    found = F.array_intersect(names, cut)
    with_slash = F.filter(names, lambda n: F.contains(n, F.lit("/")) & F.contains(operation, F.concat(F.lit("/"), n)))
    return F.array_union(found, with_slash)


def endpoints(found: DataFrame, named: bool = False) -> DataFrame:
    """(project, path, doc, title, method, route, pointer, operation_id, deprecated, tags, operation) of ``apis``; with
    ``named``, also ``schemas``: the document's schemas that the operation's text has behind a slash."""
    held = F.coalesce(F.map_keys(_schemas()), F.array().cast("array<string>"))
    names = [held.alias("names")] if named else []
    read = found.select(*DOC, "title", *names, F.from_json(_at("$.paths"), "map<string,string>").alias("paths"))  # once a document
    routes = read.select(*DOC, "title", *(["names"] if named else []), F.explode("paths").alias("route", "item"))
    own = routes.select(*DOC, "title", "route", *(["names"] if named else []), F.explode(F.from_json("item", "map<string,string>")).alias("key", "operation")).where(F.lower("key").isin(METHODS))
    pointer = F.concat(F.lit("/paths/"), pointer_escape(F.col("route")), F.lit("/"), "key")
    schemas = [_named(F.col("operation"), F.col("names")).alias("schemas")] if named else []
    return own.select(*DOC, "title", F.upper("key").alias("method"), "route", pointer.alias("pointer"), _at("$.operationId", "operation").alias("operation_id"), _at("$.deprecated", "operation").try_cast("boolean").alias("deprecated"), F.from_json(_at("$.tags", "operation"), "array<string>").alias("tags"), "operation", *schemas)


def schema_references(found: DataFrame) -> DataFrame:
    """(project, path, doc, method, route, schema): operations whose text has a schema's name behind a slash, in one
    document.  A name that another one begins with is found in that as well, as a plain search does."""
    return endpoints(found, named=True).select(*DOC, "method", "route", F.explode("schemas").alias("schema"))


def manifests(documents: DataFrame) -> DataFrame:
    """(project, path, doc, kind, namespace, name, entity_kind, relation, secret, keys) of Kubernetes manifests: documents with
    an API version, a kind and a name.  Of secrets and maps of settings only the keys are read."""
    kind, name = _at("$.kind"), _at("$.metadata.name")
    own = documents.where(_at("$.apiVersion").isNotNull() & (F.coalesce(kind, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != ""))
    entity = F.when(kind.rlike("(?i)Deployment|StatefulSet|DaemonSet"), "deployment").when(kind.rlike("(?i)Service|Ingress"), "service").when(kind.rlike("(?i)ConfigMap|Secret"), "environment").otherwise("deployment")
    keys = F.when(kind.isin("Secret", "ConfigMap"), F.array_sort(F.coalesce(F.map_keys(F.from_json(_at("$.data"), "map<string,string>")), F.array().cast("array<string>"))))
    out = own.select(*DOC, kind.alias("kind"), F.coalesce(_at("$.metadata.namespace"), F.lit("default")).alias("namespace"), name.alias("name"), entity.alias("entity_kind"), (kind == "Secret").alias("secret"), keys.alias("keys"))
    return out.withColumn("relation", F.when(F.col("entity_kind") == "deployment", "deploys").otherwise("contains"))


def workflows(files: DataFrame) -> DataFrame:
    """(project, path, label, jobs, triggers) of CI files, by paths relative to their project: jobs in order, stages of a
    Jenkinsfile as they come, ``pipeline`` where there are none."""
    own = files.where(F.col("path").rlike(WORKFLOW))
    base = F.element_at(F.split("path", "/"), -1)
    none = F.array().cast("array<string>")
    keys = lambda path: F.coalesce(F.map_keys(F.from_json(_at(path), "map<string,string>")), none)
    listed = lambda path: F.coalesce(F.from_json(_at(path), "array<string>"), none)
    jenkins = own.where(base == "Jenkinsfile").select("project", "path", base.alias("label"), F.regexp_extract_all("content", F.lit(r"""\bstage\s*\(\s*["']([^"']+)["']"""), F.lit(1)).alias("jobs"), none.alias("triggers"))
    first = structured(own.where(base != "Jenkinsfile")).where("doc = 0 and body is not null")
    gitlab = F.filter(F.map_keys(F.from_json("body", "map<string,string>")), lambda k: ~k.startswith(".") & ~k.isin(NO_JOBS))
    other = F.array_distinct(F.concat(keys("$.jobs"), keys("$.workflows.jobs"), listed("$.stages")))
    jobs = F.array_sort(F.when(F.col("path").rlike(r"(?i)^\.gitlab-ci\."), gitlab).otherwise(other))
    rest = first.select("project", "path", F.coalesce(_at("$.name"), base).alias("label"), jobs.alias("jobs"), listed("$.on").alias("triggers"))
    both = jenkins.select(F.col("project").cast("string").alias("project"), "path", "label", "jobs", "triggers").unionByName(rest)
    return both.withColumn("jobs", F.when(F.size("jobs") > 0, F.col("jobs")).otherwise(F.array(F.lit("pipeline"))))
