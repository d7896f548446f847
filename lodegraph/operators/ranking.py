"""Ranked search over entities with labels, identities and aliases, and what a result brings along.

The terms of a question are few and stand in the plan: entities are read twice, once for the
document frequencies of all terms in one aggregate, once for the scores.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import locale
from ..functions.text import STOP_WORDS
from .lineage import stored

#: Weights of a score.
EXACT, PREFIX, HAYSTACK, SAME_LABEL, LABEL, IDENTITY, ALIAS, ANY, ALL_TERMS, LANGUAGE = 10_000, 250, 100, 80, 36, 24, 20, 10, 120, 400

# Words that ask for an aspect of a system, those of them that count towards a broad question, what
# entities of a kind gain where an aspect is asked for, kinds in the order of an overview, and budgets of an answer.
ASPECTS = {
    "language": (["language", "languages"], ["language", "languages"]),
    "binding": (["binding", "bindings", "bridge", "bridges"], ["binding", "bindings", "bridge", "bridges"]),
    "dependency": (["dependency", "dependencies", "depends"], ["dependency", "dependencies", "depends"]),
    "core": (["core", "runtime"], ["core", "runtime"]),
    "ownership": (["owner", "owners", "ownership", "maintainer"], ["owner", "ownership", "maintainer"]),
    "ci": (["ci", "pipeline", "pipelines", "workflow"], ["ci", "pipeline", "workflow"]),
    "deployment": (["deploy", "deployment", "infrastructure", "container"], ["deploy", "deployment", "infrastructure"]),
    "documentation": (["doc", "docs", "document", "documentation"], ["doc", "docs", "documentation"]),
    "service": (["service", "services", "api", "rpc"], ["service", "api", "rpc"]),
    "schema": (["schema", "schemas", "message", "protobuf", "proto", "contract"], ["schema", "protobuf", "proto", "contract"]),
}
GAINS = {
    "language": (["language"], 900), "binding": (["protocol"], 800), "dependency": (["package"], 650), "ownership": (["owner"], 850), "ci": (["pipeline"], 800),
    "deployment": (["deployment", "container", "environment"], 775), "documentation": (["document", "decision"], 725), "service": (["api", "endpoint", "service"], 700),
}
CORE_PACKAGE, CORE_PROTOCOL, SCHEMA, MOST_FILES = 700, 300, 750, 10_000
OVERVIEW = {"project": 1000, "service": 900, "api": 900, "package": 850, "endpoint": 800, "container": 700, "deployment": 700, "environment": 650, "pipeline": 600, "test-suite": 550, "owner": 500, "decision": 450, "document": 400}
BUDGET = {"relations": 24, "related": 24, "aliases": 8}


def aspects(terms: list[str]) -> list[str]:
    """The aspects that the terms of a question ask for."""
    return [a for a, (words, _) in ASPECTS.items() if set(words) & set(terms)]


def is_broad(terms: list[str]) -> bool:
    return sum(bool(set(words) & set(terms)) for _, words in ASPECTS.values()) >= 3


def intent(entities: DataFrame, terms: list[str]) -> Column:
    """What an entity gains by its kind where the question asks for its aspect; ``file_count``, ``mechanism`` and
    ``specification`` count where the table has them."""
    held = lambda c, kind: F.col(c) if c in entities.columns else F.lit(None).cast(kind)
    says = lambda c, x: F.coalesce(F.contains(F.lower(held(c, "string")), F.lit(x)), F.lit(False))
    kind, asked, zero = F.col("kind"), aspects(terms), F.lit(0.0)
    gain = lambda when, x: F.when(when, x).otherwise(zero)
    score = zero
    for a in asked:
        if a in GAINS:
            kinds, points = GAINS[a]
            score += gain(kind.isin(kinds), F.lit(float(points)))
    if "language" in asked:
        files = F.coalesce(held("file_count", "double").cast("double"), zero)
        score += gain(kind == "language", F.least(files, F.lit(float(MOST_FILES))) / 10)
    if "core" in asked:
        score += gain((kind == "package") & F.lower(F.trim("label")).rlike("(?:^|[_-])core(?:$|[_-])"), F.lit(float(CORE_PACKAGE)))
        score += gain((kind == "protocol") & says("mechanism", "core"), F.lit(float(CORE_PROTOCOL)))
    if "schema" in asked:
        proto = says("specification", "protobuf") | says("mechanism", "protobuf")
        score += gain((kind == "schema") | (kind.isin("api", "protocol") & proto), F.lit(float(SCHEMA)))
    return F.coalesce(score, zero)


def scoped(entities: DataFrame, relations: DataFrame, project: str) -> DataFrame:
    """Entities(.., project) of a project, and those of none that a relation joins to the project's own entity."""
    name = F.lit(project)
    root = F.broadcast(entities.where((F.col("kind") == "project") & ((F.col("project") == name) | (F.col("label") == name))).select(F.col("id").alias("_root")).distinct())  # the project's own entries
    shared = [relations.join(root, F.col(a) == F.col("_root"), "left_semi").select(F.col(b).alias("id")) for a, b in (("src", "dst"), ("dst", "src"))]
    own = entities.where(F.col("project") == name)
    return own.unionByName(entities.where("project is null").join(shared[0].union(shared[1]), "id", "left_semi"))


def question_terms(question: str, scope: str = "") -> list[str]:
    """The terms of a question, camel-case parts among them, without those of its scope and without
    stop words unless nothing else is left."""

    def split(text: str) -> list[str]:
        both = [text, re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)]
        return list(dict.fromkeys(t for x in both for t in re.split(r"[^a-z0-9]+", x.lower()) if len(t) > 1))

    own = [t for t in split(question) if t not in split(scope)]
    return [t for t in own if t not in STOP_WORDS] or own


def least_matches(terms: list[str], asked: int | None = None) -> int:
    usual = len(terms) if len(terms) <= 1 else min(3, -(-len(terms) // 3))
    return usual if asked is None else min(usual, max(1, asked))


def _spaced(x: Column) -> Column:
    """The ``tokens`` of a text as one text, a blank before and behind each."""
    marks = lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]+", " ")
    return F.concat(F.lit(" "), marks(x), F.lit(" "), marks(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")), F.lit(" "))


def _has(held: Column, term: str) -> Column:
    """Whether one of the spaced tokens is the term, or starts with one of three letters or more: a plain search."""
    return F.contains(held, F.lit(f" {term}" if len(term) >= 3 else f" {term} "))


def hits(entities: DataFrame, terms: list[str]) -> DataFrame:
    """Entities with their normal forms and ``hits``, an entry for each term that they match: whether it
    is the label, and whether label, identity and aliases have it."""
    norm = lambda x: F.lower(F.trim(x))
    hay = F.lower(F.concat_ws(" ", "kind", "label", "key", F.array_join("aliases", " ")))
    language = F.col("language") if "language" in entities.columns else F.lit(None).cast("string")
    own = entities.select(
        "id", "kind", "label", language.alias("language"), intent(entities, terms).alias("intent"), norm(F.col("label")).alias("l"), norm(F.col("key")).alias("i"), F.transform("aliases", norm).alias("a"), hay.alias("h"),
        _spaced(F.col("label")).alias("lt"), _spaced(F.col("key")).alias("it"), _spaced(F.array_join("aliases", " ")).alias("at"),
    )
    own = own.withColumn("ht", _spaced(F.col("h")))
    each = F.array(*(F.struct(F.lit(t).alias("term"), (F.col("l") == t).alias("same"), *(_has(F.col(c), t).alias(c) for c in ("lt", "it", "at", "ht"))) for t in terms))
    if not terms:
        each = each.cast("array<struct<term:string,same:boolean,lt:boolean,it:boolean,at:boolean,ht:boolean>>")
    return own.select("id", "kind", "label", "language", "intent", "l", "i", "a", "h", F.filter(each, lambda x: x["lt"] | x["it"] | x["at"] | x["ht"]).alias("hits"))


def matches(entities: DataFrame, question: str, languages: list[str] | None = None, asked: int | None = None, scope: str = "") -> DataFrame:
    """(id, kind, label, score, matched) of all entities that answer a question, in no order: enough of its terms, or
    a kind that it asks for if it is broad or short.  A question that says no more than its scope is answered by
    all entities of a kind that an overview has."""
    query, terms = question.strip().lower(), question_terms(question, scope)
    own = hits(entities, terms)
    weight = lambda t: F.log((F.count("*") + 1) / (F.count_if(F.array_contains("hits.term", t)) + 1)) + 1
    each = [F.array(*map(F.lit, terms)).cast("array<string>"), F.array(*map(weight, terms)).cast("array<double>")]
    weights = own.agg(F.map_from_arrays(*each).alias("weights"))
    both = own.join(F.broadcast(weights))  # one row, an entry for each term
    one = lambda c, x: F.when(c, float(x)).otherwise(0.0)

    def worth(x: Column) -> Column:
        label = F.when(x["same"], float(SAME_LABEL)).when(x["lt"], float(LABEL)).otherwise(0.0)
        return (label + one(x["it"], IDENTITY) + one(x["at"], ALIAS) + ANY) * F.element_at("weights", x["term"])

    score = one((F.col("l") == query) | (F.col("i") == query) | F.coalesce(F.array_contains("a", query), F.lit(False)), EXACT)
    score += one(F.col("l").startswith(query) | F.col("i").startswith(query), PREFIX) + one(F.col("h").contains(query), HAYSTACK)
    score += F.aggregate("hits", F.lit(0.0), lambda s, x: s + worth(x))
    if terms:
        score += F.size("hits") / len(terms) * ALL_TERMS
    if languages:
        known = F.lower(F.trim("language")).isin(languages)
        both = both.where(F.col("language").isNull() | known)
        score += one(F.coalesce(known, F.lit(False)), LANGUAGE)
    score += F.col("intent")
    if scope and not terms and question_terms(question):
        kinds = F.create_map(*(x for k, v in OVERVIEW.items() for x in (F.lit(k), F.lit(float(v)))))
        return own.select("id", "kind", "label", F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit(0.0)).alias("score"), F.lit(0).alias("matched")).where("score > 0")
    enough = F.size("hits") >= least_matches(terms, asked)
    if is_broad(terms) or len(terms) <= 2:
        enough = enough | (F.col("intent") > 0)
    both = both.where(enough)
    return both.select("id", "kind", "label", F.round(score, 6).alias("score"), F.size("hits").alias("matched")).where("score > 0")


def _best() -> list[Column]:
    """The order of an answer: names in locale order."""
    return [F.desc("score"), *(locale(c) for c in ("kind", "label", "id")), F.col("id")]


def placed(found: DataFrame, limit: int = 12) -> DataFrame:
    few = found.orderBy(*_best()).limit(max(1, min(100, limit)))
    return few.withColumn("place", F.row_number().over(Window.orderBy(*_best())))  # over the limit's rows


def ranked(entities: DataFrame, question: str, limit: int = 12, languages: list[str] | None = None, asked: int | None = None, scope: str = "") -> DataFrame:
    """(place, id, kind, label, score, matched) of the best of ``entities(id, kind, label, key, aliases
    [, language, file_count, mechanism, specification])``; with ``languages``, entities of others are left out and
    those of one gain."""
    return placed(matches(entities, question, languages, asked, scope), limit)


def answered(found: DataFrame, limit: int = 12, per_kind: int = 2) -> DataFrame:
    """(pick, place, ..) of the best of all matches, diversified as a broad question's are: what leads is chosen from all
    of them, not from the best alone.

    Of a kind, only the first entity of a label can lead, and only one of the first ``per_kind`` x kinds such: those
    before it lead, or their labels do elsewhere.  These and the best ``limit`` that may follow are folded."""
    limit = max(1, min(100, limit))
    kinds = found.agg(F.count_distinct("kind")).head()[0]
    row = F.struct("id", "label", "score", "matched")
    key = F.struct((-F.col("score")).alias("s"), locale("label").alias("l"), locale("id").alias("k"), F.col("id").alias("i"))
    first = found.withColumn("_l", F.lower(F.trim("label"))).groupBy("kind", "_l").agg(F.min_by(row, key).alias("r"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(*_best()))
    able = first.select("r.id", "kind", "r.label", "r.score", "r.matched").withColumn("nth", nth).where(F.col("nth") <= per_kind * max(1, kinds)).drop("nth")
    best = found.orderBy(*_best()).limit(limit + per_kind * max(1, kinds)).select(*able.columns)
    pool = able.union(best).distinct().withColumn("place", F.row_number().over(Window.orderBy(*_best())))  # kinds squared at most
    return diversified(pool, per_kind).where(F.col("pick") <= limit)


def diversified(few: DataFrame, per_kind: int = 2) -> DataFrame:
    """The places of a bounded result anew: in order of place, an entity leads if fewer than ``per_kind`` of its kind
    lead before it and none of its label does; the others follow.  What leads depends on what has led: a fold over
    the rows, a hundred at most."""
    rows = F.array_sort(F.collect_list(F.struct("place", "kind", F.lower(F.trim("label")).alias("label"))))
    empty = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("kinds"), F.array().cast("array<string>").alias("labels"))

    def step(led: Column, row: Column) -> Column:
        more = F.struct(F.concat(led.places, F.array(row.place)).alias("places"), F.concat(led.kinds, F.array(row.kind)).alias("kinds"), F.concat(led.labels, F.array(row.label)).alias("labels"))
        leads = (F.size(F.filter(led.kinds, lambda k: k == row.kind)) < per_kind) & ~F.array_contains(led.labels, row.label)
        return F.when(leads, more).otherwise(led)

    led = few.agg(F.aggregate(rows, empty, step).places.alias("_led"))
    both = few.join(F.broadcast(led))  # of one row
    return both.withColumn("pick", F.row_number().over(Window.orderBy(F.desc(F.array_contains("_led", F.col("place"))), "place"))).drop("_led")


def expanded(relations: DataFrame, few: DataFrame, each: int = 4, total: int = 24) -> DataFrame:
    """Relations(id, src, dst) of the selected entities: each belongs to its source if that is selected,
    else to its target, and an entity brings ``each`` of least id, all together ``total``."""
    chosen = F.broadcast(few.select(F.col("id").alias("_id")))
    ends = relations.join(chosen.withColumnRenamed("_id", "_s"), F.col("src") == F.col("_s"), "left").join(chosen.withColumnRenamed("_id", "_d"), F.col("dst") == F.col("_d"), "left")
    own = ends.withColumn("owner", F.coalesce("_s", "_d")).where("owner is not null").drop("_s", "_d")
    nth = F.row_number().over(Window.partitionBy("owner").orderBy("id"))
    return own.withColumn("nth", nth).where(F.col("nth") <= max(0, min(20, each))).orderBy("id").limit(total)


def budgeted(found: DataFrame, relations: DataFrame, entities: DataFrame, few: DataFrame, each: int = 4) -> DataFrame:
    """One row: how many entities match and whether any are left out, and what the budget of an answer keeps and omits of
    the relations of ``few``, of the entities at their other ends and of aliases."""
    ends = stored(expanded(relations, few, each, each * 100))
    kept = ends.orderBy("id").limit(BUDGET["relations"])
    chosen = few.select("id")
    other = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(F.broadcast(chosen), "id", "left_anti").join(entities.select("id"), "id", "left_semi")
    spare = entities.join(F.broadcast(chosen), "id", "left_semi").agg(F.coalesce(F.sum(F.greatest(F.size("aliases") - BUDGET["aliases"], F.lit(0))), F.lit(0)).alias("omitted_aliases"))
    total = found.agg(F.count("*").alias("total_matches"))
    count = lambda d, name: d.agg(F.count("*").alias(name))
    one = total.join(count(few, "entities")).join(count(ends, "_relations")).join(count(other, "_related")).join(spare)  # of one row each
    least = lambda c, n: F.least(F.col(c), F.lit(BUDGET[n]).cast("long"))
    one = one.select(
        "total_matches", "entities", least("_relations", "relations").alias("relations"), (F.col("_relations") - least("_relations", "relations")).alias("omitted_relations"),
        least("_related", "related").alias("related"), (F.col("_related") - least("_related", "related")).alias("omitted_related"), "omitted_aliases",
    )
    return one.withColumn("truncated", (F.col("total_matches") > F.col("entities")) | (F.col("omitted_relations") + F.col("omitted_related") + F.col("omitted_aliases") > 0))
