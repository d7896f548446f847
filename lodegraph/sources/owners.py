"""Ownership rules: which owners a path has by the rules of a CODEOWNERS file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACES = r"\s+"


def rules(lines: DataFrame) -> DataFrame:
    """(path, line_no, pattern, owner, prefix) of the lines (path, line_no, line) of rule files: one row for each
    owner that begins with @.  The prefix is the pattern without its first slash, up to its first star, without
    a slash at its end."""
    text = F.btrim(F.col("line"), F.lit(" \t\r\n"))
    own = lines.select("path", "line_no", F.split(text, SPACES).alias("p")).where((F.element_at("p", 1) != "") & ~F.element_at("p", 1).startswith("#"))
    own = own.select("path", "line_no", F.element_at("p", 1).alias("pattern"), F.explode(F.filter(F.slice("p", 2, 1 << 20), lambda x: x.startswith("@"))).alias("owner"))
    stem = F.regexp_replace(F.regexp_replace("pattern", "^/", ""), r"\*.*$", "")
    return own.withColumn("prefix", F.regexp_replace(stem, "/$", "")).withColumn("empty", stem == "").distinct()


def owned(found: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, line_no, pattern, owner, project): the projects (project, root) whose root begins with the rule's
    prefix; a root ``.`` is of every rule whose pattern is more than stars.  Roots are taken apart into their
    beginnings, which meet prefixes by equality.  A rule that no project meets has a row with a null project:
    the owner of what the file itself belongs to."""
    starts = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.length("root"), F.lit(1))), lambda k: F.substr("root", F.lit(1), k))))
    begun = projects.where("root <> '.'").select("project", F.explode(starts).alias("prefix"))
    asked = found.where("not empty")
    met = asked.join(begun, "prefix").select("path", "line_no", "pattern", "owner", "project")
    tops = F.broadcast(projects.where("root = '.'").agg(F.collect_set("project").alias("tops")))  # at most the roots of repositories
    top = asked.join(tops).select("path", "line_no", "pattern", "owner", F.explode("tops").alias("project"))
    both = met.unionByName(top).distinct()
    alone = found.select("path", "line_no", "pattern", "owner").distinct().join(both, ["path", "line_no", "owner"], "left_anti")
    return both.unionByName(alone.withColumn("project", F.lit(None).cast(dict(projects.dtypes)["project"])))


def last_rule(met: DataFrame) -> DataFrame:
    """Of the rules of each project only those of the last line that it meets, as hosts of repositories apply them."""
    last = F.max("line_no").over(Window.partitionBy("path", "project"))
    return met.where("project is not null").withColumn("last", last).where("line_no = last").drop("last")
