"""Files as tables: listings, project roots, archive manifests, coverage reports, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that a listing skips, and files that mark a project.
IGNORED = [".git", "node_modules", "dist", "build", "target", "venv", ".venv", "__pycache__", "coverage"]
MARKERS = ["package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml"]


def list_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, length[, content]): all files under ``root`` by relative path, ignored folders left out.
    Contents are read only where asked for.  Spark's reader gives no row for an empty file: none is listed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    rel = F.element_at(F.split("path", "\\Q" + base + "\\E", 2), -1)
    own = found.select(rel.alias("path"), "length", *(["content"] if content else []))
    return own.where(~F.exists(F.split("path", "/"), lambda p: p.isin(IGNORED)))


def texts(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of files with contents; bytes that are no UTF-8 become the mark for them."""
    lines = F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n"), "\n")
    return files.select("path", F.posexplode(lines).alias("line_no", "line"))


def project_roots(files: DataFrame, depth: int = 4) -> DataFrame:
    """Folders with a marker file at most ``depth`` folders down, outermost ones only."""
    parts = F.split("path", "/")
    own = files.select(parts.alias("p")).where(F.element_at("p", -1).isin(MARKERS) & (F.size("p") <= depth + 1))
    own = own.select(F.slice("p", 1, F.size("p") - 1).alias("p")).distinct()
    # a folder's ancestors are few and follow from its own name: an equi-join
    above = own.select("p", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda n: F.slice("p", 1, n))).alias("a")).where(F.size("p") > 0)
    inner = above.join(own.select(F.col("p").alias("a")), "a", "left_semi").select("p").distinct()
    return own.join(inner, "p", "left_anti").select(F.array_join("p", "/").alias("root"))


def manifest(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files with contents."""
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify(listed: DataFrame, present: DataFrame) -> DataFrame:
    """(path, problem): missing, extra or mismatched files of two manifests."""
    a = listed.select("path", F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    both = a.join(present.select("path", "size", "sha256"), "path", "full_outer")
    same = F.col("_s").eqNullSafe(F.col("size")) & F.col("_h").eqNullSafe(F.col("sha256"))
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("_h").isNull(), "extra").when(~same, "mismatched")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def lcov(lines: DataFrame) -> DataFrame:
    """(report, file, lines, covered) of LCOV reports given as (path, line_no, line): DA records of
    each SF section; a line counts once, covered if any record of it is."""
    order = Window.partitionBy("path").orderBy("line_no")
    file = F.last(F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 1 << 20)), ignorenulls=True).over(order)
    own = lines.where(F.col("line").rlike("^(SF|DA):")).withColumn("file", file).where(F.col("line").startswith("DA:"))
    da = F.split(F.substring("line", 4, 1 << 20), ",")
    hit = own.select(F.col("path").alias("report"), "file", da[0].try_cast("long").alias("n"), da[1].try_cast("long").alias("hits")).where("n is not null")
    each = hit.groupBy("report", "file", "n").agg(F.max("hits").alias("hits"))
    return each.groupBy("report", "file").agg(F.count("*").alias("lines"), F.count_if(F.col("hits") > 0).alias("covered"))


def go_profile(lines: DataFrame) -> DataFrame:
    """(report, file, statements, covered) of Go cover profiles; a block counts once."""
    shape = r"^(.+):(\d+\.\d+,\d+\.\d+) (\d+) (\d+)$"
    part = [F.regexp_extract("line", shape, k) for k in (1, 2, 3, 4)]
    own = lines.where(F.col("line").rlike(shape)).select(F.col("path").alias("report"), part[0].alias("file"), part[1].alias("block"), part[2].cast("long").alias("k"), part[3].cast("long").alias("hits"))
    each = own.groupBy("report", "file", "block").agg(F.max("k").alias("k"), F.max("hits").alias("hits"))
    return each.groupBy("report", "file").agg(F.sum("k").alias("statements"), F.sum(F.when(F.col("hits") > 0, F.col("k")).otherwise(0)).alias("covered"))


def titles(lines: DataFrame) -> DataFrame:
    """(path, title): the first heading of the first level of each document."""
    own = lines.where(F.col("line").rlike(r"^# \s*\S")).groupBy("path").agg(F.min_by("line", "line_no").alias("line"))
    return own.select("path", F.trim(F.substring("line", 3, 1 << 20)).alias("title"))


def inventory(files: DataFrame) -> DataFrame:
    """(project, extension, role, files, representative): counts by the first folder and the role that
    a path tells."""
    path = F.lower("path")
    role = F.when(path.rlike(r"(^|/)(tests?|__tests__|spec)/|[._](test|spec)\.[a-z]+$"), "test").when(path.rlike("(^|/)examples?/"), "example").when(path.rlike(r"(^|/)generated/|\.pb\.|_pb2\."), "generated").otherwise("production")
    project = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("")
    own = files.select("path", project.alias("project"), F.regexp_extract(path, r"\.([a-z0-9]+)$", 1).alias("extension"), role.alias("role")).where("extension <> ''")
    return own.groupBy("project", "extension", "role").agg(F.count("*").alias("files"), F.min("path").alias("representative"))
