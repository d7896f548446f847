"""Models kept up to date: what has not changed is not built again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(sources: DataFrame, project: str = "project") -> DataFrame:
    """(project, digest): the number of a project's rows and the sum of their hashes, in no order."""
    others = [c for c in sources.columns if c != project]
    h = F.xxhash64(*others).cast("decimal(38,0)")
    return sources.groupBy(F.col(project).alias("project")).agg(F.concat_ws("-", F.count("*").cast("string"), F.sum(h).cast("string")).alias("digest"))


class Incremental:
    """A table of rows by project in ``folder`` of the shared file system, in versions.

    Version n has the rows built for it (rows/version=n) and a list of all projects with their digests and the
    version that their rows are of (projects/version=n), which is written last: a version without it does not
    exist.  Nothing is overwritten, so a reader of an earlier version is not disturbed, and a build that is lost
    on the way leaves only rows that no list names.
    """

    def __init__(self, spark: SparkSession, folder: str, build: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.build = spark, folder.rstrip("/"), build
        self.version = 0

    def _projects(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/projects/version={version}")

    def refresh(self, sources: DataFrame) -> str:
        """Bring the table up to ``sources(project, ..)``: ``unchanged`` (nothing is written), ``incremental`` (rows of changed
        projects are built) or ``full``, at first and when projects have come or gone.  ``build`` makes
        rows (project, ..) of a project from that project's sources alone."""
        now = digests(sources)
        decision, own, held = "full", sources, now.withColumn("of", F.lit(self.version + 1))
        if self.version:
            before = self._projects(self.version)
            both = now.join(before.select("project", F.col("digest").alias("old"), "of"), "project", "full_outer")
            both.write.mode("overwrite").parquet(f"{self.folder}/compared/version={self.version + 1}")
            both = self.spark.read.parquet(f"{self.folder}/compared/version={self.version + 1}")
            changed = F.col("digest").isNotNull() & F.col("old").isNotNull() & (F.col("digest") != F.col("old"))
            sums = both.agg(F.count_if(F.col("old").isNull() | F.col("digest").isNull()).alias("set"), F.count_if(changed).alias("changed")).head()
            if not sums["set"]:
                if not sums["changed"]:
                    return "unchanged"
                decision = "incremental"
                own = sources.join(both.where(changed).select("project"), "project", "left_semi")
                held = both.select("project", "digest", F.when(changed, self.version + 1).otherwise(F.col("of")).alias("of"))
        n = self.version + 1
        self.build(own).write.mode("overwrite").parquet(f"{self.folder}/rows/version={n}")
        held.write.mode("overwrite").parquet(f"{self.folder}/projects/version={n}")
        self.version = n
        return decision

    def rows(self) -> DataFrame:
        """All rows of the present version, with ``of``, the version they were built for; versions that no project's
        rows are of are not read."""
        projects = self._projects(self.version)
        used = sorted(r["of"] for r in projects.select("of").distinct().collect())  # versions, a few
        each = [self.spark.read.parquet(f"{self.folder}/rows/version={v}").withColumn("of", F.lit(v)) for v in used]
        return reduce(DataFrame.unionByName, each).join(projects.select("project", "of"), ["project", "of"], "left_semi")
