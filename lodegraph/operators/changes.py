"""Differences between versions: keyed compare, risk, freshness, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_diff(base: DataFrame, head: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, changed): rows that are added, removed or updated, and which fields differ."""
    b = base.select(F.col(key), F.lit(True).alias("_b"), *(F.col(f).alias(f"_b_{f}") for f in fields))
    h = head.select(F.col(key), F.lit(True).alias("_h"), *(F.col(f).alias(f"_h_{f}") for f in fields))
    names = F.array_compact(F.array(*(F.when(~F.col(f"_b_{f}").eqNullSafe(F.col(f"_h_{f}")), F.lit(f)) for f in fields)))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").when(F.size(names) > 0, "updated")
    both = b.join(h, key, "full_outer").withColumn("change", kind)
    changed = F.when(F.col("change") == "updated", F.array_join(names, ",")).otherwise("")
    return both.where("change is not null").select(key, "change", changed.alias("changed"))


def overlay_risk(destructive: Column, impacted: Column, total: Column) -> Column:
    return F.when(total == 0, "none").when((destructive > 0) | (impacted >= 10), "high").when((impacted >= 5) | (total >= 5), "medium").otherwise("low")


def freshness(current: DataFrame, recorded: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, verdict): added, removed, changed or fresh by digest."""
    a = current.select(key, F.col(digest).alias("_now"))
    b = recorded.select(key, F.col(digest).alias("_then"))
    verdict = F.when(F.col("_then").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_now") != F.col("_then"), "changed").otherwise("fresh")
    return a.join(b, key, "full_outer").select(key, verdict.alias("verdict"))


def expired(generated: Column, ttl_seconds: Column, now: Column) -> Column:
    """fresh, stale, or unknown for a fact without a valid time."""
    return F.when(generated.isNull() | ttl_seconds.isNull(), "unknown").when(now.cast("timestamp").cast("double") > generated.cast("timestamp").cast("double") + ttl_seconds, "stale").otherwise("fresh")


def drift(current: DataFrame, previous: DataFrame, key: str, count: str) -> DataFrame:
    """(key, new, resolved, net) issues of each project in either report."""
    a, b = current.select(key, F.col(count).alias("_now")), previous.select(key, F.col(count).alias("_then"))
    now, then = F.coalesce("_now", F.lit(0)), F.coalesce("_then", F.lit(0))
    return a.join(b, key, "full_outer").select(key, F.greatest(now - then, F.lit(0)).alias("new"), F.greatest(then - now, F.lit(0)).alias("resolved"), (now - then).alias("net"))
