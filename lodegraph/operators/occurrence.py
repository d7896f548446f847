"""Which patterns occur in which texts: many of both, met by equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settle

#: Characters of the piece by which a pattern is looked up.
GRAM = 4


def _pieces(x: Column, size: Column | int) -> Column:
    """The distinct pieces of ``size`` characters of a text."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.length(x) >= size, F.sequence(F.lit(1), F.length(x) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(x, i, size)))


def occurrences(texts: DataFrame, patterns: DataFrame, by: Sequence[str] = (), gram: int = GRAM) -> DataFrame:
    """(.., text_id, pattern_id): the rows of ``texts(.., text_id, text)`` that contain the pattern of a row of
    ``patterns(.., pattern_id, pattern)``, once for each pair; with ``by``, of the same values there only.

    Each pattern is looked up by one of its pieces of ``gram`` characters, the one that the fewest texts
    have; a pattern that is shorter is a piece itself.  Texts are taken apart into their distinct pieces,
    pieces meet by equality, and what meets is verified: no text is held against a pattern it shares
    nothing with.  A null or empty pattern occurs nowhere, nor does anything in a null text.
    """
    by = list(by)
    own = settle(patterns.select(*by, "pattern_id", "pattern").where("pattern <> ''").withColumn("size", F.least(F.lit(gram), F.length("pattern"))))
    sizes = [r["size"] for r in own.select("size").distinct().collect()]  # ``gram`` at most
    if not sizes:
        return texts.join(patterns.select(*by, "pattern_id").limit(0), by or F.lit(False)).select(*by, "text_id", "pattern_id")
    pieces = F.flatten(F.array(*(_pieces(F.col("text"), k) for k in sizes)))
    taken = texts.where("text is not null").select(*by, "text_id", "text", F.explode(pieces).alias("piece"))
    wanted = own.select(*by, "pattern_id", "pattern", F.explode(_pieces(F.col("pattern"), F.col("size"))).alias("piece"))
    # pieces of no pattern go before anything is counted or joined
    met = taken.join(wanted.select(*by, "piece").distinct(), [*by, "piece"], "left_semi")
    held = met.groupBy(*by, "piece").agg(F.count("*").alias("texts"))
    rarest = wanted.join(held, [*by, "piece"], "left").groupBy(*by, "pattern_id", "pattern").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "piece")).alias("r"))
    asked = rarest.where("r.texts > 0").select(*by, "pattern_id", "pattern", F.col("r.piece").alias("piece"))
    return met.join(asked, [*by, "piece"]).where(F.contains("text", F.col("pattern"))).select(*by, "text_id", "pattern_id").distinct()
