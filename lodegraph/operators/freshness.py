"""Hashes of a node's state with that of all it depends on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .graph import traverse

#: A hash counts as two whole numbers of 60 bits in sums over what a node depends on.
LIMB = 15


def ordered(x: Column, kind: DataType) -> Column:
    """A struct, or an array of structs, with the fields of all levels in the order of their names."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        inner = F.struct(*(ordered(x.getField(f.name), f.dataType).alias(f.name) for f in fields))
        return F.when(x.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda y: ordered(y, kind.elementType))
    return x


def canonical_json(df: DataFrame, name: str) -> Column:
    """The struct column ``name`` as JSON with keys in order at all levels and without nulls."""
    return F.to_json(ordered(F.col(name), df.schema[name].dataType))


def inputs_hash(df: DataFrame, name: str) -> Column:
    return F.sha2(canonical_json(df, name), 256)


def limb(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 1 + LIMB * k, LIMB), 16, 10).cast("decimal(38,0)")


def transitive_hashes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, own_hash, dependencies, transitive_hash) of ``nodes(node, own_hash)``: the last changes if the own
    hash of the node or of any that it reaches does, or if what it reaches changes.

    It is made of the node's own hash, the number of nodes it reaches and sums of the hashes of (node,
    own hash) of those, in two limbs: a set of any size is a combined aggregate, in no order.  Cycles
    are no matter.  A node that is only an end of an edge counts with the hash ``<unknown>``.
    """
    walked = traverse(edges, nodes.select(F.col("node").alias("origin")), paths=False).where("distance > 0").select("origin", "node")
    own = nodes.select("node", "own_hash")
    known = F.sha2(F.concat(F.col("node").cast("string"), F.lit(":"), F.coalesce("own_hash", F.lit("<unknown>"))), 256)
    each = walked.join(own, "node", "left").select("origin", known.alias("h"))
    sums = each.groupBy(F.col("origin").alias("node")).agg(F.count("*").alias("dependencies"), F.sum(limb(F.col("h"), 0)).alias("x"), F.sum(limb(F.col("h"), 1)).alias("y"))
    both = own.join(sums, "node", "left").na.fill(0, ["dependencies"])
    text = [F.coalesce("own_hash", F.lit("<unknown>")), *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("dependencies", "x", "y"))]
    return both.select("node", "own_hash", "dependencies", F.sha2(F.concat_ws("|", *text), 256).alias("transitive_hash"))
