"""Graphs as lines of text: DOT, Mermaid, GraphML, JSON lines.

Each renderer gives (part, a, b, line); in the order of part, a and b the lines are the file.
``write`` sorts by ranges, so that no task holds a whole graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import node_id, xml_escape

#: Line styles by kind of edge, weights by confidence.
STYLES = {"event-pub-sub": "dashed", "service-dependsOn": "bold", "shared-resource": "dotted"}
WEIGHTS = {"high": 1.0, "medium": 0.66, "low": 0.33}


def _lines(nodes: DataFrame, edges: DataFrame, head: list[str], node: Column, edge: Column, tail: list[str]) -> DataFrame:
    """``nodes(id)`` and ``edges(src, dst, kind)`` as lines between a head and a tail."""
    none = F.lit("")

    def fixed(part: int, lines: list[str]) -> DataFrame:
        rows = [(part, f"{i:03d}", "", x) for i, x in enumerate(lines)]
        return nodes.sparkSession.createDataFrame(rows, "part int, a string, b string, line string")

    own = nodes.select(F.lit(1).alias("part"), F.col("id").alias("a"), none.alias("b"), node.alias("line"))
    links = edges.select(F.lit(2).alias("part"), F.col("src").alias("a"), F.concat_ws("\0", "dst", "kind").alias("b"), edge.alias("line"))
    return fixed(0, head).unionByName(own).unionByName(links).unionByName(fixed(3, tail))


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def quoted(x: str) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(F.col(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    style = F.lit("solid")
    for kind, own in STYLES.items():
        style = F.when(F.col("kind") == kind, own).otherwise(style)
    edge = F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(' [label="'), "kind", F.lit('", style='), style, F.lit("];"))
    return _lines(nodes, edges, ["digraph workspace {", "  rankdir=LR;", "  node [shape=box];"], F.concat(F.lit("  "), quoted("id"), F.lit(";")), edge, ["}"])


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def name(x: str) -> Column:
        own = node_id(F.col(x))
        return F.when(own.rlike("^[A-Za-z_]"), own).otherwise(F.concat(F.lit("n_"), own))

    node = F.concat(F.lit("  "), name("id"), F.lit('["'), "id", F.lit('"]'))
    return _lines(nodes, edges, ["flowchart LR"], node, F.concat(F.lit("  "), name("src"), F.lit(" -->|"), "kind", F.lit("| "), name("dst")), [])


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges carry their kind as data ``kind``."""
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '  <key id="kind" for="edge" attr.name="kind" attr.type="string"/>', '  <graph edgedefault="directed">']
    e = lambda x: xml_escape(F.col(x))
    node = F.concat(F.lit('    <node id="'), e("id"), F.lit('"/>'))
    edge = F.concat(F.lit('    <edge source="'), e("src"), F.lit('" target="'), e("dst"), F.lit('"><data key="kind">'), e("kind"), F.lit("</data></edge>"))
    return _lines(nodes, edges, head, node, edge, ["  </graph>", "</graphml>"])


def weight(confidence: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, own in WEIGHTS.items():
        out = F.when(confidence == name, own).otherwise(out)
    return out


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON object a line with ``@id`` and, for edges, both ends."""
    node = F.to_json(F.struct(F.col("id").alias("@id"), F.lit("entity").alias("@type")))
    edge = F.to_json(F.struct(F.lit("relation").alias("@type"), "kind", F.col("src").alias("from"), F.col("dst").alias("to")))
    return _lines(nodes, edges, [], node, edge, [])


def write(lines: DataFrame, path: str) -> None:
    """Text files whose lines, file after file, are in order."""
    lines.orderBy("part", "a", "b").select("line").write.mode("overwrite").text(path)
