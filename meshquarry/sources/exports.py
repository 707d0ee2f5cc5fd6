"""Graphs as text for other tools. Lines carry their order, so that files are written by many tasks and read in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquarry.operators import relational


def _escaped(text: Column) -> Column:
    out = text.cast("string")
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, line) of a directed graph of nodes (id) and edges (id, pre, post, n), in order of part, then key: the head, the
    nodes, the edges with their counts, the end."""
    fixed = edges.sparkSession.createDataFrame(
        [(0, "", '<?xml version="1.0" encoding="UTF-8"?>'), (1, "", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="n" for="edge" attr.name="n" attr.type="long"/><graph edgedefault="directed">'), (4, "", "</graph></graphml>")],
        "part int, key string, line string",
    )
    q = lambda c: _escaped(F.col(c))
    points = nodes.select(F.lit(2).alias("part"), F.col("id").cast("string").alias("key"), F.concat(F.lit('<node id="'), q("id"), F.lit('"/>')).alias("line"))
    lines = F.concat(F.lit('<edge id="'), q("id"), F.lit('" source="'), q("pre"), F.lit('" target="'), q("post"), F.lit('"><data key="n">'), F.col("n").cast("string"), F.lit("</data></edge>"))
    return fixed.unionByName(points).unionByName(edges.select(F.lit(3).alias("part"), F.col("id").cast("string").alias("key"), lines.alias("line")))


def adjacency(edges: DataFrame) -> DataFrame:
    """(part, key, line) of the matrix of counts of edges (pre, post, n) as CSV: a head, then a line `pre,post,n` a cell that holds
    something, parallel edges added up. There is no line for an empty cell, and no row of a matrix in one piece. Edges are dealt out by
    cells, as they are, so that a task adds up a bounded number of them."""
    head = edges.sparkSession.createDataFrame([(0, "", "pre,post,n")], "part int, key string, line string")
    cells = relational.dealt(edges.dropna(subset=["pre", "post"]).select("pre", "post", "n"), "pre", "post").groupBy("pre", "post").agg(F.sum("n").alias("n"))
    key = F.concat_ws(",", *(F.col(c).cast("string") for c in ("pre", "post")))
    return head.unionByName(cells.select(F.lit(1).alias("part"), key.alias("key"), F.concat_ws(",", key, F.col("n").cast("string")).alias("line")))


def write_lines(lines: DataFrame, path: str, partitions: int = 32) -> None:
    """The lines as text files whose names are in order; `cat` of them is the document. Refuses to write over anything."""
    lines.repartitionByRange(partitions, "part", "key").sortWithinPartitions("part", "key").select("line").write.mode("errorifexists").text(path)
