"""Graphs and paths as text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slots import edge_name, label
from ..operators.graph import degrees
from ..schema import WEIGHTS


def edge_dump(edges: DataFrame) -> DataFrame:
    """(name, weights) with n/a for nulls."""
    return edges.select(edge_name().alias("name"), F.concat_ws(" ", *[F.coalesce(F.col(w).cast("string"), F.lit("n/a")) for w in WEIGHTS]).alias("weights"))


def vertex_dump(edges: DataFrame) -> DataFrame:
    """(name, fanins, fanouts)."""
    return degrees(edges)


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line): Graphviz edges, labelled with the first weight that is not null."""
    return edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', F.col("src"), F.col("dst"), label()).alias("line"))


def path_rows(paths: DataFrame) -> DataFrame:
    """(rank, pos, vert, dist): one row per point of each path."""
    return paths.select("rank", F.explode("points").alias("p")).select("rank", "p.pos", "p.vert", "p.dist")


def path_dump(paths: DataFrame) -> DataFrame:
    """(rank, text): a header with start and end, then a row per point; none for no points."""
    row = F.transform("points", lambda p: F.format_string("%s %d", p["vert"], p["dist"]))
    text = F.concat_ws("\n", F.format_string("Startpoint: %s", F.col("startpoint")), F.format_string("Endpoint: %s", F.col("endpoint")), F.array_join(row, "\n"))
    return paths.select("rank", F.when(F.size("points") > 0, text).otherwise("empty path").alias("text"))


def heap_dump(paths: DataFrame) -> DataFrame:
    """(rank, text): rank 0 says how many paths there are; the others are those of path_dump."""
    head = paths.agg(F.count("*").alias("n")).select(F.lit(0).cast("long").alias("rank"), F.format_string("# Paths: %d", F.col("n")).alias("text"))
    return head.unionByName(path_dump(paths))


def frontier_dump(nodes: DataFrame) -> DataFrame:
    """(node_id, name): the arc of each kept deviation that was not expanded."""
    return nodes.where("status = 'open' and src is not null").select("node_id", edge_name().alias("name"))


def root_children_dump(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): the edges by which the children of the shortest paths leave them, as edits."""
    first = nodes.where("level = 1").select("src", "dst").distinct()
    weights = [F.coalesce(F.col(w).cast("string"), F.lit("n/a")) for w in WEIGHTS]
    return edges.join(first, ["src", "dst"]).select(F.concat_ws(" ", F.lit("insert_edge"), "src", "dst", *weights).alias("line"))


def run_statistics(runs: DataFrame, by: str, value: str) -> DataFrame:
    """(by, runs, least, greatest, mean) of a measured value over repeated runs."""
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"))
