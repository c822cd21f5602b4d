"""Topology and edits of a graph at rest: one row per (src, dst) with eight weight slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.slots import scaled, slot_array
from ..schema import WEIGHTS
from ..store import Scratch, saved
from .order import first_rows

#: A buffer's halves hold 0.4 of the weight, and removing it gives 2.5 of a half.
BUFFER_TENTHS, RESTORE_TENTHS = 4, 25
PEELED = 6  # tables of vertices that a round of peel reads at once


class CycleError(ValueError):
    """The graph is not acyclic."""


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()


def arcs(edges: DataFrame) -> DataFrame:
    """(src, dst, slot, w): each weight that is not null is an arc of its own."""
    return edges.select("src", "dst", F.posexplode(slot_array()).alias("slot", "w")).where("w is not null")


def degrees(edges: DataFrame) -> DataFrame:
    """(name, fanins, fanouts) over edges, whatever their weights."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.name").agg(F.sum("e.i").alias("fanins"), F.sum("e.o").alias("fanouts"))


def sources(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("fanins = 0").select("name")


def sinks(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("fanouts = 0").select("name")


def chain_edges(edges: DataFrame) -> DataFrame:
    """Edges whose start has no other way out and whose end no other way in."""
    out = edges.groupBy("src").agg(F.count("*").alias("n"), F.max("dst").alias("dst")).where("n = 1").select("src", "dst")
    into = edges.groupBy("dst").agg(F.count("*").alias("n")).where("n = 1").select("dst")
    return edges.join(out, ["src", "dst"], "left_semi").join(into, "dst", "left_semi").select("src", "dst", *WEIGHTS)


def upsert(rows: DataFrame, *order: str) -> DataFrame:
    """The last row of each (src, dst) in this order; all eight weights are replaced."""
    body = F.max(F.struct(*order, *WEIGHTS)).alias("last")  # a maximum combines before the shuffle
    return rows.groupBy("src", "dst").agg(body).select("src", "dst", *[F.col(f"last.{w}").alias(w) for w in WEIGHTS])


def fold(ops: DataFrame) -> DataFrame:
    """The edges after insert_edge, remove_edge and remove_vertex rows, by their sequence.

    An edge lives if its last insertion is later than the last removal of itself and of either
    end.  Vertices that lose their edges are kept by ``fold_vertices``."""
    edge = ops.where("op in ('insert_edge', 'remove_edge')")
    put = F.col("op") == "insert_edge"
    last = edge.groupBy("src", "dst").agg(F.max(F.when(put, F.struct("seq", *WEIGHTS))).alias("last"), F.max(F.when(~put, F.col("seq"))).alias("cut_at"))
    out = last.where("last is not null and (cut_at is null or last.seq > cut_at)").select("src", "dst", F.col("last.seq").alias("put_at"), *[F.col(f"last.{w}").alias(w) for w in WEIGHTS])
    gone = _removals(ops)
    for end in ("src", "dst"):
        out = out.join(gone.select(F.col("name").alias(end), F.col("gone_at").alias(f"{end}_at")), end, "left")
    later = F.greatest("src_at", "dst_at")  # null if neither was ever removed
    return out.where(later.isNull() | (F.col("put_at") > later)).select("src", "dst", *WEIGHTS)


def _removals(ops: DataFrame) -> DataFrame:
    return ops.where("op = 'remove_vertex'").groupBy("name").agg(F.max("seq").alias("gone_at"))


def fold_vertices(ops: DataFrame) -> DataFrame:
    """(name): the vertices that insert_vertex and insert_edge rows name and that no later
    remove_vertex takes away, with edges or without."""
    edge = F.array(F.col("src"), F.col("dst"))
    named = ops.where("op in ('insert_vertex', 'insert_edge')").select("seq", F.explode(F.when(F.col("op") == "insert_edge", edge).otherwise(F.array("name"))).alias("name"))
    seen = named.groupBy("name").agg(F.max("seq").alias("at"))
    return seen.join(_removals(ops), "name", "left").where("gone_at is null or at > gone_at").select("name")


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def remove_vertices(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Without the named vertices and all edges at them."""
    names = names.select("name").distinct()
    return edges.join(names, edges["src"] == names["name"], "left_anti").join(names, F.col("dst") == names["name"], "left_anti")


def insert_buffers(edges: DataFrame, buffers: DataFrame) -> DataFrame:
    """Split the edges (src, dst) of ``buffers`` at a new vertex ``name``: each half has 0.4 of
    every weight.  Buffers whose edge is missing do nothing."""
    split = edges.join(buffers.select("src", "dst", "name"), ["src", "dst"])
    half = [scaled(BUFFER_TENTHS, w).alias(w) for w in WEIGHTS]
    whole = edges.join(buffers.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", *WEIGHTS)
    return whole.unionByName(split.select("src", F.col("name").alias("dst"), *half)).unionByName(split.select(F.col("name").alias("src"), "dst", *half))


def remove_buffers(edges: DataFrame, buffers: DataFrame) -> DataFrame:
    """Restore the edge that each buffer (src, dst, name) split, with 2.5 of the weights of its
    first half; edits of the second half are lost, nulls stay null."""
    halves = edges.join(buffers.select(F.col("src").alias("b_src"), F.col("dst").alias("b_dst"), "name"), (F.col("src") == F.col("b_src")) & (F.col("dst") == F.col("name")))
    whole = halves.select("src", F.col("b_dst").alias("dst"), *[scaled(RESTORE_TENTHS, w).alias(w) for w in WEIGHTS])
    return remove_vertices(edges, buffers).select("src", "dst", *WEIGHTS).unionByName(whole)


def modify_vertex(edges: DataFrame, at: Column, offset: int) -> DataFrame:
    """Add ``offset`` to every weight of the edges where ``at`` holds (of src or dst)."""
    return edges.select("src", "dst", *[F.when(at, F.col(w) + offset).otherwise(F.col(w)).alias(w) for w in WEIGHTS])


def first_percent(edges: DataFrame, percent: float, scratch: Scratch) -> DataFrame:
    """(src, dst) of the first floor(n x percent / 100) edges by (src, dst)."""
    keys = edges.select("src", "dst")
    return first_rows(keys, int(keys.count() * percent // 100), ["src", "dst"], scratch)


def update_percent(edges: DataFrame, percent: float, offset: int, scratch: Scratch | None = None) -> DataFrame:
    """Add ``offset`` to every weight of the first floor(n x percent / 100) edges by (src, dst).

    The boundary edge is found among few rows of a distributed order, and compared with."""
    scratch = scratch or Scratch(edges.sparkSession)
    edges = saved(edges.select("src", "dst", *WEIGHTS), scratch)
    key = F.struct("src", "dst")
    last = first_percent(edges, percent, scratch).agg(F.max(key).alias("m")).first()["m"]
    if last is None:
        return edges
    first = key <= F.struct(F.lit(last["src"]).alias("src"), F.lit(last["dst"]).alias("dst"))
    return modify_vertex(edges, first, offset)


def counts(edges: DataFrame) -> DataFrame:
    """(num_verts, num_edges, num_arcs) in one pass over the edges."""
    n = sum(F.col(w).isNotNull().cast("long") for w in WEIGHTS)
    return edges.agg(F.count("*").alias("num_edges"), F.coalesce(F.sum(n), F.lit(0)).alias("num_arcs")).crossJoin(F.broadcast(vertices_of(edges).agg(F.count("*").alias("num_verts")))).select("num_verts", "num_edges", "num_arcs")


def peel(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges that remain when sinks are taken away again and again with the edges into them: those
    on cycles and those that lead to one.  An edge whose end is null leads nowhere.  A round writes
    the vertices that it takes away."""
    edges = scratch.save(edges.select("src", "dst").where("dst is not null").distinct())
    front, new = scratch.counted(edges.select(F.col("dst").alias("v")).distinct().join(edges.select(F.col("src").alias("v")), "v", "left_anti"))
    gone = [front]
    while new:
        near = edges.join(gone[-1].withColumnRenamed("v", "dst"), "dst", "left_semi").select("src").distinct()
        ways = edges.join(near, "src", "left_semi")
        for table in gone:
            ways = ways.join(table.withColumnRenamed("v", "dst"), "dst", "left_anti")
        front, new = scratch.counted(near.join(ways.select("src"), "src", "left_anti").select(F.col("src").alias("v")))
        gone = [*gone, front] if len(gone) < PEELED else [scratch.save(reduce(DataFrame.unionByName, gone)), front]
    return edges.join(reduce(DataFrame.unionByName, gone).withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst")


def check_acyclic(edges: DataFrame) -> None:
    left = peel(edges, Scratch(edges.sparkSession)).take(1)
    if left:
        raise CycleError(f"a cycle is reached from {left[0]['src']!r}")


def running_sum(points: DataFrame, by: str, order: list[str], weight: str) -> Column:
    return F.sum(weight).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
