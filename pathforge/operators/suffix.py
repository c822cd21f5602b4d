"""Shortest distances on a DAG and their repair after edits.

The fixpoint relaxes only what changed in the round before, and a round writes only what it
changed.  Weights may be negative; on a DAG it ends after as many rounds as the longest path
has edges.  A graph that is still not done after ``DEEP`` rounds is checked for cycles and its
vertices with one way out are jumped over by pointer doubling, so long chains cost the
logarithm of their length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slots import min_slot, min_weight
from ..store import Scratch, saved
from .graph import CycleError, degrees, peel, vertices_of

DEEP = 16
MERGE = 6  # tables of distances that are read at once


def light_arcs(edges: DataFrame) -> DataFrame:
    """(src, dst, slot, w): each edge's least weight; only it can lie on a shortest path."""
    return edges.select("src", "dst", min_slot().alias("slot"), min_weight().alias("w")).where("w is not null")


def flip(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "slot", "w")


def zero_at(names: DataFrame) -> DataFrame:
    """(v, dist) of 0 at each (name)."""
    return names.select(F.col("name").alias("v"), F.lit(0).cast("long").alias("dist"))


def _least(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("v").agg(F.min("dist").alias("dist"))


def _rounds(arcs: DataFrame, start: DataFrame, scratch: Scratch, fixed: DataFrame | None, limit: int | None) -> DataFrame | None:
    """Distances (v, dist), or None if ``limit`` rounds did not settle them."""
    state = [scratch.save(start.groupBy("v").agg(F.min("dist").alias("dist")))]
    front = state[0] if fixed is None else state[0].unionByName(fixed.select("v", "dist"))
    n = 0
    while limit is None or n < limit:
        met = arcs.join(front.withColumnRenamed("v", "dst"), "dst")
        found = scratch.save(met.groupBy(F.col("src").alias("v")).agg(F.min(F.col("w") + F.col("dist")).alias("new")))
        known = _least([t.join(found.select("v"), "v", "left_semi") for t in state])
        front, fell = scratch.counted(found.join(known, "v", "left").where("dist is null or new < dist").select("v", F.col("new").alias("dist")))
        scratch.drop(found)
        if not fell:
            return _least(state)
        state.append(front)
        if len(state) > MERGE:  # the small tables become one
            state = [state[0], scratch.save(_least(state[1:]))] if n % (MERGE * MERGE) else [scratch.save(_least(state))]
        n += 1
    return None


def jumps(arcs: DataFrame, stops: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, to, d): for each vertex with one way out, but for ``stops`` (v), the first vertex
    behind it that is none of these, and the way's weight, by pointer doubling."""
    one = arcs.groupBy("src").agg(F.count("*").alias("n"), F.min(F.struct("dst", "w")).alias("a")).where("n = 1")
    one = one.join(stops.select(F.col("v").alias("src")), "src", "left_anti")
    hop = scratch.save(one.select(F.col("src").alias("v"), F.col("a.dst").alias("to"), F.col("a.w").alias("d")))
    n, reach = hop.count(), 1
    while True:
        ahead = hop.select(F.col("v").alias("to"), F.col("to").alias("next"), F.col("d").alias("more"))
        open_ = hop.join(ahead, "to")
        if open_.isEmpty():
            return hop
        if reach > n:
            raise CycleError("a chain of vertices closes on itself")
        both = hop.join(ahead, "to", "left").select("v", F.coalesce("next", "to").alias("to"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"))
        hop, reach = scratch.save(both), reach * 2


def relax(arcs: DataFrame, start: DataFrame, scratch: Scratch, fixed: DataFrame | None = None) -> DataFrame:
    """(v, dist): least weight of a way from v to a vertex of ``start`` (v, dist).

    ``fixed`` (v, dist) are ends whose distance holds already and is not relaxed.  Arcs are read
    in every round, so they should come from a saved table.  A cycle raises CycleError."""
    own = Scratch(scratch.spark)
    found = _rounds(arcs, start, own, fixed, DEEP)
    if found is None:
        hop = jumps(arcs, start, own)
        short = arcs.join(hop.select(F.col("v").alias("src")), "src", "left_anti")
        short = short.join(hop.select(F.col("v").alias("dst"), "to", "d"), "dst", "left")
        short = own.save(short.select("src", F.coalesce("to", "dst").alias("dst"), "slot", (F.col("w") + F.coalesce("d", F.lit(0))).alias("w")))
        left = peel(short, Scratch(scratch.spark)).take(1)
        if left:
            raise CycleError(f"a cycle is reached from {left[0]['src']!r}")
        ends = _rounds(short, start, own, fixed, None)
        all_ends = ends if fixed is None else ends.unionByName(fixed.select("v", "dist"))
        found = _least([ends, _jumped(all_ends, hop)])
    return own.finish(found)


def _jumped(dist: DataFrame, hop: DataFrame) -> DataFrame:
    """(v, dist) of the jumped-over vertices from that of the vertices they lead to."""
    return hop.join(dist.withColumnRenamed("v", "to"), "to").select("v", (F.col("dist") + F.col("d")).alias("dist"))


def suffix_tree(edges: DataFrame, scratch: Scratch, dist: DataFrame | None = None) -> DataFrame:
    """(v, dist, succ, link_slot) to the nearest sink; of equal ways the least (succ, slot)."""
    edges = saved(edges, scratch)
    light = light_arcs(edges)
    if dist is None:
        dist = relax(light, zero_at(degrees(edges).where("fanouts = 0")), scratch)
    ahead = light.join(dist.select(F.col("v").alias("dst"), F.col("dist").alias("ahead")), "dst")
    link = ahead.groupBy(F.col("src").alias("v")).agg(F.min(F.struct((F.col("w") + F.col("ahead")).alias("d"), "dst", "slot")).alias("l"))
    return dist.join(link, "v", "left").select("v", "dist", F.col("l.dst").alias("succ"), F.col("l.slot").alias("link_slot"))


def prefix_dist(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, dist) from the nearest source."""
    edges = saved(edges, scratch)
    return relax(flip(light_arcs(edges)), zero_at(degrees(edges).where("fanins = 0")), scratch)


def ancestors(edges: DataFrame, dirty: DataFrame, scratch: Scratch) -> DataFrame:
    """(v): the dirty vertices and all from which they are reached.  A round writes its front."""
    own = Scratch(scratch.spark)
    edges = saved(edges.select("src", "dst"), own) if not hasattr(edges, "_scratch") else edges
    state = [own.save(dirty.select("v").distinct())]
    while True:
        front = state[-1]
        up = edges.join(front.withColumnRenamed("v", "dst"), "dst", "left_semi").select(F.col("src").alias("v")).distinct()
        for table in state:
            up = up.join(table, "v", "left_anti")
        front, new = own.counted(up)
        if not new:
            return own.finish(reduce(DataFrame.unionByName, state))
        state = [*state, front] if len(state) < MERGE else [own.save(reduce(DataFrame.unionByName, state)), front]


def dirty_vertices(before: DataFrame, after: DataFrame) -> DataFrame:
    """(v): both ends of every edge that differs between two versions of a graph."""
    changed = before.exceptAll(after).unionByName(after.exceptAll(before))
    return vertices_of(changed).withColumnRenamed("name", "v")


def repair(edges: DataFrame, old: DataFrame, dirty: DataFrame, scratch: Scratch) -> DataFrame:
    """Distances (v, dist) of the edited graph from the old ones: only ancestors of dirty
    vertices are computed again, against the distances at their border."""
    edges = saved(edges, scratch)
    region = ancestors(edges, dirty, scratch)
    verts = scratch.save(degrees(edges).withColumnRenamed("name", "v"))
    fixed = scratch.save(old.select("v", "dist").join(region, "v", "left_anti").join(verts, "v", "left_semi"))
    inside = scratch.save(light_arcs(edges).join(region.withColumnRenamed("v", "src"), "src", "left_semi"))
    ends = verts.where("fanouts = 0").select("v", F.lit(0).cast("long").alias("dist")).join(region, "v", "left_semi")
    border = fixed.join(inside.select(F.col("dst").alias("v")), "v", "left_semi")
    return fixed.unionByName(relax(inside, ends, scratch, border))
