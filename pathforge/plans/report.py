"""report(K): the K cheapest source-to-sink paths, exactly.

Partial paths advance one arc a round.  A partial path with cost g at vertex v is the start of
a complete path of cost f = g + dist(v) exactly, and different partial paths start different
ones.  A path's text ends every vertex name with ">", so of two partial paths the one with the
lesser text has only completions of lesser text.  So the K least (f, text) of a round hold the
starts of all K answers, ties included, and a round's rows are K and their next arcs.  Rounds
are as many as the longest kept path has arcs; after ``DEEP`` rounds runs of vertices with one
way in and one way out are jumped over, and put back at the end.  Per endpoint, paths grow
backwards from each sink against distances from the sources, with a bound of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import CycleError
from ..operators.graph import arcs as arcs_of
from ..operators.graph import degrees
from ..operators.order import ONE_MERGE, first_rows, numbered
from ..operators.suffix import DEEP, flip, light_arcs, relax, zero_at
from ..store import Scratch, saved

PATHS = "rank long, weight long, startpoint string, endpoint string, path string, points array<struct<pos:int,vert:string,dist:long>>"


@dataclass
class Beam:
    """What a search reads.  Vertices have a key and a name; in most searches they are the same."""

    arcs: DataFrame  # src, dst, slot, w; by key
    dist: DataFrame  # v, name, dist, more: the way that is left, and whether arcs go on
    starts: DataFrame  # v, home


def _cut(rows: DataFrame, k: int, per: bool, scratch: Scratch) -> DataFrame:
    """The k rows that may lead to answers (of each home)."""
    if per:  # the tasks cut each home to k before the rows are dealt
        nth = F.row_number().over(Window.partitionBy("home").orderBy("f", "text"))
        return rows.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")
    return first_rows(rows, k, ["f", "text"], scratch)


def _step(vert, slot, w, jump) -> Column:
    return F.struct(vert.alias("vert"), slot.cast("int").alias("slot"), w.cast("long").alias("w"), jump.cast("string").alias("jump"))


def search(beam: Beam, k: int, scratch: Scratch, per: bool = False, min_points: int = 2) -> DataFrame:
    """(home, f, text, steps) of the best k paths (of each home), as a saved table."""
    own, none, zero = Scratch(scratch.spark), F.lit(None), F.lit(0).cast("long")
    front = beam.starts.join(beam.dist, "v").select("home", "v", zero.alias("g"), F.col("dist").alias("f"), F.concat("name", F.lit(">")).alias("text"), F.array(_step(F.col("name"), none, zero, none)).alias("steps"), "more")
    both, live = own.counted(_cut(front if min_points < 2 else front.where("more"), k, per, own), F.col("more"))
    arcs = beam.arcs.withColumns({"total": F.col("w"), "jump": none.cast("string"), "first": none.cast("string"), "last": none.cast("int"), "last_w": none.cast("long")})
    members, n = None, 0
    while live:
        if n == DEEP:
            arcs, members = _over_runs(beam, own)
        going = both.where("more").join(arcs, both["v"] == arcs["src"]).drop("v", "more", "f")
        going = going.join(beam.dist, going["dst"] == beam.dist["v"])
        # a jump is two steps: the run's first vertex, which stands for the run, and what follows it
        head, jumped = F.concat("text", F.col("slot").cast("string"), F.lit(":")), F.col("jump").isNotNull()
        one = F.array(_step(F.col("name"), F.col("slot"), F.col("w"), none))
        two = F.array(_step(F.col("first"), F.col("slot"), F.col("w"), F.col("jump")), _step(F.col("name"), F.col("last"), F.col("last_w"), none))
        grown = going.select(
            "home", F.col("dst").alias("v"), (F.col("g") + F.col("total")).alias("g"), (F.col("g") + F.col("total") + F.col("dist")).alias("f"),
            F.concat(head, F.when(jumped, F.concat("first", F.lit(">"))).otherwise(""), "name", F.lit(">")).alias("text"), F.concat("steps", F.when(jumped, two).otherwise(one)).alias("steps"), "more",
        )
        both, live = own.counted(_cut(grown.unionByName(both.where("not more")), k, per, own), F.col("more"))
        n += 1
    found = both.select("home", "f", "text", "steps")
    return own.finish(found if members is None else _put_back(found, members))


def _over_runs(beam: Beam, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The arcs with runs of vertices that have one way in and one arc out jumped over, and the
    runs' members (v, name, id, hops, in_slot, in_w); id is a run's last vertex."""
    arcs = beam.arcs.join(beam.dist.select(F.col("v").alias("dst")), "dst", "left_semi")
    out = arcs.groupBy("src").agg(F.count("*").alias("n"), F.min(F.struct("dst", "slot", "w")).alias("a")).where("n = 1")
    into = arcs.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n")).where("n = 1").select(F.col("dst").alias("src"))
    inner = scratch.save(out.join(into, "src", "left_semi").select(F.col("src").alias("v"), F.col("a.dst").alias("next"), F.col("a.slot").alias("slot"), F.col("a.w").alias("w")))
    # hops and ahead: arcs and weight to the run's last vertex, by pointer doubling
    on = F.col("next_in").isNotNull()
    runs = inner.join(inner.select(F.col("v").alias("next_in")), F.col("next") == F.col("next_in"), "left")
    runs = scratch.save(runs.select("v", F.when(on, F.col("next")).otherwise(F.col("v")).alias("id"), F.when(on, 1).otherwise(0).cast("long").alias("hops"), F.when(on, F.col("w")).otherwise(0).alias("ahead")))
    n, reach, moved = inner.count(), 1, True
    while moved:
        if reach > 2 * n + 1:
            raise CycleError("a run of vertices closes on itself")
        far = runs.select(F.col("v").alias("id"), F.col("id").alias("far"), F.col("hops").alias("far_hops"), F.col("ahead").alias("far_ahead"))
        step, moved = scratch.counted(runs.join(far, "id").select("v", F.col("far").alias("id"), (F.col("hops") + F.col("far_hops")).alias("hops"), (F.col("ahead") + F.col("far_ahead")).alias("ahead"), (F.col("far_hops") > 0).alias("moved")), F.col("moved"))
        runs, reach = step.drop("moved"), reach * 2
    before = inner.select(F.col("next").alias("v"), F.col("slot").alias("in_slot"), F.col("w").alias("in_w")).join(inner.select("v"), "v", "left_semi")
    members = scratch.save(runs.join(beam.dist.select("v", "name"), "v").join(before, "v", "left"))
    ends = inner.select(F.col("v").alias("id"), F.col("next").alias("to"), F.col("slot").alias("last"), F.col("w").alias("last_w"))
    over = members.select(F.col("v").alias("dst"), F.col("name").alias("first"), "id", "ahead").join(ends, "id")
    far = arcs.join(over, "dst", "left")
    jumped = F.col("to").isNotNull()
    total = F.col("w") + F.when(jumped, F.col("ahead") + F.col("last_w")).otherwise(0)
    return scratch.save(far.select("src", F.coalesce("to", "dst").alias("dst"), "slot", "w", total.alias("total"), F.when(jumped, F.col("dst")).alias("jump"), "first", "last", "last_w")), members


def _put_back(found: DataFrame, members: DataFrame) -> DataFrame:
    """Paths with the vertices that were jumped over."""
    rows = found.select("home", "f", "text", F.posexplode("steps").alias("i", "s")).select("home", "f", "text", "i", "s.*")
    here = members.select(F.col("v").alias("jump"), "id", F.col("hops").alias("upto"))
    run = members.select("id", "hops", "name", "in_slot", "in_w")
    inner = rows.select("home", "f", "text", "i", "jump").join(here, "jump").join(run, "id").where("hops < upto")
    inner = inner.select("home", "f", "text", "i", (F.col("upto") - F.col("hops")).alias("j"), F.col("name").alias("vert"), F.col("in_slot").alias("slot"), F.col("in_w").alias("w"))
    plain = rows.select("home", "f", "text", "i", F.lit(0).cast("long").alias("j"), "vert", "slot", "w")
    whole = plain.unionByName(inner).groupBy("home", "f", "text").agg(F.array_sort(F.collect_list(F.struct("i", "j", "vert", "slot", "w"))).alias("a"))
    steps = F.transform("a", lambda x: _step(x["vert"], x["slot"], x["w"], F.lit(None)))
    return whole.select("home", "f", steps.alias("steps")).select("home", "f", path_text("steps").alias("text"), "steps")


def path_text(steps: str, end: str = ">") -> Column:
    """v0>slot:v1>slot:v2: parallel arcs give different paths; ``end`` stands behind the last."""
    part = lambda s: F.concat(F.coalesce(F.concat(s["slot"].cast("string"), F.lit(":")), F.lit("")), s["vert"])
    return F.concat(F.array_join(F.transform(steps, part), ">"), F.lit(end))


def _points(steps: Column) -> Column:
    def at(s: Column, i: Column) -> Column:
        dist = F.aggregate(F.slice(steps, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x["w"])
        return F.struct(i.cast("int").alias("pos"), s["vert"].alias("vert"), dist.alias("dist"))

    return F.transform(steps, at)


def _turned(steps: str) -> Column:
    """Steps from the other end: a step's slot and weight are those of the arc before it."""
    back = F.reverse(F.col(steps))
    return F.transform(back, lambda s, i: _step(s["vert"], F.get(back, i - 1)["slot"], F.coalesce(F.get(back, i - 1)["w"], F.lit(0)), F.lit(None)))


def distances(edges: DataFrame, scratch: Scratch, backward: bool = False, verts: DataFrame | None = None) -> DataFrame:
    """(v, dist) to the nearest sink; ``backward``: from the nearest source."""
    verts = degrees(edges) if verts is None else verts
    light = light_arcs(edges)
    return relax(flip(light) if backward else light, zero_at(verts.where("fanins = 0" if backward else "fanouts = 0")), scratch)


def beam_of(edges: DataFrame, verts: DataFrame, dist: DataFrame, scratch: Scratch, backward: bool = False, alone: DataFrame | None = None) -> Beam:
    """What a search reads, from saved edges and their vertices (name, fanins, fanouts);
    ``alone`` (name) are vertices without edges."""
    goes_on, begins = ("fanins > 0", "fanouts = 0") if backward else ("fanouts > 0", "fanins = 0")
    ends = dist.join(verts.withColumnRenamed("name", "v"), "v").select("v", F.col("v").alias("name"), "dist", F.expr(goes_on).alias("more"))
    starts = verts.where(begins).select(F.col("name").alias("v"))
    if alone is not None:
        ends = ends.unionByName(alone.select(F.col("name").alias("v"), "name", F.lit(0).cast("long").alias("dist"), F.lit(False).alias("more")))
        starts = starts.unionByName(alone.select(F.col("name").alias("v")))
    arcs = scratch.save(arcs_of(edges))
    return Beam(flip(arcs) if backward else arcs, scratch.save(ends), starts.select("v", F.col("v").alias("home") if backward else F.lit("").alias("home")))


def find_paths(edges: DataFrame, k: int, scratch: Scratch, *, per: bool = False, min_points: int = 2, dist: DataFrame | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """(home, f, text, steps) of the k cheapest paths (of each endpoint), in path direction."""
    own = Scratch(scratch.spark)
    edges = saved(edges, own)
    verts = own.save(degrees(edges))
    if dist is None or per:
        dist = distances(edges, own, per, verts)
    alone = vertices.select("name").distinct().join(verts, "name", "left_anti") if vertices is not None and min_points < 2 else None
    found = search(beam_of(edges, verts, dist, own, per, alone), k, own, per, min_points)
    if per:
        found = found.select("home", "f", "text", _turned("steps").alias("steps"))
    return own.finish(found)


def top_k_paths(
    edges: DataFrame, k: int, *, scope: str = "global", min_points: int = 2, recover: bool = True, dist: DataFrame | None = None, vertices: DataFrame | None = None, strategy: str = "arcs", delta: int | None = None
) -> DataFrame:
    """The k cheapest paths: rank, weight and, with ``recover``, startpoint, endpoint, path and
    points.  Equal weights are ordered by the path's text with ">" behind its last vertex.

    scope "global": of the whole graph; "per_endpoint": of each sink, ranked within it, equal
    weights by the text read from the endpoint (its endpoint is always returned).
    ``min_points=1`` admits vertices without edges, which ``vertices`` (name) holds, as paths of
    one point.  k = 0 gives an empty result, and k above the number of paths all.
    strategy "arcs" advances paths arc by arc; "deviations" and "buckets" enumerate deviations
    from shortest paths (``plans.deviations``), the latter by cost buckets of width ``delta``."""
    spark, per = edges.sparkSession, scope == "per_endpoint"
    if scope not in ("global", "per_endpoint"):
        raise ValueError(f"unknown scope {scope!r}")
    names = ["rank", "weight", *(["startpoint", "endpoint", "path", "points"] if recover else ["endpoint"] if per else [])]
    if k <= 0:
        return spark.createDataFrame([], PATHS).select(names)
    scratch = Scratch(spark)
    if strategy == "arcs":
        found = find_paths(edges, k, scratch, per=per, min_points=min_points, dist=dist, vertices=vertices)
    elif strategy in ("deviations", "buckets") and not per:
        from .deviations import enumerate_paths

        found = enumerate_paths(edges, k, scratch, delta=delta, buckets=strategy == "buckets", dist=dist, min_points=min_points, vertices=vertices).paths
    else:
        raise ValueError(f"unknown strategy {strategy!r} for scope {scope!r}")
    return ranked_paths(found, k, per, scratch).select(names)


def ranked_paths(found: DataFrame, k: int, per: bool, scratch: Scratch) -> DataFrame:
    """PATHS from rows (home, f, text, steps)."""
    order = ["f", "text"]
    if per:
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("home").orderBy(*order)).cast("long"))
    elif k <= ONE_MERGE:  # at most k rows are numbered
        found = found.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        found = numbered(found, order, scratch)
    return found.where(F.col("rank") <= k).select(
        "rank", F.col("f").alias("weight"), F.col("steps")[0]["vert"].alias("startpoint"), F.element_at("steps", -1)["vert"].alias("endpoint"), path_text("steps", "").alias("path"), _points(F.col("steps")).alias("points")
    )


def top_k_costs(edges: DataFrame, k: int, **options) -> DataFrame:
    """(rank, cost) in ascending order."""
    return top_k_paths(edges, k, recover=False, **options).withColumnRenamed("weight", "cost")
