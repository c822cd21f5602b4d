import random

import pytest
from pyspark.sql import functions as F

from pathforge.operators import compare, graph
from pathforge.operators.suffix import ancestors, dirty_vertices, light_arcs, relax, repair, suffix_tree
from pathforge.plans import deviations
from pathforge.plans.report import top_k_costs, top_k_paths
from pathforge.plans.script import run_ops
from pathforge.plans.session import GraphSession
from pathforge.sources import render
from pathforge.store import Scratch

from .graphs import brute, frame, parse
from .graphs import graph as make

LAYERED = "v0>v6:2 v0>v4:4 v1>v4:1 v2>v4:6 v2>v5:5 v3>v6:1 v4>v6:3 v4>v7:2 v5>v7:1 v6>v8:6 v7>v8:3"
F6 = "A>B:-1 A>C:3 C>D:1 C>E:2 D>B:3 B>F:1 B>G:2 F>H:-4 F>I:8 I>L:4 I>M:11 G>J:5 G>K:7"


def costs(df, column="cost"):
    return [r[column] / 100 for r in df.orderBy("rank").collect()]


def backwards(path):
    """A path's text as it is read from its end."""
    parts = [p.partition(":") for p in path.split(">")]
    names = [n if sep else s for s, sep, n in parts]
    text = names[-1] + ">"
    for i in range(len(parts) - 1, 0, -1):
        text += f"{parts[i][0]}:{names[i - 1]}>"
    return text


def random_dag(rng, n):
    out = {}
    for i in range(n):
        for j in range(i + 1, n):
            if rng.random() < 0.45:
                out[f"v{i}", f"v{j}"] = [rng.randint(-300, 500) if rng.random() < 0.3 else None for _ in range(8)]
    return out


def test_layered_paths_and_points(spark):
    rows = top_k_paths(make(spark, LAYERED), 9).orderBy("rank").collect()
    assert [r.weight for r in rows] == [600, 700, 800, 900, 900, 1000, 1100, 1300, 1500]
    assert [tuple(p) for p in rows[0].points] == [(0, "v1", 0), (1, "v4", 100), (2, "v7", 300), (3, "v8", 600)]


@pytest.mark.parametrize(
    ("text", "k", "want"),
    [
        (F6, 11, [-4, 4, 5, 6, 8, 12, 14, 16, 19, 20, 27]),
        ("A>B:0,_,_,0,0,_,_,0", 10, [0, 0, 0, 0]),
        ("v0>v2:1 v1>v2:1 v2>v3:-5 v2>v4:1 v4>v5:0", 10, [-4, -4, 2, 2]),
        ("A>B:1 B>C:_ A>D:2", 5, [2]),  # no way through an edge without weights
    ],
)
def test_costs(spark, text, k, want):
    assert costs(top_k_costs(make(spark, text), k)) == want


def test_limits(spark):
    edges = make(spark, "a>b:1")
    assert top_k_paths(edges, 0).count() == 0
    assert top_k_paths(edges.limit(0), 5).count() == 0
    assert top_k_paths(edges, 1000).count() == 1
    with pytest.raises(ValueError, match="scope"):
        top_k_paths(edges, 1, scope="other")


@pytest.mark.parametrize("seed", range(2))
def test_random_dags_match_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = random_dag(rng, 6)
    want = sorted(brute(edges), key=lambda p: (p[0], p[1] + ">"))
    df = frame(spark, edges)
    for k in (3, 40)[seed:]:
        got = [(r.weight, r.path) for r in top_k_paths(df, k).orderBy("rank").collect()]
        assert got == want[:k]
    by_end = {}
    for cost, path in want:
        by_end.setdefault(path.rsplit(":", 1)[-1], []).append((cost, path))
    for ps in by_end.values():
        ps.sort(key=lambda p: (p[0], backwards(p[1])))
    got = top_k_paths(df, 3, scope="per_endpoint").collect()
    assert {(r.endpoint, r["rank"], r.weight, r.path) for r in got} == {(e, i + 1, *p) for e, ps in by_end.items() for i, p in enumerate(ps[:3])}
    for strategy in ("deviations", "buckets")[seed : seed + 1]:
        assert costs(top_k_costs(df, 40, strategy=strategy, delta=200)) == [c / 100 for c, _ in want[:40]]
        rows = top_k_paths(df, 40, strategy=strategy).collect()
        assert len({r.path for r in rows}) == len(rows) and {(r.weight, r.path) for r in rows} <= set(want)


def test_cycles_are_found(spark):
    graph.check_acyclic(make(spark, LAYERED))
    with pytest.raises(graph.CycleError):
        graph.check_acyclic(make(spark, "a>b:1 b>c:1 c>b:1 c>d:1"))


def test_peel_keeps_what_leads_to_a_cycle(spark):
    """A branch that leaves a cycle, or the way to one, and ends is taken away with its edges."""
    cyclic = "a>b:1 b>c:1 c>b:1 s>s:1 r>a:1 r>s:1"
    chain = " ".join(f"x{i}>x{i + 1}:1" for i in range(9))  # more rounds than PEELED
    left = graph.peel(make(spark, f"{cyclic} c>d:1 d>e:1 a>e:1 s>e:1 r>x0:1 {chain} y>z:1"), Scratch(spark))
    assert sorted(map(tuple, left.collect())) == sorted(parse(cyclic))


def test_peel_takes_an_edge_without_an_end_for_none(spark):
    rows = [("a", "b"), ("b", "a"), (None, "a"), ("a", None), ("x", "y"), ("y", None), (None, "x"), (None, None)]
    edges = spark.createDataFrame(rows * 2, "src string, dst string")
    assert set(map(tuple, graph.peel(edges, Scratch(spark)).collect())) == {("a", "b"), ("b", "a"), (None, "a")}
    graph.check_acyclic(edges.where("coalesce(src, 'x') in ('x', 'y')").where("coalesce(dst, 'x') in ('x', 'y')"))


def test_edits_with_names_that_hold_arrows(spark):
    edges = frame(spark, {("a->b", "c"): [1, *[None] * 7], ("a", "b->c"): [2, *[None] * 7]})
    assert edges.count() == 2
    assert graph.remove_edges(edges, edges.where("src = 'a'")).count() == 1


def test_ddl_counts_and_cascade(spark):
    session = GraphSession(make(spark, "v1>v2:1 v1>v3:1 v4>v1:1 v5>v1:1 v6>v1:1 v2>v7:1 v2>v8:1 v2>v3:1"))
    session.remove_vertices(spark.createDataFrame([("v1",)], "name string"))
    assert session.edges.count() == 3
    session.remove_vertices(spark.createDataFrame([("v2",)], "name string"))
    assert session.edges.count() == 0
    assert session.report(5).count() == 0


def test_overwrite_replaces_all_slots(spark):
    session = GraphSession(make(spark, "v1>v3:1,2,3,4"))
    session.insert_edges(make(spark, "v1>v3:0,0,3.89"))
    assert session.edges.collect()[0][2:] == (0, 0, 389, None, None, None, None, None)


@pytest.mark.parametrize(
    ("edit", "k", "want"),
    [
        ("A>C:0", 20, [-4, 1, 2, 6, 8, 11, 12, 13, 17, 19, 24]),
        ("A>C:0 A>B:5", 20, [1, 2, 2, 11, 12, 13, 14, 17, 18, 24, 25]),
        ("F>I:-9", 20, [-5, -4, 2, 3, 4, 5, 6, 8, 10, 14, 16]),
        ("A>C:9 C>E:5", 4, [-4, 6, 8, 10]),
    ],
)
def test_incremental_equals_known_costs(spark, edit, k, want):
    session = GraphSession(make(spark, F6))
    assert costs(session.report(11, recover=False)) == [-4, 4, 5, 6, 8, 12, 14, 16, 19, 20, 27]
    session.insert_edges(make(spark, edit))
    assert costs(session.report(k, recover=False)) == want


@pytest.mark.parametrize("seed", range(2))
def test_repair_equals_rebuild(spark, seed):
    rng = random.Random(100 + seed)
    edges = random_dag(rng, 9)
    scratch = Scratch(spark)

    def dist(e):
        df = frame(spark, e)
        return df, relax(light_arcs(df), graph.sinks(df).select(F.col("name").alias("v"), F.lit(0).cast("long").alias("dist")), scratch)

    before, old = dist(edges)
    changed = dict(edges)
    for key in rng.sample(sorted(edges), 3):
        del changed[key]
    for key in rng.sample(sorted(changed), 2):
        changed[key] = [rng.randint(-300, 300), *[None] * 7]
    changed["v0", "new"] = [5, *[None] * 7]
    after, want = dist(changed)
    got = repair(after, old, scratch.save(dirty_vertices(before, after)), scratch)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ancestors(spark):
    dirty = spark.createDataFrame([("v7",)], "v string")
    assert {r.v for r in ancestors(make(spark, LAYERED), dirty, Scratch(spark)).collect()} == {"v7", "v4", "v5", "v0", "v1", "v2"}


def test_buffers(spark):
    edges = make(spark, "S>a:1 a>b:2 b>t:3 S>c:4 c>d:2,_,1 d>u:4")
    put = spark.createDataFrame([("a", "b", "x"), ("c", "d", "y")], "src string, dst string, name string")
    split = graph.insert_buffers(edges, put)
    # 1 + 2 + 3 and 4 + 1 + 4 each lose a fifth of the split edge, and so does 4 + 2 + 4
    assert costs(top_k_costs(split, 2)) == [5.6, 8.8]
    back = graph.remove_buffers(split, put)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, edges.collect()))


def test_long_chain(spark):
    n = 12_000
    text = " ".join(f"c{i}>c{i + 1}:1" for i in range(n)) + " c100>x:5 x>c300:0"
    edges = make(spark, text)
    assert graph.chain_edges(edges).count() == n - 2
    rows = top_k_paths(edges, 3).orderBy("rank").collect()
    assert [(r.weight, len(r.points)) for r in rows] == [((n - 195) * 100, n - 197), (n * 100, n + 1)]
    assert [p.vert for p in rows[1].points] == [f"c{i}" for i in range(n + 1)]
    assert [p.dist for p in rows[1].points] == [100 * i for i in range(n + 1)]
    assert rows[0].path.startswith("c0>0:c1>") and ">0:c100>0:x>0:c300>" in rows[0].path


@pytest.mark.parametrize("weight", [1, -1])
def test_cycles_end_a_report(spark, weight):
    ladder = " ".join(f"a{i}>a{i + 1}:{weight},0 a{i}>b{i}:1 b{i}>a{i + 1}:1" for i in range(20))
    with pytest.raises(graph.CycleError):
        top_k_costs(make(spark, ladder + " a20>a10:-5 a20>end:1"), 3)
    with pytest.raises(graph.CycleError):
        top_k_costs(make(spark, "s>a:1 " + " ".join(f"a{i}>a{i + 1}:-1" for i in range(30)) + " a>a0:1 a31>a0:1 a30>a31:1 a31>t:1"), 3)


def test_ties_are_cut(spark):
    """2**40 paths of one cost: the search keeps k rows a round."""
    edges = make(spark, " ".join(f"v{i}>v{i + 1}:0,0" for i in range(40)))
    rows = top_k_paths(edges, 5).orderBy("rank").collect()
    tails = [r.path.split(">")[-3:] for r in rows]
    assert [r.weight for r in rows] == [0] * 5
    assert tails == [[f"{a}:v38", f"{b}:v39", f"{c}:v40"] for a, b, c in ((0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0))]


def test_fold_by_sequence(spark):
    schema = "seq long, op string, src string, dst string, name string, w0 long"
    ops = spark.createDataFrame(
        [(1, "insert_edge", "a", "b", None, 1), (2, "insert_edge", "a", "b", None, 5), (3, "insert_edge", "b", "c", None, 2), (4, "remove_vertex", None, None, "b", None),
         (5, "insert_edge", "a", "b", None, 9), (6, "insert_edge", "a", "d", None, 3), (7, "remove_edge", "a", "d", None, None)],
        schema,
    )
    ops = ops.select("*", *[F.lit(None).cast("long").alias(f"w{i}") for i in range(1, 8)])
    assert [tuple(r)[:3] for r in graph.fold(ops).collect()] == [("a", "b", 9)]
    more = ops.limit(0).unionByName(
        spark.createDataFrame([(1, "insert_buffer", "a", "b", "x", None), (2, "insert_buffer", "x", "b", "y", None), (3, "remove_buffer", None, None, "y", None)], schema).select(
            "*", *[F.lit(None).cast("long").alias(f"w{i}") for i in range(1, 8)]
        )
    )
    session = GraphSession(make(spark, "a>b:10 c>d:1")).apply(more)
    assert sorted((r.src, r.dst, r.w0) for r in session.edges.collect()) == [("a", "x", 400), ("c", "d", 100), ("x", "b", 400)]


def rows_of(spark, *rows):
    schema = "seq long, op string, src string, dst string, name string, w0 long"
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], schema).select("*", *[F.lit(None).cast("long").alias(f"w{i}") for i in range(1, 8)])


def test_buffers_outlive_their_batch(spark):
    session = GraphSession(make(spark, "a>b:10"))
    session.apply(rows_of(spark, (0, "insert_buffer", "a", "b", "x")))
    session.apply(rows_of(spark, (0, "insert_buffer", "x", "b", "y"), (1, "insert_edge", "b", "c", None, 500)))
    assert sorted((r.src, r.dst, r.w0) for r in session.edges.collect()) == [("a", "x", 400), ("b", "c", 500), ("x", "y", 160), ("y", "b", 160)]
    session.apply(rows_of(spark, (0, "remove_buffer", None, None, "y"), (1, "remove_buffer", None, None, "x")))
    assert sorted((r.src, r.dst, r.w0) for r in session.edges.collect()) == [("a", "b", 1000), ("b", "c", 500)]
    session.insert_buffers(spark.createDataFrame([("b", "c", "z")], "src string, dst string, name string"))
    session.remove_buffers(spark.createDataFrame([("z",)], "name string"))
    assert sorted((r.src, r.dst, r.w0) for r in session.edges.collect()) == [("a", "b", 1000), ("b", "c", 500)]
    assert session.buffers.count() == 0


def test_vertices_without_edges(spark):
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    session = GraphSession(make(spark, "a>b:1 b>c:2")).insert_vertices(names("z", "a", "z"))
    assert tuple(session.counts()) == (4, 2)
    assert tuple(session.get_vertex("z")) == ("z", 0, 0) and tuple(session.get_vertex("b")) == ("b", 1, 1)
    assert session.get_edge("a", "b").w0 == 100
    for miss in (lambda: session.get_edge("a", "c"), lambda: session.get_vertex("q")):
        with pytest.raises(KeyError):
            miss()
    assert [(r.weight, r.path) for r in session.report(5, min_points=1).orderBy("rank").collect()] == [(0, "z"), (300, "a>0:b>0:c")]
    session.remove_edges(make(spark, "b>c:2"))
    assert [r.path for r in session.report(5, min_points=1).orderBy("rank").collect()] == ["c", "z", "a>0:b"]
    session.remove_vertices(names("a", "z"))
    assert {r.name for r in session.vertices().collect()} == {"b", "c"}
    session.apply(rows_of(spark, (0, "insert_vertex", None, None, "n"), (1, "remove_vertex", None, None, "c"), (2, "insert_edge", "n", "m", None, 1), (3, "remove_edge", "n", "m")))
    assert {r.name for r in session.vertices().collect()} == {"b", "n", "m"}


def test_session_edits(spark):
    session = GraphSession(make(spark, "a>b:1 b>c:2,_,4 x>y:1"))
    with pytest.raises(ValueError, match="twice"):
        session.insert_edges(make(spark, "a>b:5").union(make(spark, "a>b:7")))
    both = make(spark, "a>b:5").withColumn("n", F.lit(2)).union(make(spark, "a>b:7").withColumn("n", F.lit(1)))
    session.insert_edges(both, order=["n"])
    assert session.get_edge("a", "b").w0 == 500
    session.modify_vertex("b", 10)
    assert (session.get_edge("a", "b").w0, session.get_edge("b", "c").w2, session.get_edge("x", "y").w0) == (510, 410, 100)
    session.update_percent(34, 1)
    assert (session.get_edge("a", "b").w0, session.get_edge("b", "c").w0) == (511, 210)


@pytest.mark.parametrize("seed", range(2))
def test_continued_reports_equal_new_ones(spark, seed):
    """Edits that insert, change and remove edges, and make and unmake sources and sinks."""
    rng = random.Random(50 + seed)
    edges = {**random_dag(rng, 8), **{(f"x{i}", f"x{i + 1}"): [5 * i, *[None] * 7] for i in range(4)}}
    session = GraphSession(frame(spark, edges))
    k = 12
    for turn in range(2 + seed):
        want = sorted(brute(edges), key=lambda p: (p[0], p[1] + ">"))[:k]
        assert [(r.weight, r.path) for r in session.report(k).orderBy("rank").collect()] == want, turn
        some = [e for e in sorted(edges) if e[0][0] == "v"]
        put = {rng.choice(some): [rng.randint(-200, 200), *[None] * 7], ("v7", f"new{turn}"): [rng.randint(-99, 99), *[None] * 7], (f"old{turn}", "v3"): [1, *[None] * 7]}
        gone = dict.fromkeys(rng.sample(some, 2), [None] * 8)
        session.insert_edges(frame(spark, put)).remove_edges(frame(spark, gone))
        edges = {e: w for e, w in {**edges, **put}.items() if e not in gone}


def test_script(spark):
    ops = rows_of(spark, (0, "insert_edge", "a", "b", None, 100), (2, "insert_edge", "a", "c", None, -5), (4, "remove_edge", "a", "b")).select("*", F.lit(None).cast("int").alias("k"), F.lit(False).alias("recover"))
    reports = spark.createDataFrame([(1, "report", 5, True), (3, "report", 5, None), (5, "report", 5, True), (6, "report", 0, True)], "seq long, op string, k int, recover boolean")
    ops = ops.unionByName(reports, allowMissingColumns=True)
    session = GraphSession(make(spark, "q>r:1").limit(0))
    assert sorted(map(tuple, run_ops(session, ops).select("report", "rank", "weight", "path").collect())) == [(1, 1, 100, "a>0:b"), (3, 1, -5, None), (3, 2, 100, None), (5, 1, -5, "a>0:c")]


def test_deviations(spark):
    scratch = Scratch(spark)
    edges = make(spark, F6)
    found = deviations.enumerate_paths(edges, 4, scratch, buckets=True, delta=300)
    assert len(found.steps) > 1 and found.steps[-1][3] >= 4
    tree = scratch.save(suffix_tree(edges, scratch))
    arcs = scratch.save(graph.arcs(edges))
    root = deviations.roots(graph.sources(edges).withColumnRenamed("name", "v"), tree)
    children = deviations.spur(root, arcs, tree, scratch)
    # the shortest path is A B F H, of cost -4
    assert sorted((r.src, r.dst, r.cost, r.detour) for r in children.collect()) == [("A", "C", 400, 800), ("B", "G", 600, 1000), ("F", "I", 1200, 1600)]
    pruned = children.limit(1).select(F.col("parent_id").alias("node_id"), "src", "dst", "slot")
    assert deviations.spur(root, arcs, tree, scratch, pruned).count() == children.count() - 1
    assert deviations.promoted(children, 400) == children.where("cost <= 400").count()
    assert render.root_children_dump(found.nodes, edges).count() >= 1
    assert render.frontier_dump(found.nodes).columns == ["node_id", "name"]
    assert render.heap_dump(top_k_paths(edges, 2)).orderBy("rank").first()["text"] == "# Paths: 2"


def test_numbered_rows(spark):
    from pathforge.operators import order

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = order.numbered(df, ["x"], Scratch(spark)).collect()
    assert all(r["rank"] == r["x"] + 1 for r in got)


def test_compare(spark):
    one = spark.createDataFrame([(1, 5), (2, 5), (3, 8)], "rank long, cost long")
    two = spark.createDataFrame([(1, 5), (2, 7), (3, 8)], "rank long, cost long")
    assert [r.cost for r in compare.cost_difference(one, two).collect()] == [5]
    assert compare.difference_ratio(one, two).first()["ratio"] == pytest.approx(1 / 3)
    assert compare.difference_ratio(one.limit(0), two).first()["ratio"] is None
    assert tuple(compare.matching_prefix(one, two).first()) == (3, 1)
    assert compare.same_costs(one, two, 2)
    assert tuple(compare.rank_error(one, two).first()) == (3, 2, 2)
    assert compare.relative_error(one, two).first()["max_error"] == pytest.approx(2 / 7)
    assert parse("a>b:1")["a", "b"][0] == 100
