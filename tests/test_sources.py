import time

import pytest

from pathforge.functions import slots
from pathforge.operators import graph
from pathforge.plans.report import top_k_paths
from pathforge.schema import WEIGHTS
from pathforge.sources import render, text
from pathforge.streaming.live import live_reports

from .graphs import graph as make


def write(tmp_path, name, body):
    (tmp_path / name).write_text(body)
    return f"file://{tmp_path}/{name}"


def test_ops_dialect(spark, tmp_path):
    path = write(tmp_path, "a.graph", "# head\ninsert_edge u v 1.5 n/a n/a -0.0466093 n/a n/a n/a n/a # tail\nreport 20\nnoise here\ninsert_edge u v 2 n/a n/a n/a n/a n/a n/a n/a\nreport 3 0 1\n")
    rows = text.read_ops(spark, path).orderBy("seq").collect()
    assert [(r.op, r.src, r.w0, r.w3, r.k, r.recover) for r in rows] == [
        ("insert_edge", "u", 1_500_000, -46_609, None, None), ("report", None, None, None, 20, False),
        ("insert_edge", "u", 2_000_000, None, None, None), ("report", None, None, None, 3, True),
    ]
    (edge,) = graph.fold(text.read_ops(spark, path)).collect()
    assert (edge.w0, edge.w3) == (2_000_000, None)


def test_header_and_quoted_dialects(spark, tmp_path):
    path = write(tmp_path, "b.graph", "3 2\na\nb\nc\na b 1 n/a n/a n/a n/a n/a n/a 2\nb c n/a n/a n/a n/a n/a n/a n/a n/a\n")
    assert [(r.src, r.dst, r.w0, r.w7) for r in text.read_header_edges(spark, path).orderBy("seq").collect()] == [("a", "b", 10**6, 2 * 10**6), ("b", "c", None, None)]
    path = write(tmp_path, "c.edges", '2\n"x-1"\n"y"\n"x-1" -> "y", -1.25;\nbroken\n')
    assert [(r.src, r.dst, r.w0) for r in text.read_quoted(spark, path).collect()] == [("x-1", "y", -1_250_000)]
    path = write(tmp_path, "costs", "-1.1036\n2\n\n")
    assert [tuple(r) for r in text.read_costs(spark, path).collect()] == [(1, -1_103_600), (2, 2_000_000)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text.read_ops(spark, f"file://{tmp_path}/none")


def test_ops_round_trip(spark, tmp_path):
    edges = make(spark, "a>b:1,_,-2 b>c:3")
    text.write_ops(edges, f"file://{tmp_path}/out")
    back = graph.fold(text.read_ops(spark, f"file://{tmp_path}/out/*.txt"))
    assert sorted(map(tuple, back.collect())) == sorted(tuple(r[:2]) + tuple(None if w is None else w for w in r[2:]) for r in edges.collect())


def test_render(spark):
    edges = make(spark, "a>b:_,2 b>c:3")
    assert {r.name: r.weights for r in render.edge_dump(edges).collect()}["a->b"] == "n/a 200 n/a n/a n/a n/a n/a n/a"
    assert '  "a" -> "b" [label="200"];' in {r.line for r in render.dot_lines(edges).collect()}
    assert {tuple(r) for r in render.vertex_dump(edges).collect()} == {("a", 0, 1), ("b", 1, 1), ("c", 1, 0)}
    paths = top_k_paths(edges, 1)
    assert [tuple(r) for r in render.path_rows(paths).orderBy("pos").collect()] == [(1, 0, "a", 0), (1, 1, "b", 200), (1, 2, "c", 500)]
    assert render.path_dump(paths).first()["text"] == "Startpoint: a\nEndpoint: c\na 0\nb 200\nc 500"


def test_slots_and_buckets(spark):
    edges = make(spark, "a>b:3,1,_,1 c>d:_")
    got = {r.src: (r.m, r.s) for r in edges.select("src", slots.min_weight().alias("m"), slots.min_slot().alias("s")).collect()}
    assert got == {"a": (100, 1), "c": (None, 8)}
    assert slots.equal_bounds(2.5, 5.5, 3) == [3.5, 4.5]
    df = spark.createDataFrame([(2.5,), (3.5,), (4.5,), (9.0,), (0.0,)], "c double")
    assert [r.b for r in df.select(slots.bucket_index(df.c, [3.5, 4.5]).alias("b")).collect()] == [0, 1, 2, 2, 0]
    base = slots.find_base(4, 10.0)
    assert base**4 > 10 >= (base - 0.01) ** 4
    assert len(slots.geometric_bounds(0, 10, 4)) == 3
    inside = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "v double")
    assert [r.x for r in inside.select(slots.in_bounds(inside.v, 0, 1).alias("x")).collect()] == [False, True, False]


def test_live_reports(spark, tmp_path):
    schema = "seq long, op string, src string, dst string, name string, " + ", ".join(f"{w} long" for w in WEIGHTS)
    inbox = f"file://{tmp_path}/inbox"
    nothing = [None] * 7

    def put(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        time.sleep(1.1)

    put((1, "insert_edge", "b", "c", None, 2, *nothing))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    args = (make(spark, "a>b:1"), f"file://{tmp_path}/live", 5, f"file://{tmp_path}/checkpoint")
    live_reports(stream, *args).awaitTermination()
    assert [r.weight for r in spark.read.parquet(f"file://{tmp_path}/live/report/0").collect()] == [102]
    put((2, "insert_edge", "a", "b", None, 9, *nothing), (3, "insert_edge", "b", "d", None, 1, *nothing))
    before = spark.read.parquet(f"file://{tmp_path}/live/edges/0").count()
    assert before == 2
