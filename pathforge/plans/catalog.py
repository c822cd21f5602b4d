"""The registered queries of the path engine and their DuckDB SQL.

Every query runs over the whole graph that the tables of a scale factor hold; a K is part of a
report query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import slots
from ..operators import compare, graph, suffix
from ..schema import OPS, WEIGHTS
from ..sources import render, tables
from ..store import Scratch
from . import deviations
from .report import top_k_costs, top_k_paths
from .script import run_ops
from .session import GraphSession

K = 100
LOW, HIGH, BUCKETS = -100_000, 1_100_000, 12
EQUAL, GEOMETRIC = slots.equal_bounds(LOW, HIGH, BUCKETS), slots.geometric_bounds(LOW, HIGH, BUCKETS)

_NONE = ", ".join(f"cast(null as bigint) as w{i}" for i in range(1, 8))
_W = ", ".join(WEIGHTS)
GEO = f"""g as (
  select 'r:' || n_regionkey as src, 'n:' || n_nationkey as dst, cast(0 as bigint) as w0, {_NONE} from nation
  union all
  select 'n:' || s_nationkey, 's:' || s_suppkey, cast(floor(s_acctbal * 100 + 0.5) as bigint), {", ".join(["null"] * 7)} from supplier)"""
_LINES = f"""lines as (
  select 'o:' || l_orderkey as src, 'p:' || l_partkey as dst, cast(floor(l_quantity + 0.5) as bigint) as w0, cast(floor(l_extendedprice + 0.5) as bigint) as w1,
    cast(floor(l_discount * 100 + 0.5) as bigint) as w2, cast(floor(l_tax * 100 + 0.5) as bigint) as w3, {", ".join(f"cast(null as bigint) as w{i}" for i in range(4, 8))},
    row_number() over (partition by l_orderkey, l_partkey order by l_linenumber desc, l_suppkey desc, l_extendedprice desc, l_shipdate desc) as nth
  from lineitem)"""
ORDERS = f"""{_LINES}, g as (
  select 'n:' || c_nationkey as src, 'c:' || c_custkey as dst, cast(floor(c_acctbal * 100 + 0.5) as bigint) as w0, {_NONE} from customer
  union all
  select 'c:' || o_custkey, 'o:' || o_orderkey, max(cast(floor(o_totalprice + 0.5) as bigint)), {", ".join(["null"] * 7)} from orders group by 1, 2
  union all
  select src, dst, {_W} from lines where nth = 1)"""
_ARCS = "arcs as (" + " union all ".join(f"select src, dst, {i} as slot, w{i} as w from g where w{i} is not null" for i in range(8)) + ")"
_ALL = """p as (
  select src as v, src as startpoint, cast(0 as bigint) as cost, cast(src as varchar) as path, src || '>' as back, [src] as verts, [cast(0 as bigint)] as dists
  from (select distinct src from g where src not in (select dst from g))
  union all
  select a.dst, p.startpoint, p.cost + a.w, p.path || '>' || a.slot || ':' || a.dst, a.dst || '>' || a.slot || ':' || p.back, list_append(p.verts, a.dst), list_append(p.dists, p.cost + a.w)
  from p join arcs a on a.src = p.v),
paths as (select * from p where v not in (select src from g))"""
_DIST = """up as (
  select distinct dst as v, cast(0 as bigint) as dist from g where dst not in (select src from g)
  union all
  select a.src, a.w + up.dist from up join arcs a on a.dst = up.v),
dists as (select v, min(dist) as dist from up group by v)"""


def _sql(graph_sql: str, body: str, *parts: str) -> str:
    return f"with recursive {', '.join([graph_sql, *parts])} {body}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(_sql(ORDERS, "select distinct src as name from g where src not in (select dst from g)"))
def sources(spark, sf_dir):
    return graph.sources(tables.orders_dag(spark, sf_dir))


@query(_sql(ORDERS, "select distinct dst as name from g where dst not in (select src from g)"))
def sinks(spark, sf_dir):
    return graph.sinks(tables.orders_dag(spark, sf_dir))


@query(_sql(ORDERS, "select name, sum(i) as fanins, sum(o) as fanouts from (select src as name, 0 as i, 1 as o from g union all select dst, 1, 0 from g) group by name"))
def degrees(spark, sf_dir):
    return graph.degrees(tables.orders_dag(spark, sf_dir)).select("name", "fanins", "fanouts")


@query(_sql(ORDERS, "select src, dst, w0 from (select *, count(*) over (partition by src) as o, count(*) over (partition by dst) as i from g) where o = 1 and i = 1"))
def chain_edges(spark, sf_dir):
    return graph.chain_edges(tables.orders_dag(spark, sf_dir)).select("src", "dst", "w0")


@query(_sql(ORDERS, "select src, dst, slot, w from arcs", _ARCS))
def arcs_expand(spark, sf_dir):
    return graph.arcs(tables.orders_dag(spark, sf_dir))


@query(_sql(ORDERS, "select src, dst, min_w, (select min(slot) from arcs a where a.src = m.src and a.dst = m.dst and a.w = min_w) as min_slot from (select src, dst, min(w) as min_w from arcs group by src, dst) m", _ARCS))
def min_weight_slot(spark, sf_dir):
    return tables.orders_dag(spark, sf_dir).select("src", "dst", slots.min_weight().alias("min_w"), slots.min_slot().alias("min_slot"))


@query(_sql(_LINES, "select src, dst, w0, w1, w2, w3 from lines where nth = 1"))
def upsert_last_writer(spark, sf_dir):
    return tables.orders_dag(spark, sf_dir).where("src like 'o:%'").select("src", "dst", "w0", "w1", "w2", "w3")


_OPS = """ops as (
  select event_id as seq, 'u:' || (user_id % 20) as src, 'h:' || extract(hour from ts) as dst,
    case when event_id % 50 = 0 then 'remove_vertex' when event_type = 'error' then 'remove_edge' else 'insert_edge' end as op, cast(floor(coalesce(value, 0) * 100 + 0.5) as bigint) as w
  from events),
put as (select src, dst, max(seq) as at, arg_max(w, seq) as w0 from ops where op = 'insert_edge' group by src, dst),
folded as (select put.src, put.dst, put.w0 from put
  left join (select src, dst, max(seq) as at from ops where op = 'remove_edge' group by src, dst) c on c.src = put.src and c.dst = put.dst
  left join (select dst, max(seq) as at from ops where op = 'remove_vertex' group by dst) v on v.dst = put.dst
  where put.at > coalesce(c.at, -1) and put.at > coalesce(v.at, -1))"""


@query(_sql(_OPS, "select * from folded"))
def edits_fold(spark, sf_dir):
    return graph.fold(tables.edit_ops(spark, sf_dir)).select("src", "dst", "w0")


def _tenth_customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 10 = 0").select(tables.named("c:", "c_custkey").alias("name"))


@query(_sql(ORDERS, "select src, dst, w0 from g where src not in (select 'c:' || c_custkey from customer where c_custkey % 10 = 0) and dst not in (select 'c:' || c_custkey from customer where c_custkey % 10 = 0)"))
def remove_vertex_cascade(spark, sf_dir):
    return graph.remove_vertices(tables.orders_dag(spark, sf_dir), _tenth_customers(spark, sf_dir)).select("src", "dst", "w0")


@query(_sql(ORDERS, "select src, dst, w0 from g where not (src like 'o:%' and w2 = 0)"))
def remove_edge_lines(spark, sf_dir):
    edges = tables.orders_dag(spark, sf_dir)
    return graph.remove_edges(edges, edges.where("src like 'o:%' and w2 = 0")).select("src", "dst", "w0")


def _geo_buffers(spark, sf_dir):
    return tables.geo(spark, sf_dir).where("src like 'n:%'").select("src", "dst", F.concat(F.lit("b:"), "dst").alias("name"))


def _tenths(x: str, n: int) -> str:
    return f"cast(sign({x}) * floor((abs({x}) * {n} + 5) / 10) as bigint)"


_HALVES = f"""halves as (
  select src, dst, w0 from g where src like 'r:%'
  union all select src, 'b:' || dst, {_tenths("w0", 4)} from g where src like 'n:%'
  union all select 'b:' || dst, dst, {_tenths("w0", 4)} from g where src like 'n:%')"""


@query(_sql(GEO, "select * from halves", _HALVES))
def insert_buffer(spark, sf_dir):
    return graph.insert_buffers(tables.geo(spark, sf_dir), _geo_buffers(spark, sf_dir)).select("src", "dst", "w0")


@query(_sql(GEO, f"select src, dst, w0 from g where src like 'r:%' union all select src, substr(dst, 3), {_tenths('w0', 25)} from halves where dst like 'b:%'", _HALVES))
def remove_buffer(spark, sf_dir):
    buffers = _geo_buffers(spark, sf_dir)
    return graph.remove_buffers(graph.insert_buffers(tables.geo(spark, sf_dir), buffers), buffers).select("src", "dst", "w0")


_BUMPED = "bumped as (select src, dst, case when src = 'n:3' or dst = 'n:3' then w0 + 5 else w0 end as w0 from g)"


def _bumped(spark, sf_dir):
    return graph.modify_vertex(tables.geo(spark, sf_dir), (F.col("src") == "n:3") | (F.col("dst") == "n:3"), 5)


@query(_sql(GEO, "select * from bumped", _BUMPED))
def modify_vertex(spark, sf_dir):
    return _bumped(spark, sf_dir).select("src", "dst", "w0")


@query(_sql(ORDERS, "select src, dst, w0 + case when row_number() over (order by src, dst) <= (select count(*) * 10 // 100 from g) then 1 else 0 end as w0 from g"))
def update_edges_percent(spark, sf_dir):
    return graph.update_percent(tables.orders_dag(spark, sf_dir), 10, 1).select("src", "dst", "w0")


@query(_sql(ORDERS, "select * from dists", _ARCS, _DIST))
def suffix_dist(spark, sf_dir):
    return suffix.suffix_tree(tables.orders_dag(spark, sf_dir), Scratch(spark)).select("v", "dist")


_LINK = """select d.v, l.dst as succ, l.slot as link_slot from dists d left join (
  select a.src, a.dst, a.slot, row_number() over (partition by a.src order by a.w + d.dist, a.dst, a.slot) as nth from arcs a join dists d on d.v = a.dst) l on l.src = d.v and nth = 1"""


@query(_sql(ORDERS, _LINK, _ARCS, _DIST))
def suffix_links(spark, sf_dir):
    return suffix.suffix_tree(tables.orders_dag(spark, sf_dir), Scratch(spark)).select("v", "succ", "link_slot")


@query(_sql(ORDERS, "select v, dist from dists where v not in (select dst from g)", _ARCS, _DIST))
def best_path_per_source(spark, sf_dir):
    edges = tables.orders_dag(spark, sf_dir)
    return suffix.suffix_tree(edges, Scratch(spark)).join(graph.sources(edges).withColumnRenamed("name", "v"), "v", "left_semi").select("v", "dist")


@query(_sql(ORDERS, "select a.src, a.dst, a.slot, a.w + e.dist - d.dist as detour from arcs a join dists d on d.v = a.src join dists e on e.v = a.dst", _ARCS, _DIST))
def deviation_costs(spark, sf_dir):
    edges = tables.orders_dag(spark, sf_dir)
    dist = suffix.suffix_tree(edges, Scratch(spark)).select("v", "dist")
    here, ahead = dist.toDF("src", "here"), dist.toDF("dst", "ahead")
    return graph.arcs(edges).join(here, "src").join(ahead, "dst").select("src", "dst", "slot", (F.col("w") + F.col("ahead") - F.col("here")).alias("detour"))


@query(_sql(ORDERS, f"select row_number() over (order by cost) as rank, cost from (select cost from paths order by cost limit {K})", _ARCS, _ALL))
def topk_costs(spark, sf_dir):
    return top_k_costs(tables.orders_dag(spark, sf_dir), K)


#: equal costs are ordered by the path's text with an end to every name
_TOP = f"select row_number() over (order by cost, path || '>') as rank, cost as weight, startpoint, v as endpoint, path, verts, dists from paths order by cost, path || '>' limit {K}"


@query(_sql(ORDERS, f"select rank, weight, startpoint, endpoint, path from ({_TOP})", _ARCS, _ALL))
def topk_paths(spark, sf_dir):
    return top_k_paths(tables.orders_dag(spark, sf_dir), K).drop("points")


@query(_sql(ORDERS, f"select rank, cast(i - 1 as integer) as pos, verts[i] as vert, dists[i] as dist from (select *, unnest(range(1, len(verts) + 1)) as i from ({_TOP}))", _ARCS, _ALL))
def path_points(spark, sf_dir):
    return render.path_rows(top_k_paths(tables.orders_dag(spark, sf_dir), K))


@query(_sql(ORDERS, "select * from (select v as endpoint, row_number() over (partition by v order by cost, back) as rank, cost as weight, path from paths) where rank <= 2", _ARCS, _ALL))
def topk_per_endpoint(spark, sf_dir):
    return top_k_paths(tables.orders_dag(spark, sf_dir), 2, scope="per_endpoint").select("endpoint", "rank", "weight", "path")


@query("select cast(0 as bigint) as rank, cast(0 as bigint) as weight where false")
def k_zero(spark, sf_dir):
    return top_k_paths(tables.geo(spark, sf_dir), 0).select("rank", "weight")


def _bucket_sql(bounds: list[float]) -> str:
    case = " ".join(f"when w < {b!r} then {i}" for i, b in enumerate(bounds))
    return _sql(ORDERS, f"select case {case} else {len(bounds)} end as bucket, count(*) as n, min(w) as least, max(w) as greatest from arcs group by 1", _ARCS)


def _buckets(spark, sf_dir, bounds):
    arcs = graph.arcs(tables.orders_dag(spark, sf_dir))
    return arcs.groupBy(slots.bucket_index(F.col("w"), bounds).alias("bucket")).agg(F.count("*").alias("n"), F.min("w").alias("least"), F.max("w").alias("greatest"))


@query(_bucket_sql(EQUAL))
def cost_buckets_equal(spark, sf_dir):
    return _buckets(spark, sf_dir, EQUAL)


@query(_bucket_sql(GEOMETRIC))
def cost_buckets_geometric(spark, sf_dir):
    return _buckets(spark, sf_dir, GEOMETRIC)


def _geo_costs(name: str, table: str) -> str:
    costs = f"select a.w0 + coalesce(b.w0, 0) as cost from {table} a left join {table} b on a.dst = b.src where a.src like 'r:%'"
    return f"{name} as (select row_number() over (order by cost) as rank, cost from ({costs}) order by cost limit {K})"


_TWO = f"{_BUMPED}, {_geo_costs('one', 'g')}, {_geo_costs('two', 'bumped')}"


def _two(spark, sf_dir):
    scratch = Scratch(spark)
    return [scratch.save(top_k_costs(e, K)) for e in (tables.geo(spark, sf_dir), _bumped(spark, sf_dir))]


@query(_sql(GEO, "select cost from one except all select cost from two", _TWO))
def cost_set_difference(spark, sf_dir):
    return compare.cost_difference(*_two(spark, sf_dir))


@query(_sql(GEO, "select count(*) as n, max(abs(one.cost - two.cost)) as max_abs, cast(sum(abs(one.cost - two.cost)) as bigint) as sum_abs from one join two using (rank)", _TWO))
def rank_error(spark, sf_dir):
    return compare.rank_error(*_two(spark, sf_dir))


@query(_sql(GEO, "select count(*) as n, coalesce(min(case when two.cost is null or one.cost <> two.cost then rank end) - 1, count(*)) as n_equal from one left join two using (rank)", _TWO))
def matching_prefix(spark, sf_dir):
    return compare.matching_prefix(*_two(spark, sf_dir))


@query(_sql(ORDERS, "select src || '->' || dst as name, concat_ws(' ', " + ", ".join(f"coalesce(cast({w} as varchar), 'n/a')" for w in WEIGHTS) + ") as weights from g"))
def edge_dump(spark, sf_dir):
    return render.edge_dump(tables.orders_dag(spark, sf_dir))


@query(_sql(GEO, "select '  \"' || src || '\" -> \"' || dst || '\" [label=\"' || w0 || '\"];' as line from g"))
def dot_lines(spark, sf_dir):
    return render.dot_lines(tables.geo(spark, sf_dir))


_CYCLE = """h as (select src, dst from g union all select distinct 's:1', src from g where src = 'r:0'),
reach as (select src, dst from h union select reach.src, h.dst from reach join h on h.src = reach.dst),
cyclic as (select src as v from reach where src = dst)"""


@query(_sql(GEO, "select distinct src, dst from h where dst in (select v from cyclic) or dst in (select src from reach where dst in (select v from cyclic))", _CYCLE))
def cycle_check(spark, sf_dir):
    edges = tables.geo(spark, sf_dir).select("src", "dst")
    back = edges.where("src = 'r:0'").select(F.lit("s:1").alias("src"), F.col("src").alias("dst")).distinct()
    return graph.peel(edges.unionByName(back), Scratch(spark))


@query(_sql(ORDERS, "select v from up", "up as (select distinct dst as v from g where src like 'o:%' and w2 = 0 union select g.src from up join g on g.dst = up.v)"))
def affected_region(spark, sf_dir):
    edges = tables.orders_dag(spark, sf_dir)
    return suffix.ancestors(edges, edges.where("src like 'o:%' and w2 = 0").select(F.col("dst").alias("v")), Scratch(spark))


_EDITED = f"""g as (select src, dst, case when src like 'o:%' then w0 + 7 else w0 end as w0, {_W.removeprefix("w0, ")} from base
  where src not in (select 'c:' || c_custkey from customer where c_custkey % 10 = 0) and dst not in (select 'c:' || c_custkey from customer where c_custkey % 10 = 0))"""


_BASE = ORDERS.replace(", g as (", ", base as (")


@query(_sql(_BASE, f"select rank, weight, path from ({_TOP})", _EDITED, _ARCS, _ALL))
def incremental_topk(spark, sf_dir):
    session = GraphSession(tables.orders_dag(spark, sf_dir))
    session.distances()
    session.remove_vertices(_tenth_customers(spark, sf_dir))
    lines = session.edges.where("src like 'o:%'")
    session.insert_edges(lines.withColumn("w0", F.col("w0") + 7))
    return session.report(K).select("rank", "weight", "path")


def few_edits(session: GraphSession) -> GraphSession:
    """Every 500th customer goes, and the lines of every 100th order get dearer."""
    names = session.vertices().where("name rlike '^c:[0-9]*(000|500)$'")
    session.remove_vertices(names)
    lines = session.edges.where("src rlike '^o:[0-9]*00$'")
    return session.insert_edges(lines.withColumn("w0", F.col("w0") + 7))


_FEW = f"""cut as (select 'c:' || c_custkey as name from customer where c_custkey % 500 = 0),
g as (select src, dst, case when src like 'o:%00' then w0 + 7 else w0 end as w0, {_W.removeprefix("w0, ")} from base where src not in (select name from cut) and dst not in (select name from cut))"""


@query(_sql(_BASE, f"select rank, weight, path from ({_TOP})", _FEW, _ARCS, _ALL))
def incremental_few_edits(spark, sf_dir):
    session = GraphSession(tables.orders_dag(spark, sf_dir))
    session.report(K)
    return few_edits(session).report(K).select("rank", "weight", "path")


@query(_sql(ORDERS, f"select row_number() over (order by cost) as rank, cost from (select cost from paths order by cost limit {K})", _ARCS, _ALL))
def topk_costs_deviations(spark, sf_dir):
    return top_k_costs(tables.orders_dag(spark, sf_dir), K, strategy="deviations")


@query(_sql(ORDERS, f"select row_number() over (order by cost) as rank, cost from (select cost from paths order by cost limit {K})", _ARCS, _ALL))
def topk_costs_buckets(spark, sf_dir):
    return top_k_costs(tables.orders_dag(spark, sf_dir), K, strategy="buckets", delta=1000)


@query(_sql(ORDERS, "select dist as bound from dists where v not in (select dst from g) order by dist limit 1 offset (select count(*) * 5 // 1000 from dists where v not in (select dst from g))", _ARCS, _DIST))
def source_cost_bound(spark, sf_dir):
    edges, scratch = tables.orders_dag(spark, sf_dir), Scratch(spark)
    found = suffix.suffix_tree(edges, scratch).join(graph.sources(edges).withColumnRenamed("name", "v"), "v", "left_semi")
    return spark.createDataFrame([(deviations.cost_bound(found),)], "bound long")


_SUPPLIERS = "select 's:' || s_suppkey from supplier where s_suppkey % 3 = 0"


@query(_sql(GEO, f"""select count(*) as num_verts, (select count(*) from g where src not in (select 'n:' || n_nationkey from nation where n_nationkey % 5 = 0) and dst not in (select 'n:' || n_nationkey from nation where n_nationkey % 5 = 0)) as num_edges
  from (select src as v from g union select dst from g union select 'new:1' union select 'new:2') where v not in (select 'n:' || n_nationkey from nation where n_nationkey % 5 = 0)"""))
def vertex_ddl(spark, sf_dir):
    session = GraphSession(tables.geo(spark, sf_dir)).insert_vertices(spark.createDataFrame([("new:1",), ("new:2",), ("new:1",)], "name string"))
    session.remove_vertices(spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 5 = 0").select(tables.named("n:", "n_nationkey").alias("name")))
    return spark.createDataFrame([session.counts()], "num_verts long, num_edges long")


_DANGLING = f"""h as (select src, dst, w0 from g where dst not in ({_SUPPLIERS})),
found as (select a.src || '>0:' || a.dst || coalesce('>0:' || b.dst, '') as path, a.w0 + coalesce(b.w0, 0) as weight from h a left join h b on b.src = a.dst where a.src like 'r:%'
  union all select 's:' || s_suppkey, 0 from supplier where s_suppkey % 3 = 0)"""


@query(_sql(GEO, f"select row_number() over (order by weight, path || '>') as rank, weight, path from found order by weight, path || '>' limit {K}", _DANGLING))
def dangling_paths(spark, sf_dir):
    edges = tables.geo(spark, sf_dir)
    session = GraphSession(edges).remove_edges(edges.where("src like 'n:%' and cast(substr(dst, 3) as long) % 3 = 0"))
    return session.report(K, min_points=1).select("rank", "weight", "path")


@query(_sql(GEO, f"select src, dst, w0 from g where src like 'r:%' union all select src, substr(dst, 3), {_tenths('w0', 25)} from halves where dst like 'b:%'", _HALVES))
def buffer_across_batches(spark, sf_dir):
    buffers = _geo_buffers(spark, sf_dir)
    nil = [F.lit(None).cast("long").alias(w) for w in WEIGHTS]
    seq = F.monotonically_increasing_id().alias("seq")
    put = buffers.select(seq, F.lit("insert_buffer").alias("op"), "src", "dst", "name", *nil)
    cut = buffers.select(seq, F.lit("remove_buffer").alias("op"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), "name", *nil)
    return GraphSession(tables.geo(spark, sf_dir)).apply(put).apply(cut).edges.select("src", "dst", "w0")


_SCRIPT = [f"a{i} as (select w0 from g where src like 'n:%' and cast(substr(dst, 3) as bigint) % 2 < {i})" for i in (1, 2)]


@query(_sql(GEO, "select cast(report as bigint) as report, row_number() over (partition by report order by weight) as rank, weight from (" + " union all ".join(f"(select {i} as report, w0 as weight from a{i} order by w0 limit 20)" for i in (1, 2)) + ")", *_SCRIPT))
def ops_script(spark, sf_dir):
    """Suppliers' edges go in in two batches, each with a report behind it."""
    edges = tables.geo(spark, sf_dir).where("src like 'n:%'")
    late = F.col("dst").substr(3, 30).cast("long") % 2 == 1
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in OPS}
    rows = edges.select(F.when(late, 10**12).otherwise(0).alias("late"), F.lit("insert_edge").alias("op"), "src", "dst", none["name"], *WEIGHTS, none["k"], none["save"], none["recover"])
    seq = (F.col("late") + F.monotonically_increasing_id() % 10**11).alias("seq")
    rows = rows.coalesce(1).select(seq, *[f.name for f in OPS if f.name != "seq"])
    report = lambda at: spark.range(1).select(F.lit(at).cast("long").alias("seq"), F.lit("report").alias("op"), *[none[f.name] if f.name != "k" else F.lit(20).alias("k") for f in OPS if f.name not in ("seq", "op")])
    found = run_ops(GraphSession(edges.limit(0)), rows.unionByName(report(10**11)).unionByName(report(2 * 10**12)))
    return found.select(F.when(F.col("report") == 10**11, 1).otherwise(2).cast("long").alias("report"), "rank", "weight")


@query(_sql(ORDERS, "select (select count(*) from (select src from g union select dst from g)) as num_verts, (select count(*) from g) as num_edges, (select count(*) from arcs) as num_arcs", _ARCS))
def graph_counts(spark, sf_dir):
    return graph.counts(tables.orders_dag(spark, sf_dir))


@query(
    """select event_id as v, sum(case when nth = 1 then 0 else w end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as dist
    from (select *, cast(floor(coalesce(value, 0) * 100 + 0.5) as bigint) as w, row_number() over (partition by user_id order by ts, event_id) as nth from events)"""
)
def chain_running_dist(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    edges = tables.user_chains(spark, sf_dir).select(F.substring("dst", 3, 30).cast("long").alias("event_id"), "w0")
    points = events.select("user_id", "ts", "event_id").join(edges, "event_id", "left").withColumn("w", F.coalesce("w0", F.lit(0).cast("long")))
    return points.select(F.col("event_id").alias("v"), graph.running_sum(points, "user_id", ["ts", "event_id"], "w").alias("dist"))
