"""Graphs that the supplied tables hold; names carry a prefix of their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import WEIGHTS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(x: Column) -> Column:
    """The nearest whole number, halves up, by the same arithmetic in any engine."""
    return F.floor(x + F.lit(0.5)).cast("long")


def named(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _edge(src: Column, dst: Column, *weights: Column) -> list[Column]:
    full = [*weights, *[F.lit(None).cast("long")] * (len(WEIGHTS) - len(weights))]
    return [src.alias("src"), dst.alias("dst"), *[w.alias(n) for w, n in zip(full, WEIGHTS, strict=True)]]


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region to nation to supplier; suppliers cost their balance in cents, which may be negative."""
    zero = F.lit(0).cast("long")
    nations = _table(spark, sf_dir, "nation").select(*_edge(named("r:", "n_regionkey"), named("n:", "n_nationkey"), zero))
    suppliers = _table(spark, sf_dir, "supplier").select(*_edge(named("n:", "s_nationkey"), named("s:", "s_suppkey"), whole(F.col("s_acctbal") * 100)))
    return nations.unionByName(suppliers)


def orders_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation to customer to order to part; a line's quantity, price, discount and tax are four
    slots, and of lines with one order and part the last by (line, supplier, price, date) holds.
    Repeated keys are rare, so rows are dealt by number once and merged where they land, without
    a partial aggregation, before numbers become names."""
    customers = _table(spark, sf_dir, "customer").select(*_edge(named("n:", "c_nationkey"), named("c:", "c_custkey"), whole(F.col("c_acctbal") * 100)))
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").repartition("o_custkey", "o_orderkey").groupBy("o_custkey", "o_orderkey").agg(F.max(whole(F.col("o_totalprice"))).alias("w"))
    orders = orders.select(*_edge(named("c:", "o_custkey"), named("o:", "o_orderkey"), F.col("w")))
    weights = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    order = F.struct("l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate", *weights).repartition("l_orderkey", "l_partkey")
    lines = lines.groupBy("l_orderkey", "l_partkey").agg(F.max(order).alias("m")).select("l_orderkey", "l_partkey", *[F.col(f"m.{c}").alias(c) for c in weights])
    lines = lines.select(*_edge(named("o:", "l_orderkey"), named("p:", "l_partkey"), whole(F.col("l_quantity")), whole(F.col("l_extendedprice")), whole(F.col("l_discount") * 100), whole(F.col("l_tax") * 100)))
    return customers.unionByName(orders).unionByName(lines)


def user_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a chain in (ts, event_id) order; an edge costs the later one's value."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").withColumn("before", F.lag("event_id").over(order))
    return rows.where("before is not null").select(*_edge(named("e:", "before"), named("e:", "event_id"), whole(F.coalesce("value", F.lit(0.0)) * 100)))


def edit_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of a graph of users and hours, by event id: signups, clicks and views
    insert, errors remove an edge, every 50th event removes its hour's vertex."""
    hour = F.hour("ts")
    src, dst = F.concat(F.lit("u:"), F.pmod("user_id", F.lit(20)).cast("string")), F.concat(F.lit("h:"), hour.cast("string"))
    op = F.when(F.col("event_id") % 50 == 0, "remove_vertex").when(F.col("event_type") == "error", "remove_edge").otherwise("insert_edge")
    w = F.when(op == "insert_edge", whole(F.coalesce("value", F.lit(0.0)) * 100))
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), src.alias("src"), dst.alias("dst"), F.when(op == "remove_vertex", dst).alias("name"), w.alias("w0"))
    return rows.select("*", *[F.lit(None).cast("long").alias(n) for n in WEIGHTS[1:]])
