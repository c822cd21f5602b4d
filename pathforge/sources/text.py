"""Graph text in three dialects, and cost files, as DataFrames.

Files are read in splits.  Lines are numbered through all files of a path, by file name and
place: rows of a split come in order, so a line's number is its split's, which a running sum
over the splits' counts gives, and its place there.  Edits depend on that number.  Weights
become whole numbers of 10**-SCALE; ``n/a`` is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from ..schema import OPS, SCALE, WEIGHTS
from ..store import Scratch


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, seq, line): a line's number in its file and through all files.  Lines are not
    shuffled; a split is one row of the table that numbers them."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.rtrim("value", F.lit("\r")).alias("line"))
    splits = rows.groupBy("file", "block").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    all_, own = Window.orderBy("file", "block"), Window.partitionBy("file").orderBy("block")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "block", "least", before(all_).alias("before"), before(own).alias("in_file"))
    placed = rows.join(splits, ["file", "block"]).withColumn("i", F.col("id") - F.col("least"))
    return placed.select("file", (F.col("in_file") + F.col("i")).alias("pos"), (F.col("before") + F.col("i")).alias("seq"), "line")


def weight(token: Column) -> Column:
    """A weight's text as a whole number of 10**-SCALE; n/a and a missing token are null."""
    number = F.when(token == "n/a", F.lit(None)).otherwise(token).try_cast(f"decimal(38,{SCALE + 4})")
    return F.round(number * 10**SCALE).cast("long")


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    """insert_edge, the other edit verbs, and report rows of a token file, as OPS.

    ``#`` ends a line; words that are no verb are skipped.  A report has its K alone or with
    the flags save and recover."""
    bare = F.btrim(F.regexp_replace("line", "#.*", ""))
    t = lines(spark, path).withColumn("t", F.split(bare, r"\s+")).where(F.size("t") > 0)
    verb, at = F.get("t", F.lit(0)), lambda i: F.get("t", F.lit(i))
    edge = verb.isin("insert_edge", "remove_edge")
    buffer = verb == "insert_buffer"  # insert_buffer name src dst
    named = verb.isin("insert_vertex", "remove_vertex", "insert_buffer", "remove_buffer")
    flag = lambda i: F.when(verb == "report", F.coalesce(at(i) == "1", F.lit(False)))
    known = t.where(edge | named | (verb == "report"))
    return known.select(
        "seq", verb.alias("op"), F.when(edge, at(1)).when(buffer, at(2)).alias("src"), F.when(edge, at(2)).when(buffer, at(3)).alias("dst"), F.when(named, at(1)).alias("name"),
        *[F.when(verb == "insert_edge", weight(at(3 + i))).alias(w) for i, w in enumerate(WEIGHTS)],
        F.when(verb == "report", at(1).try_cast("int")).alias("k"), flag(2).alias("save"), flag(3).alias("recover"),
    ).select([f.name for f in OPS])


def read_header_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edits from a file of ``vertices edges``, the vertices' names, then ``u v w0 .. w7`` lines."""
    t = lines(spark, path).withColumn("t", F.split(F.btrim("line"), r"\s+"))
    rows = t.where(F.size("t") >= 3)
    return _inserts(rows, F.get("t", F.lit(0)), F.get("t", F.lit(1)), [weight(F.get("t", F.lit(2 + i))) for i in range(len(WEIGHTS))])


QUOTED = r'^\s*"([^"]*)"\s*->\s*"([^"]*)"\s*,\s*([^;\s]+)\s*;'


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """Edits from ``"u" -> "v", w;`` lines behind a count n and n skipped lines.  Only what stands
    in quotes is a name, so names may hold hyphens and weights a sign; other lines are skipped."""
    all_ = lines(spark, path)
    head = all_.where("pos = 0").select("file", F.btrim("line").try_cast("long").alias("n"))
    rows = all_.join(head, "file").where(F.col("pos") > F.col("n")).where(F.col("line").rlike(QUOTED))
    part = lambda i: F.regexp_extract("line", QUOTED, i)
    return _inserts(rows, part(1), part(2), [weight(part(3)), *[F.lit(None).cast("long")] * (len(WEIGHTS) - 1)])


def _inserts(rows: DataFrame, src: Column, dst: Column, weights: list[Column]) -> DataFrame:
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in OPS}
    return rows.select("seq", F.lit("insert_edge").alias("op"), src.alias("src"), dst.alias("dst"), none["name"], *[w.alias(n) for w, n in zip(weights, WEIGHTS, strict=True)], none["k"], none["save"], none["recover"])


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """(rank, cost) of a file with a number a line."""
    rows = lines(spark, path).select("seq", weight(F.btrim("line")).alias("cost")).where("cost is not null")
    return numbered(rows, ["seq"], Scratch(spark)).select("rank", "cost")


def write_ops(edges: DataFrame, path: str) -> None:
    """Edges as insert_edge lines."""
    tokens = [F.coalesce((F.col(w) / F.lit(10**SCALE)).cast(f"decimal(38,{SCALE})").cast("string"), F.lit("n/a")) for w in WEIGHTS]
    edges.select(F.concat_ws(" ", F.lit("insert_edge"), "src", "dst", *tokens).alias("value")).write.text(path)


def write_costs(costs: DataFrame, path: str) -> None:
    """(rank, cost) as a number a line, in rank order over the files."""
    text = (F.col("cost") / F.lit(10**SCALE)).cast(f"decimal(38,{SCALE})").cast("string")
    costs.repartitionByRange("rank").sortWithinPartitions("rank").select(text.alias("value")).write.text(path)
