"""Sharding by k-d tree partitioning, in DataFrame operations.

A node holds so many shards and all rows of a box in metadata space.  It is split along its
widest dimension (range over the corpus's range) where the left part's bytes have the share
of its shards, and so on until each leaf is one shard.  With equal shares of bytes this is
the weighted median; an odd node splits by its shards, so any shard count works.

Weighted medians are found on all nodes of a level at once by histograms: sums of bytes per
(node, bin), at most ``BINS`` bins a node, refined within the bin that holds the cut until
that bin's bytes no longer matter or it is one value.  Only these sums reach the driver, at
most shards x BINS rows whatever the input.  Dimensions are functions of the text and end in
its CRC, so equal texts share a point: a cut moves to the side of such a group if that costs
less than ``SLACK`` of a shard, else the group is split by hash of the id, so that a group of
copies larger than a shard can't unbalance the shards.

Slots number a shard's rows without gaps: rows are numbered within hash buckets of bounded
size and the buckets' counts are summed up before them.

Null text: no bytes.  Null ids and repeated rows are rows like others.  An empty table gives
an empty result; fewer rows than shards leave shards empty.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SHARDS = 40
EXTRA_BYTES = 16
BINS = 2048
LEVELS = 1 << 20  # steps of a dimension
FINE = 0.0005  # of a shard's bytes: a cut's bin need not be refined below this
SLACK = 0.02  # of a shard's bytes: what keeping copies together may cost
BUCKET_ROWS = 8192


def text_dimensions(text: Column) -> dict[str, Column]:
    """Metadata of a text that do not follow its size, so that each part mixes sizes: its
    script, and the mean length of its lines and of its words."""
    text = F.coalesce(text, F.lit(""))
    n_bytes, n_chars = F.octet_length(text), F.length(text)
    lines = n_chars - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    gaps = n_chars - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    return {"wide": (n_bytes - n_chars) / (n_bytes + 1), "line": F.log2(n_chars / lines + 1), "word": F.log2(n_chars / gaps + 1)}


@dataclass
class Node:
    first: int  # its first shard, which names it
    shards: int
    dim: int = 0
    lo: int = 0  # the cut lies in [lo, hi]
    hi: int = 0
    below: int = 0  # bytes below lo
    goal: float = 0.0
    at: int = 0  # bytes at the cut, if it is one value
    tie: int = 0  # rows at the cut with a hash below this go left
    done: bool = False

    @property
    def left(self) -> int:
        return self.shards // 2


def _of_node(shards: int, values: dict[int, int], default: int) -> Column:
    """A number by node, from a literal array with a place for each shard."""
    return F.get(F.expr("array(" + ", ".join(f"{int(values.get(i, default))}L" for i in range(shards)) + ")"), F.col("node"))


def _refine(rows: DataFrame, nodes: list[Node], shards: int, key: Column, shard_bytes: float) -> None:
    """Narrow each node's [lo, hi] to the value where its bytes reach the goal."""
    while todo := [n for n in nodes if not n.done]:
        steps = {n.first: max(1, -(-(n.hi - n.lo + 1) // BINS)) for n in todo}
        lo, hi = (_of_node(shards, {n.first: getattr(n, end) for n in todo}, none) for end, none in (("lo", 1), ("hi", 0)))
        inside = rows.select("node", "size", key.alias("key"), lo.alias("lo"), hi.alias("hi"), _of_node(shards, steps, 1).alias("step")).where("key >= lo and key <= hi")
        bins = inside.groupBy("node", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("size").alias("bytes"))
        found: dict[int, list] = {}
        for r in bins.collect():  # at most BINS rows a node
            found.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
        for n in todo:
            step, total = steps[n.first], n.below
            for b, size in sorted(found.get(n.first, [])):
                if total + size > n.goal:
                    n.lo, n.hi, n.below = n.lo + b * step, min(n.hi, n.lo + (b + 1) * step - 1), total
                    if step == 1 or size <= FINE * shard_bytes:
                        n.done, n.at = True, size if step == 1 else 0
                    break
                total += size
            else:  # nothing passes the goal
                n.lo, n.below, n.at, n.done = n.hi + 1, total, 0, True


def kd_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    text = F.col(text_col).cast("string")
    dims = dimensions or text_dimensions(text)
    n_dims = len(dims)
    flat = scratch.save(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + EXTRA_BYTES).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long")), 12).alias("h"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(dims.values())],
        )
    )
    span = flat.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *[f(f"x{i}").alias(f"{k}{i}") for i in range(n_dims) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    total = span["bytes"] or 0
    shard_bytes = total / shards

    def level(i: int) -> Column:
        lo, hi = span[f"lo{i}"] or 0.0, span[f"hi{i}"] or 0.0
        return F.coalesce(F.floor((F.col(f"x{i}") - lo) / ((hi - lo) or 1.0) * (LEVELS - 1)), F.lit(0)).cast("long")

    # each dimension's step above the text's CRC; last, the CRC alone
    points = [F.shiftleft(level(i), 32).bitwiseOR(F.col("text_crc32")) for i in range(n_dims)] + [F.col("text_crc32")]
    names = ["doc_id", "size", "text_crc32", "h", *[f"p{i}" for i in range(n_dims + 1)]]
    rows = flat.select("doc_id", "size", "text_crc32", "h", *[p.alias(f"p{i}") for i, p in enumerate(points)], F.lit(0).alias("node"))
    nodes = [Node(0, shards)] if total else []
    while nodes := [n for n in nodes if n.shards > 1]:
        box = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(f"p{i}").alias(f"{k}{i}") for i in range(n_dims + 1) for k, f in (("lo", F.min), ("hi", F.max))])
        boxes = {r["node"]: r for r in box.collect()}  # a row a node
        nodes = [n for n in nodes if n.first in boxes]
        for n in nodes:
            r = boxes[n.first]
            widths = [(r[f"hi{i}"] >> 32) - (r[f"lo{i}"] >> 32) for i in range(n_dims)]
            n.dim = max(range(n_dims), key=lambda i: (widths[i], -i)) if max(widths) else n_dims
            n.lo, n.hi, n.goal = r[f"lo{n.dim}"], r[f"hi{n.dim}"], r["bytes"] * n.left / n.shards
        dim = _of_node(shards, {n.first: n.dim for n in nodes}, 0).cast("int")
        key = F.get(F.array(*[F.col(f"p{i}") for i in range(n_dims + 1)]), dim)
        _refine(rows, nodes, shards, key, shard_bytes)
        cuts = {n.first: n.lo for n in nodes}
        heavy = []
        for n in nodes:  # the group at the cut goes to one side, or is split if that costs too much
            if min(n.goal - n.below, n.below + n.at - n.goal) > SLACK * shard_bytes:
                n.lo, n.hi, n.done = 0, (1 << 52) - 1, False
                heavy.append(n)
            elif n.at and n.below + n.at - n.goal < n.goal - n.below:
                n.tie = 1 << 52
        if heavy:
            group = _of_node(shards, {n.first: cuts[n.first] for n in heavy}, -1)
            _refine(rows.where(key == group), heavy, shards, F.col("h"), shard_bytes)
            for n in heavy:
                n.tie = n.lo
        cut, tie = _of_node(shards, cuts, -1), _of_node(shards, {n.first: n.tie for n in nodes}, 0)
        right = (cut >= 0) & ((key > cut) | ((key == cut) & (F.col("h") >= tie)))
        after = _of_node(shards, {n.first: n.first + n.left for n in nodes}, 0).cast("int")
        old, rows = rows, scratch.save(rows.select(*names, F.when(right, after).otherwise(F.col("node")).alias("node")))
        if hasattr(old, "_scratch"):
            scratch.drop(old)
        nodes = [x for n in nodes for x in (Node(n.first, n.left), Node(n.first + n.left, n.shards - n.left))]

    n_buckets = max(1, -(-span["n"] // (shards * BUCKET_ROWS)))
    placed = scratch.save(rows.select("doc_id", "size", "text_crc32", "h", F.col("node").alias("shard"), F.pmod(F.col("h"), F.lit(n_buckets)).alias("bucket")))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "text_crc32", "size")
    numbered = placed.withColumn("i", F.row_number().over(inner)).join(counts, ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("i") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
