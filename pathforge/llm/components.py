"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum (pre-aggregated before its shuffle) and a join, so a node with
very many links costs no task more than its share, and no links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b), b < a, distinct."""
    if large:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        out = both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        out = links.join(least, links["a"] == least["k"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("b < a").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the least id of its component for every node that has a link and is not a
    root itself.  ``links`` has long columns a and b; direction, repeats, loops and nulls are fine."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.save(links)
    seen = None
    while True:
        step = scratch.save(_star(_star(now, True), False))
        sign = step.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = step
        if sign == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
