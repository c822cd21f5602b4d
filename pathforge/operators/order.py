"""Numbering and cutting rows by an order without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import Scratch

#: Up to so many rows a top-n is one merge of the tasks' own top-n.
ONE_MERGE = 200_000


def numbered(df: DataFrame, order: list[str], scratch: Scratch, name: str = "rank") -> DataFrame:
    """``df`` with a row's place in the order, from 1.  Rows are dealt over ranges of the order;
    the driver sees a count a range, so no task numbers more than its range."""
    dealt = scratch.save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    offsets = F.create_map(*[F.lit(x).cast("long") for pair in before for x in pair])
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    return dealt.withColumn(name, place + offsets[F.col("_part").cast("long")]).drop("_part")


def first_rows(df: DataFrame, n: int, order: list[str], scratch: Scratch) -> DataFrame:
    """The first ``n`` rows by the order, which must leave no ties."""
    if n <= ONE_MERGE:
        return df.orderBy(*order).limit(n)
    return numbered(df, order, scratch, "_nth").where(F.col("_nth") <= n).drop("_nth")
