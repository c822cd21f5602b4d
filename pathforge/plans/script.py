"""Scripts of edits and reports, run in their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import GraphSession


def run_ops(session: GraphSession, ops: DataFrame) -> DataFrame:
    """Apply ``ops`` (OPS) and answer its report rows, each after the edits before it:
    (report, rank, weight, startpoint, endpoint, path), report being its sequence number.
    A report without ``recover`` has costs only.  The driver sees the report rows alone."""
    ops = session.scratch.save(ops)
    reports = ops.where("op = 'report'").select("seq", "k", F.coalesce("recover", F.lit(False)).alias("recover")).orderBy("seq").collect()
    answers, last = [], -1
    for row in reports:
        _between(session, ops, last, row["seq"])
        found = session.report(row["k"] or 0)
        shown = [F.when(F.lit(row["recover"]), F.col(c)).alias(c) for c in ("startpoint", "endpoint", "path")]
        answers.append(session.scratch.save(found.select(F.lit(row["seq"]).cast("long").alias("report"), "rank", "weight", *shown)))
        last = row["seq"]
    _between(session, ops, last, None)
    if not answers:
        return session.spark.createDataFrame([], "report long, rank long, weight long, startpoint string, endpoint string, path string")
    return reduce(DataFrame.unionByName, answers)


def _between(session: GraphSession, ops: DataFrame, after: int, before: int | None) -> None:
    batch = ops.where((F.col("seq") > after) & (F.lit(True) if before is None else F.col("seq") < before))
    if not batch.isEmpty():
        session.apply(batch)
