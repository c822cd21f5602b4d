"""Edits as a stream: each micro-batch is folded into the graph and a report follows.

Batches come with an id that a restart repeats, so every batch writes its version of the graph
and its report under that id, and a repeated batch writes the same again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import WEIGHTS
from ..plans.session import BUFFERS, NAMES, GraphSession


def live_reports(ops: DataFrame, start: DataFrame, folder: str, k: int, checkpoint: str, trigger: dict | None = None):
    """Start a query over a stream of edit rows; batch n leaves ``folder``/edges/n, vertices/n
    (those without edges), buffers/n and report/n as Parquet.  Returns the streaming query."""
    spark: SparkSession = start.sparkSession

    def write(df: DataFrame, what: str, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{what}/{n}")

    write(start.select("src", "dst", *WEIGHTS), "edges", -1)
    write(spark.createDataFrame([], NAMES), "vertices", -1)
    write(spark.createDataFrame([], BUFFERS), "buffers", -1)

    def step(batch: DataFrame, n: int) -> None:
        before = [spark.read.parquet(f"{folder}/{what}/{n - 1}") for what in ("edges", "vertices", "buffers")]
        session = GraphSession(*before).apply(batch.where("op <> 'report'"))
        for df, what in ((session.edges, "edges"), (session.extra, "vertices"), (session.buffers, "buffers"), (session.report(k), "report")):
            write(df, what, n)

    return ops.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
