"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = os.environ.get("BENCH_QUERIES", "arcs_expand,degrees,upsert_last_writer,suffix_dist,deviation_costs,topk_costs,topk_paths,topk_per_endpoint,incremental_topk").split(",")
COUNTS = [10, 1_000, 100_000]  # K of the sweep


def main() -> None:
    from pyspark.sql import SparkSession

    from pathforge.plans import catalog
    from pathforge.plans.report import top_k_costs, top_k_paths
    from pathforge.plans.session import GraphSession
    from pathforge.sources import tables

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/orders.parquet").groupBy("o_custkey").count().write.format("noop").mode("overwrite").save()  # start-up is not timed
    took: dict[str, float] = {}

    def timed(name, make):
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(f"{name}: {took[name]} s", file=sys.stderr)

    for name in QUERIES:
        timed(name, lambda name=name: catalog.QUERIES[name](spark, SF_DIR))
    for k in COUNTS:
        timed(f"topk_costs_{k}", lambda k=k: top_k_costs(tables.orders_dag(spark, SF_DIR), k))
    # a report after a few edits, beside one of the same graph from scratch
    session = GraphSession(tables.orders_dag(spark, SF_DIR))
    session.report(100).write.format("noop").mode("overwrite").save()
    catalog.few_edits(session)
    timed("report_after_edits", lambda: session.report(100))
    timed("report_anew", lambda: top_k_paths(session.edges, 100))
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
