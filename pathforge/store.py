"""Intermediate tables in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pathforge-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables of one operator's run.  A table that the result still reads stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_dir(spark)}/pathforge-{uuid.uuid4().hex}"
        self.n = 0
        self.kept: set[str] = set()

    def path(self) -> str:
        self.n += 1
        return f"{self.top}/{self.n}"

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it again: lineage ends here."""
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        self.kept.add(path)
        return out

    def counted(self, df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
        """``save`` and the number of rows (where ``what`` holds), counted as they are written."""
        seen = Observation()
        out = self.save(df.observe(seen, F.count(F.lit(1) if what is None else F.when(what, 1)).alias("n")))
        return out, seen.get["n"]

    def finish(self, df: DataFrame, *others: DataFrame) -> DataFrame:
        """Save ``df`` and delete all other tables of this run but ``others``."""
        out = self.save(df)
        for path in self.kept - {out._scratch, *(x._scratch for x in others)}:
            self.remove(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            self.remove(df._scratch)

    def remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.kept.discard(path)


def saved(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` itself if it is a saved table, else a saved copy."""
    return df if hasattr(df, "_scratch") else scratch.save(df)
