"""The corpus pipeline: documents in, packed sequences out, through five of the operators.

Each stage works on all that its predecessor kept, written as Parquet and read again, and
returns the columns of ``documents``, but for the last, which returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathforge.llm import bagminhash, binpack, decontam, quality, substring_dedup
from pathforge.llm.queries import tokenizer_file
from pathforge.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: none with a null or empty text, repeated rows alike.
    No rows, no result rows; null ids and other columns stay."""
    return quality.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id, once.  Null ids, and texts
    without words, have no copies and stay; other columns stay."""
    return bagminhash.keep_one(docs)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; one that loses nothing
    stays as it is, one that loses all its words goes.  Null texts and null ids lose nothing, and
    rows of one id nothing to each other.  Columns of ``docs`` with the names of the operator's
    own stay what they are."""
    own = {c for c in docs.columns if c.lower() in ("n_words", "n_removed", "spans", "kept_text")}
    aside = {c: f"_{i}_{c}" for i, c in enumerate(docs.columns) if c in own}
    out = substring_dedup.dedup_substrings(docs.withColumnsRenamed(aside))
    cut = F.col("n_removed") > 0
    out = out.where(~cut | (F.col("n_removed") < F.col("n_words"))).withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select([F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  Null texts and null ids hold none; repeated rows
    stay or go together; other columns stay."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences; a null text is one piece, the end alone.  Rows
    are packed each, repeated ones and null ids included; other columns are not read."""
    return binpack.pack_sequences(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_removal),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: SQL expresses neither compression nor tokenizers; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
