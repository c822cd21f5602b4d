"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame operations.

The question is containment, not resemblance: which test items have a share of at least
``THRESHOLD`` of their distinct five-word shingles inside a document of any length?  A sketch
of the document would drown a short item, so only items are sketched: by size they fall into
partitions (h, 2h], and an item's sketch is its k least shingle hashes (bottom-k MinHash),
where k = floor((1 - THRESHOLD) * 2h) + 1 exceeds what an item of that partition can lack.
So every document that contains an item holds at least one hash of its sketch, and no link is
lost; documents probe the sketches with each of their distinct shingles.  Candidates are
verified by counting the item's shingles, as text, in the document.

Sketches and items are broadcast up to ``SMALL_ROWS`` rows and ``SMALL_BYTES`` of shingles,
counted beforehand; beyond that the joins shuffle.  So it is with the candidates that go back to the documents.

Null text: no shingles.  An item of fewer than five words has none either and is not searched
for; nor is one with a null id.  Documents with a null id are left out.  Repeated rows of an
item or document, and several texts under one id, give one row, the greatest containment.
Empty tables give an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

SHINGLE = 5
THRESHOLD = 0.8
SMALL_ROWS, SMALL_BYTES = 1_000_000, 64 << 20
BLANK = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; null: empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _windows(w: str, of) -> Column:
    starts = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, of))


def shingle_hashes(w: str) -> Column:
    """The distinct 64-bit hashes of an array column's windows."""
    return _windows(w, lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(SHINGLE)]))


def shingles(w: str) -> Column:
    """The distinct windows of an array column as text; words hold no space."""
    return _windows(w, lambda i: F.concat_ws(" ", F.slice(F.col(w), i + 1, F.lit(SHINGLE))))


def _small(df: DataFrame, n_bytes: Column | None = None) -> DataFrame:
    """Broadcast what is counted and small, in rows and, where rows have texts, in bytes."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(n_bytes), F.lit(0)) if n_bytes is not None else F.lit(0)).first()
    return F.broadcast(df) if n <= SMALL_ROWS and size <= SMALL_BYTES else df


def sketches(items: DataFrame) -> DataFrame:
    """(h, item_key) for items (item_key, w): each item's k least hashes, k by its size class."""
    sized = items.select("item_key", F.array_sort(shingle_hashes("w")).alias("hs"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hs"))))  # the partition's greatest size
    k = (F.floor((1 - THRESHOLD) * upper + 1e-9) + 1).cast("int")
    return sized.where(F.size("hs") > 0).select("item_key", F.explode(F.slice("hs", F.lit(1), F.least(k, F.size("hs")))).alias("h"))


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of each document and test item that it contains."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    items = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    items = items.where("item_id is not null").distinct().select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", words(F.col("text")).alias("w"))
    items = scratch.save(items)
    table = scratch.save(sketches(items))
    probes = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(shingle_hashes("w")).alias("h"))
    found = scratch.save(probes.join(_small(table), "h").select("doc_id", "item_key").distinct())
    # back to the documents: each candidate's shingles are counted as text
    near = docs.join(_small(found), "doc_id").withColumn("w", words(F.col("text")))
    wanted = items.select("item_key", "item_id", shingles("w").alias("item_shingles"))
    near = near.join(_small(wanted, F.aggregate("item_shingles", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16)), "item_key")
    shared = near.select("doc_id", "item_id", F.size("item_shingles").alias("n"), F.size(F.array_intersect("item_shingles", shingles("w"))).alias("m"))
    best = shared.where(F.col("m") >= F.lit(THRESHOLD) * F.col("n")).groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("c"), "n", "m")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n").cast("long").alias("n_shingles"), F.col("best.m").cast("long").alias("n_shared"), F.col("best.c").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no test item, with all columns."""
    scratch = Scratch(docs.sparkSession)
    name = "_gone"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    gone = scratch.save(contained_items(docs, items, id_col, text_col).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(_small(gone), docs[id_col] == F.col(name), "left_anti")
