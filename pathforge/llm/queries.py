"""Queries op1 to op10: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, binpack, decontam, fst_tokens, htmltext, kdshard, quality, rnnlm, sql, substring_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_fst_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst_tokens.token_table(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.page_records(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_rnn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnnlm.score_texts(_table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_texts(_table(spark, sf_dir, "pages"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshard.kd_shards(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_sequences(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_fst_token_counts": op4_fst_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_warc_archives": op6_warc_archives,
    "op7_rnn_scores": op7_rnn_scores,
    "op8_html_text": op8_html_text,
    "op9_kd_sharding": op9_kd_sharding,
    "op10_best_fit_packing": op10_best_fit_packing,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL = {"op3_substring_dedup": sql.SUBSTRINGS, "op5_decontamination": sql.CONTAINED, "op6_warc_archives": sql.RECORDS}
