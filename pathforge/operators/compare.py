"""Comparison of cost lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cost_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """(cost): the multiset difference of the costs."""
    return one.select("cost").exceptAll(two.select("cost"))


def difference_ratio(one: DataFrame, two: DataFrame) -> DataFrame:
    """(n_diff, n, ratio): the difference's share of the first list; null if that is empty."""
    n = one.agg(F.count("*").alias("n"))
    diff = cost_difference(one, two).agg(F.count("*").alias("n_diff"))
    return diff.crossJoin(n).select("n_diff", "n", (F.col("n_diff") / F.nullif("n", F.lit(0))).alias("ratio"))  # one row each


def matching_prefix(one: DataFrame, two: DataFrame, tolerance: int = 0) -> DataFrame:
    """(n, n_equal): how many first ranks of ``one`` have a cost of ``two`` within tolerance."""
    both = one.select("rank", F.col("cost").alias("c")).join(two.select("rank", F.col("cost").alias("g")), "rank", "left")
    wrong = F.when(F.col("g").isNull() | (F.abs(F.col("c") - F.col("g")) > tolerance), F.col("rank"))
    return both.agg(F.count("*").alias("n"), F.coalesce(F.min(wrong) - 1, F.count("*")).alias("n_equal"))


def same_costs(one: DataFrame, two: DataFrame, tolerance: int = 0) -> bool:
    """Do the lists agree rank by rank over the length of the first?"""
    r = matching_prefix(one, two, tolerance).first()
    return r["n"] == r["n_equal"]


def rank_error(one: DataFrame, golden: DataFrame) -> DataFrame:
    """(n, max_abs, sum_abs) of the costs' differences by rank, in whole units."""
    both = one.select("rank", F.col("cost").alias("c")).join(golden.select("rank", F.col("cost").alias("g")), "rank")
    gap = F.abs(F.col("c") - F.col("g"))
    return both.agg(F.count("*").alias("n"), F.max(gap).alias("max_abs"), F.sum(gap).alias("sum_abs"))


def relative_error(one: DataFrame, golden: DataFrame) -> DataFrame:
    """(avg_error, max_error) of |c - g| / |g| by rank; ranks whose golden cost is 0 are left out."""
    both = one.select("rank", F.col("cost").alias("c")).join(golden.select("rank", F.col("cost").alias("g")), "rank").where("g <> 0")
    e = F.abs(F.col("c") - F.col("g")) / F.abs("g")
    return both.agg(F.avg(e).alias("avg_error"), F.max(e).alias("max_error"))
