"""Measures of retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gold_ranks(results: DataFrame, gold: DataFrame, item: str) -> DataFrame:
    """query and rank of the first gold item among the results; null for a miss. gold: query, item."""
    hit = results.join(gold, ["query", item]).groupBy("query").agg(F.min("rank").alias("rank"))
    return gold.select("query").distinct().join(hit, "query", "left")


def rank_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: n, hit_at_k for each k, mrr."""
    hits = [F.round(F.avg((F.coalesce(F.col("rank"), F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"hit_at_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("n"), *hits, F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def expected_found(results: DataFrame, expected: DataFrame, item: str) -> DataFrame:
    """query, n_expected, n_found, any_found, all_found."""
    found = expected.join(results.select("query", item).distinct().withColumn("hit", F.lit(1)), ["query", item], "left")
    return found.groupBy("query").agg(F.count("*").alias("n_expected"), F.count("hit").alias("n_found")).withColumns({"any_found": F.col("n_found") > 0, "all_found": F.col("n_found") == F.col("n_expected")})
