"""Tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table; `folder` may hold a file or a directory of that name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
