"""Numbers by window as bigint, as counts are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strataloom.session import cut_lineage


def numbered(window: WindowSpec) -> Column:
    return F.row_number().over(window).cast("bigint")


def rank_within(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """`df` with `name`: the number of each row in its group, where a group may be any share of all rows.

    Rows are sorted over all tasks by group and order, so a hot group spreads over many of them; each
    task numbers its own part, and a small table of counts by task and group gives where a part begins.
    The order must be total for the numbers to be determined.
    """
    placed = cut_lineage(df.repartitionByRange(*by, *order).withColumn("__pid", F.spark_partition_id()))
    counts = placed.groupBy(*by, "__pid").agg(F.count("*").alias("__n"))
    begins = counts.withColumn("__begin", F.sum("__n").over(Window.partitionBy(*by).orderBy("__pid")) - F.col("__n")).drop("__n")
    inside = numbered(Window.partitionBy(*by, "__pid").orderBy(*order))
    joined = placed.withColumn("__inside", inside).alias("p").join(begins.alias("b"), [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__pid"]])
    return joined.select("p.*", (F.col("p.__inside") + F.col("b.__begin")).alias(name)).drop("__inside", "__pid")
