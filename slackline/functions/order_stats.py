"""Exact order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: str, value: str) -> DataFrame:
    """df with rank (from 0 by value within the group) and size of the group.

    The rows are range-partitioned by group and value, ranked within their part, and moved on by the counts
    of the parts before, so a group of any share of the rows is spread over many tasks.
    """
    parts = df.repartitionByRange(group, value).withColumn("_part", F.spark_partition_id())
    counts = parts.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part")
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("_n").over(Window.partitionBy(group)))
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(value)) - 1
    rows = parts.withColumn("_own", own).join(offsets.drop("_n"), [group, "_part"])
    return rows.withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")


def index_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each group n and the elements at int(p * (n - 1)) of its sorted values."""
    at = {name: F.floor(p * (F.col("size") - 1)) for name, p in shares.items()}
    return ranked(df.select(group, value), group, value).groupBy(group).agg(F.max("size").alias("n"), F.avg(value).alias("mean"), *[F.max(F.when(F.col("rank") == k, F.col(value))).alias(name) for name, k in at.items()])
