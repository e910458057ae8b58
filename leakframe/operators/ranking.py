"""Numbering and running totals inside groups of any size.

A plain window sends a whole group to one task.  Here rows are range-partitioned on
(keys, order), numbered inside each range, and shifted by the totals of the ranges before.
A group that holds a third of all rows is spread over a third of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakframe.session import cut_lineage


def prefix_sum(df: DataFrame, keys: list[str], order: list, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to and including the row.

    Range bounds come from a sample, so they could differ if the partitioning ran twice;
    the ranged rows are therefore checkpointed before two branches read them.
    """
    ranged = cut_lineage(
        df.withColumn("_value", value)
        .repartitionByRange(*keys, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    local = ranged.withColumn(
        "_local", F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    # one row per (range, group): at most ranges + groups rows
    totals = ranged.groupBy("_range", *keys).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")
    )
    return (
        local.join(offsets, ["_range", *keys])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .select(*df.columns, out)
    )


def number_within(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """0-based row number inside the group."""
    return prefix_sum(df, keys, order, F.lit(1).cast("bigint"), "_rank").select(
        *df.columns, (F.col("_rank") - 1).alias(out)
    )


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First n rows of each group.

    Spark limits each group inside the map tasks before the shuffle (window group limit), so a
    hot group sends at most n rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
