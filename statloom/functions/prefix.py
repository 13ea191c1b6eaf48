"""Prefix sums and ranks over a whole column without gathering it in one task.

Rows are range-partitioned by value; each partition's total is one row, and their running sum is the only window that isn't
partitioned. Within a partition the sum runs over its own rows. The ranges come from a sample that another run may draw
otherwise, so the partitioned rows are checkpointed: totals and rows are then of the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.sources.shared import cut


def running_sum(df: DataFrame, order: str, amount: Column, name: str) -> DataFrame:
    """df (unique in order) plus the inclusive sum of amount over all rows up to order, and name_total."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.withColumn("_amount", amount).repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(F.sum("_amount").alias("_t"))
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"), F.sum("_t").over(whole).alias(f"{name}_total"))
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("_own", F.sum("_amount").over(own)).join(totals, "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_amount", "_own", "_before")


def rank_values(values: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values with their rank from 0."""
    return running_sum(values, column, F.lit(1), name).select(column, (F.col(name) - 1).cast("long").alias(name))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(v double, n) of the non-null, non-NaN values."""
    v = F.col(column).cast("double")
    return df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count("*").alias("n"))


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """(v, u): the share of non-null values up to v; ties share their highest rank."""
    summed = running_sum(value_counts(df, column), "v", F.col("n"), "c")
    return summed.select("v", (F.col("c") / F.col("c_total")).alias("u"))
