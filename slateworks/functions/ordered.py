"""Sums that run over a whole table in order, without putting the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slateworks.functions.scratch import written


def running_sums(df: DataFrame, by: str, values: list[str], descending: bool = True) -> DataFrame:
    """df with run_<value>: the sum of value over all rows up to this one in the order of by, whose values are distinct.

    Rows are sorted by ranges; each range runs on its own, on top of the sums of the ranges before it, of which there are as
    many as partitions.
    """
    order = F.desc(by) if descending else F.asc(by)
    ranged = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "ranged")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*(F.sum(v).alias(f"_sum_{v}") for v in values))
    before = totals.select("_part", *(F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *(F.sum(v).over(within).alias(f"_local_{v}") for v in values))
    return local.join(F.broadcast(before), "_part").select(*df.columns, *((F.col(f"_local_{v}") + F.col(f"_before_{v}")).alias(f"run_{v}") for v in values))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with name: the place of each row from 1 in an order over the whole table; ranges number on their own, after those before."""
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as there are partitions.
    before = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_at", at).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))
