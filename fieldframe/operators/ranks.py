"""Ranks and running sums over whole tables: rows go to tasks by ranges of the order, and only each task's total is put in line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def _dealt(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows by ranges of the order, the range's number in a column range_of; written, so that it stays the same."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *order).withColumn("range_of", F.spark_partition_id()), "ranges")


def _bases(dealt: DataFrame, size: Column) -> DataFrame:
    """(range_of, base): what lies before each range; one row a shuffle partition, so one task may sum them."""
    totals = dealt.groupBy("range_of").agg(F.sum(size).alias("held"))
    before = Window.orderBy("range_of").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("range_of", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place, from 1, in an order without ties."""
    dealt = _dealt(rows, order)
    inside = F.row_number().over(Window.partitionBy("range_of").orderBy(*order))
    return dealt.withColumn(name, inside).join(F.broadcast(_bases(dealt, F.lit(1))), "range_of").withColumn(name, (F.col("base") + F.col(name)).cast("int")).drop("range_of", "base")


def running(rows: DataFrame, order: list[Column], size: Column, begin: str, end: str) -> DataFrame:
    """rows with the sums of size before and up to them, in an order without ties."""
    dealt = _dealt(rows.withColumn("held_size", size), order)
    inside = F.sum("held_size").over(Window.partitionBy("range_of").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = dealt.withColumn(end, inside).join(F.broadcast(_bases(dealt, F.col("held_size"))), "range_of").withColumn(end, F.col("base") + F.col(end))
    return summed.withColumn(begin, F.col(end) - F.col("held_size")).drop("range_of", "base", "held_size")
