"""The series of events as a stream: daily sums by type, late rows waited for, closed days written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path


def daily(stream: DataFrame, delay: str) -> DataFrame:
    """(day, event_type, n, cents) of a stream (ts, event_type, value); a day closes `delay` after its end in event time.

    day counts from 1970-01-01. Times without a zone are read as UTC, whatever the session's zone.
    """
    utc = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)))")
    timed = stream.withColumn("ts", utc).withWatermark("ts", delay)
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    sums = timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), cents)
    return sums.select(F.expr("unix_seconds(window.start) div 86400").alias("day"), "event_type", "n", "cents")


def drained(spark: SparkSession, source: str, delay: str = "2 days") -> DataFrame:
    """Runs `daily` over all Parquet files that match source and gives the closed days as a table."""
    schema = spark.read.parquet(source).schema
    out, state = new_path(spark, "daily"), new_path(spark, "daily-state")
    made = daily(spark.readStream.schema(schema).parquet(source), delay)
    run = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)
