"""Time series by key: deltas, states, crossings, protected keys, smoothing, windows, interpolation between keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(*key: str):
    return Window.partitionBy(*key).orderBy("t")


def deltas(series: DataFrame, key: str, value: str) -> DataFrame:
    return series.withColumn("delta", F.abs(F.col(value) - F.lag(value).over(by(key))))


def cutoff_state(value: Column, cutoff: float, band: float) -> Column:
    """0 below the band around the cutoff, 2 above it, 1 inside; 1 without a cutoff."""
    return F.when(F.lit(cutoff) <= 0, 1).when(value < cutoff - band, 0).when(value > cutoff + band, 2).otherwise(1)


def crossings(series: DataFrame, key: str, value: str, cutoff: float, band: float) -> DataFrame:
    """Rows whose state differs from the row before."""
    state = series.withColumn("state", cutoff_state(F.col(value), cutoff, band))
    return state.withColumn("before", F.lag("state").over(by(key))).where("before <> state")


def around(keys: DataFrame, key: str, last: int) -> DataFrame:
    """Each key time with its two neighbours inside 0..last, without repeats."""
    times = F.sequence(F.greatest(F.col("t") - 1, F.lit(0).cast("long")), F.least(F.col("t") + 1, F.lit(last).cast("long")))
    return keys.select(key, F.explode(times).alias("t")).distinct()


def smoothed(series: DataFrame, key: str, value: str, alpha: float, passes: int) -> DataFrame:
    """Three-tap smoothing; the ends stay, alpha is at most 0.49."""
    a, out = min(alpha, 0.49), series
    for _ in range(passes):
        before, after = F.lag(value).over(by(key)), F.lead(value).over(by(key))
        flat = F.col(value) * (1 - 2 * a) + (before + after) * a
        out = out.withColumn(value, F.when(before.isNull() | after.isNull(), F.col(value)).otherwise(flat))
    return out


def active_window(frames: DataFrame, key: str, cutoff: float, band: float) -> DataFrame:
    """First and last frame (rows key, t, top, spread) that is active: top above cutoff / 4 or spread above band / 2; 0 and 0 if none is."""
    active = (F.col("top") > 0.25 * cutoff) | (F.col("spread") > 0.5 * band)
    t = F.when(active, F.col("t"))
    return frames.groupBy(key).agg(F.coalesce(F.min(t), F.lit(0)).alias("first_frame"), F.coalesce(F.max(t), F.lit(0)).alias("last_frame"))


def interpolated(series: DataFrame, key: str, value: str, is_key: Column) -> DataFrame:
    """Linear interpolation between the key rows around each row, held constant outside them: two ordered windows in place of an as-of join."""
    marked = series.withColumn("kt", F.when(is_key, F.col("t"))).withColumn("kv", F.when(is_key, F.col(value)))
    back = by(key).rowsBetween(Window.unboundedPreceding, 0)
    ahead = by(key).rowsBetween(0, Window.unboundedFollowing)
    found = marked.select(
        key,
        "t",
        value,
        F.last("kt", True).over(back).alias("t0"),
        F.last("kv", True).over(back).alias("v0"),
        F.first("kt", True).over(ahead).alias("t1"),
        F.first("kv", True).over(ahead).alias("v1"),
    )
    part = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")).cast("double")
    between = F.when(F.col("t0").isNull(), F.col("v1")).when(F.col("t1").isNull() | (F.col("t0") == F.col("t1")), F.col("v0"))
    return found.select(key, "t", value, between.otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * part).cast("double").alias("p"))
