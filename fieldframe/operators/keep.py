"""What is background, elided, critical or compatible: predicates over leaves and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series


def elided(samples: DataFrame, key: str, air: float, inside: float, within: float = 0.5) -> DataFrame:
    """(key, elide): air or inside if all samples (key, v) are within that background's range, else null."""
    near = lambda level: F.bool_and(F.abs(F.col("v") - level) < within)
    return samples.groupBy(key).agg(F.when(near(air), "air").when(near(inside), "inside").alias("elide"))


def background_class(low: Column, high: Column, cutoff: float, band: float, zero_ratio: float, const_ratio: float) -> Column:
    """elide (nothing above the zero level), uniform (below the constant level and the visible band, and flat), or keep."""
    zero = max(1e-9, zero_ratio * cutoff)
    const = max(zero, const_ratio * cutoff)
    floor = max(zero, 0.25 * max(band, cutoff * 0.10))
    if cutoff <= 0:
        return F.lit("keep")
    flat = (high <= const) & (high < cutoff - max(0.0, band)) & (F.greatest(F.lit(0.0), high - low) <= floor)
    return F.when(high <= zero, "elide").when(flat, "uniform").otherwise("keep")


def surface_critical(keys: DataFrame, key: str, value: str, iso: float, critical: float) -> DataFrame:
    """(key, critical): whether a series (key, t, value) has a value near iso, or neighbouring ones on both sides of it or on it."""
    d = F.col(value) - iso
    before = F.lag(d).over(series.by(key))
    hit = (F.abs(d) <= critical) | ((before <= 0) & (d >= 0)) | ((before >= 0) & (d <= 0))
    return keys.withColumn("hit", F.coalesce(hit, F.lit(False))).groupBy(key).agg(F.bool_or("hit").alias("critical"))


def compatible(pairs: DataFrame, values: DataFrame, key: str, value: str, frames: int, cutoff: float, band: float) -> DataFrame:
    """pairs (a, b) with compatible: at no time that one of both has, nor at the ends, is one clearly below the cutoff and the other clearly above it.

    Series are on lines between their own times and constant outside them; a series becomes frames rows.
    """
    spots = values.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))).alias("t"))
    met = spots.join(values.select(key, F.col("t").cast("long").alias("t"), F.col(value).cast("double").alias("v")), [key, "t"], "left")
    lines = series.interpolated(met, key, "v", F.col("v").isNotNull())
    seen = F.col("v").isNotNull() | F.col("t").isin(0, frames - 1)
    state = lines.select(F.col(key), "t", seen.alias("seen"), series.cutoff_state(F.col("p"), cutoff, band).alias("s"))
    side = lambda n: state.select(F.col(key).alias(n), "t", F.col("seen").alias(f"seen_{n}"), F.col("s").alias(f"s_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "t"])
    clash = (F.col("seen_a") | F.col("seen_b")) & (F.col("s_a") + F.col("s_b") == 2) & (F.col("s_a") != F.col("s_b"))
    found = both.groupBy("a", "b").agg((~F.bool_or(clash)).alias("compatible"))
    return pairs.join(found, ["a", "b"], "left").withColumn("compatible", F.coalesce("compatible", F.lit(True)))


def compacted(children: DataFrame, parent: str) -> DataFrame:
    """The children (parent, child, value) that differ from their parent's default, with their place in a list without gaps; the default is the more frequent of air and inside, air if equal."""
    whole = Window.partitionBy(parent)
    default = F.when(F.count_if(F.col("value") == "inside").over(whole) > F.count_if(F.col("value") == "air").over(whole), "inside").otherwise("air")
    kept = children.withColumn("default", default).where(F.col("value") != F.col("default"))
    return kept.withColumn("place", F.row_number().over(whole.orderBy("child")) - 1)


def sketch(rows: DataFrame, key: str, value: str, frames: int) -> DataFrame:
    """(key, s, v): nine samples of each series (key, t, value) at (frames - 1) * s / 8, on lines between its rows and held outside them."""
    spots = rows.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(8))).alias("s")).withColumn("t", (frames - 1) * F.col("s") / 8.0)
    both = rows.select(key, F.col("t").cast("double").alias("t"), F.col(value).cast("double").alias("kv"), F.lit(None).cast("int").alias("s"))
    both = both.unionByName(spots.select(key, "t", F.lit(None).cast("double").alias("kv"), "s"))
    both = both.withColumn("kt", F.when(F.col("kv").isNotNull(), F.col("t")))
    order = Window.partitionBy(key).orderBy("t", F.col("s").isNotNull())
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    last, nxt = (lambda c: F.last(c, True).over(back)), (lambda c: F.first(c, True).over(ahead))
    met = both.select(key, "t", "s", last("kt").alias("t0"), last("kv").alias("v0"), nxt("kt").alias("t1"), nxt("kv").alias("v1")).where("s is not null")
    part = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    v = F.when(F.col("t0").isNull(), F.col("v1")).when(F.col("t1").isNull() | (F.col("t0") == F.col("t")), F.col("v0")).otherwise(F.col("v0") + part * (F.col("v1") - F.col("v0")))
    return met.select(key, "s", v.alias("v"))
