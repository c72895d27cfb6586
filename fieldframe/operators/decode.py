"""Decoding as joins: temporal coefficients to values, events looked up by cell, points and frames put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def frames_of(coefficients: DataFrame, key: str, n: int) -> DataFrame:
    """(key, t, coarse): the series of n frames of cosine coefficients (key, k, c)."""
    spread = coefficients.select(key, "k", "c", F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias("t"))
    return spread.groupBy(key, "t").agg(F.sum(F.col("c") * F.expr(C.dct_basis(f"{n}e0", "t", "k"))).alias("coarse"))


def value_at(coefficients: Column, t: Column, n: int) -> Column:
    """One frame's value of an array of cosine coefficients."""
    basis = lambda k: F.when(k == 0, F.sqrt(F.lit(1.0 / n))).otherwise(F.sqrt(F.lit(2.0 / n))) * F.cos(F.pi() / n * (t + 0.5) * k)
    return F.aggregate(F.transform(coefficients, lambda c, k: c * basis(k)), F.lit(0.0), lambda s, x: s + x)


def event_bin(t: Column, frames: int) -> Column:
    """The time bin of a frame, of 16 with ceil(frames / 16) frames each."""
    return F.least(F.lit(15), F.floor(t / float(-(-frames // 16)))).cast("long")


def with_events(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows (leaf_id, voxel, t, ...) with residual: q * scale of the event (leaf_id, voxel, t, q, scale) there, 0 without one."""
    return rows.join(events.select("leaf_id", "voxel", "t", "q", "scale"), ["leaf_id", "voxel", "t"], "left").withColumn("residual", F.coalesce(F.col("q") * F.col("scale"), F.lit(0.0))).drop("q", "scale")


def reconstructed(rows: DataFrame, coarse: DataFrame, events: DataFrame) -> DataFrame:
    """rows (leaf_id, voxel, t, ...) with coarse (of leaf and frame), residual and decoded, their sum."""
    return with_events(rows.join(coarse, ["leaf_id", "t"]), events).withColumn("decoded", F.col("coarse") + F.col("residual"))
