"""Audits of a decoded volume: leaves around an iso value, summaries by mode, and frames decoded in two ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decode

#: What is summed up, by leaf and then by mode.
SUMS = ("voxels", "active", "shell_active", "fine_keys", "band", "coarse_flips", "flips", "negative", "over", "sse", "coarse_sse", "active_sse", "coarse_active_sse", "band_sse", "coarse_band_sse")


def leaf_diagnosis(cells: DataFrame, iso: float, width: float, top: float, least: float = 1e-6) -> DataFrame:
    """Per leaf of cells (leaf_id, x, y, z, t, v, coarse, decoded, is_event) the sums of SUMS, the range of what was decoded, and the worst cell.

    A cell is active above `least`, and in the band within `width` of iso; it flips if the
    prediction lies on iso's other side (decided at nine decimals). shell_active counts voxels with events,
    fine_keys the events, over what was decoded beyond top. Of equally bad cells the first in t, z, y, x order counts.
    """
    at = lambda c: F.round(F.col(c), 9)
    band = F.abs(F.col("v") - iso) <= width
    rows = cells.withColumns({"at_coarse": at("coarse"), "at_decoded": at("decoded"), "in_band": band, "is_active": F.col("v") > least})
    rows = rows.withColumns({"e": F.round(F.abs(F.col("decoded") - F.col("v")), 9), "e2": F.expr("pow(decoded - v, 2)"), "ce2": F.expr("pow(coarse - v, 2)")})
    flips = lambda c: F.count_if(F.col("in_band") & ((F.col("v") >= iso) != (F.col(c) >= iso)))
    part = lambda c, where: F.coalesce(F.sum(F.when(F.col(where), F.col(c))), F.lit(0.0))
    worst = F.max_by(F.struct("x", "y", "z", "t", "v", "coarse", "decoded"), F.struct("e", *[-F.col(a) for a in "tzyx"]))
    return rows.groupBy("leaf_id").agg(
        F.count(F.lit(1)).alias("voxels"), F.count_if("is_active").alias("active"), F.countDistinct(F.when(F.col("is_event"), F.col("voxel"))).alias("shell_active"), F.count_if("is_event").alias("fine_keys"),
        F.count_if("in_band").alias("band"), flips("at_coarse").alias("coarse_flips"), flips("at_decoded").alias("flips"), F.count_if(F.col("at_decoded") < 0).alias("negative"), F.count_if(F.col("at_decoded") > top).alias("over"),
        F.sum("e2").alias("sse"), F.sum("ce2").alias("coarse_sse"), part("e2", "is_active").alias("active_sse"), part("ce2", "is_active").alias("coarse_active_sse"), part("e2", "in_band").alias("band_sse"), part("ce2", "in_band").alias("coarse_band_sse"),
        F.min("decoded").alias("low"), F.max("decoded").alias("high"), F.max("e").alias("max_abs"), worst.alias("worst"),
    )


def rate(n: str, of: str) -> Column:
    """n / of, 0 without any."""
    return F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)


def rms(total: str, of: str) -> Column:
    return F.sqrt(rate(total, of))


def measures(sums: DataFrame) -> DataFrame:
    """sums with the rates and errors that follow from them."""
    return sums.withColumns(
        {
            "keys_per_active": rate("fine_keys", "shell_active"), "coarse_flip_rate": rate("coarse_flips", "band"), "flip_rate": rate("flips", "band"),
            "coarse_band_rmse": rms("coarse_band_sse", "band"), "band_rmse": rms("band_sse", "band"), "coarse_active_rmse": rms("coarse_active_sse", "active"), "active_rmse": rms("active_sse", "active"),
            "negative_share": rate("negative", "voxels"), "over_share": rate("over", "voxels"),
        }
    )


def mode_summary(leaves: DataFrame) -> DataFrame:
    """Leaves (mode and SUMS) by mode, and a row TOTAL, with all measures. One aggregate: the total is a grouping set."""
    out = leaves.rollup("mode").agg(F.grouping("mode").alias("all_modes"), F.count(F.lit(1)).alias("leaves"), *[F.sum(c).alias(c) for c in SUMS])
    return measures(out.withColumn("mode", F.when(F.col("all_modes") == 1, "TOTAL").otherwise(F.col("mode"))).drop("all_modes"))


def instability() -> list[Column]:
    """The order of measured leaves by how unstable the iso surface is in them; those without cells in the band come last."""
    return [F.when(F.col("band") > 0, 0).otherwise(1), F.round("flip_rate", 9).desc(), F.round("band_rmse", 9).desc(), F.col("leaf_id")]


def decoded_both_ways(points: DataFrame, coefficients: DataFrame, events: DataFrame, frames: int) -> DataFrame:
    """points (leaf_id, voxel, t, ...) with by_frame, from their leaves' frames decoded whole, by_point, from one look into the leaf's streams, and equal: whether they are the same to the last bit.

    coefficients are (leaf_id, k, c) and events (leaf_id, voxel, t, q, scale), both stored: sums that
    are worked out anew may differ in their last bits. Leaves without coefficients have 0 everywhere.
    """
    streams = coefficients.groupBy("leaf_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda s: s["c"]).alias("c"))
    asked = points.select("leaf_id", "t").distinct().join(streams, "leaf_id")
    whole = asked.select("leaf_id", "t", decode.value_at(F.col("c"), F.col("t"), frames).alias("coarse"), F.explode(F.expr("sequence(0L, 511L)")).alias("voxel"))
    whole = decode.with_events(whole, events).select("leaf_id", "voxel", "t", (F.col("coarse") + F.col("residual")).alias("by_frame"))
    held = events.groupBy("leaf_id").agg(F.collect_list(F.struct("voxel", "t", (F.col("q") * F.col("scale")).alias("r"))).alias("found"))
    single = points.join(streams, "leaf_id", "left").join(held, "leaf_id", "left")
    residual = F.expr("coalesce(get(filter(found, s -> s.voxel = voxel and s.t = t), 0).r, 0D)")
    single = single.withColumn("by_point", F.coalesce(decode.value_at(F.col("c"), F.col("t"), frames) + residual, F.lit(0.0))).drop("c", "found")
    out = single.join(whole, ["leaf_id", "voxel", "t"], "left").withColumn("by_frame", F.coalesce("by_frame", F.lit(0.0)))
    return out.withColumn("equal", F.col("by_frame").eqNullSafe(F.col("by_point")))
