"""Orthographic projections that stop where a ray is opaque, folded by stretches of depth, and how alike two of them are."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .metrics import psnr

#: Depths of the stretches that rays are folded by, from short to long.
STRETCHES = (8, 8 * 1024)
#: A ray ends behind the first sample that leaves less light than this.
OPAQUE = 1e-3


def optical_depth(v: Column, cutoff: float) -> Column:
    """What a sample takes of the light, as a logarithm: twice what it is above the cutoff, relative to that."""
    return 2.0 * F.greatest(F.lit(0.0), v - cutoff) / max(cutoff, 1e-6)


def projected(samples: DataFrame, ray: Sequence[str], stretches: Sequence[int] = STRETCHES, opaque: float = OPAQUE) -> DataFrame:
    """(ray..., samples, image) of samples (ray..., z, optical), front to back along z.

    Opacities put over each other are 1 - exp of minus the sum of their optical depths, so a ray's
    image follows from the sum up to where it ends; samples counts those. Sums are partial aggregates
    by stretches of z. Of a ray's longest stretches only the one in which it ends is opened, and
    of its shorter ones again only one, so no window is longer than one stretch holds of the next, and
    no sample behind a ray's last stretch is looked at twice. Rays have one sample a z.
    """
    ray, full = list(ray), -math.log(opaque)
    levels = [samples.select(*ray, F.col("z").alias("at"), "optical", F.lit(1).cast("long").alias("n"))]
    step = 1
    for length in stretches:
        folded = levels[-1].groupBy(*ray, F.floor(F.col("at") / (length // step)).alias("at")).agg(F.sum("optical").alias("optical"), F.sum("n").alias("n"))
        levels.append(written(folded, "stretches"))
        step = length
    lengths = [1, *stretches]
    ends, parts = None, []
    for i in reversed(range(len(levels))):
        rows = levels[i]
        if ends is None:
            rows = rows.withColumn("base", F.lit(0.0))
        else:
            rows = rows.withColumn("above", F.floor(F.col("at") / (lengths[i + 1] // lengths[i]))).join(ends, [*ray, "above"]).drop("above")
        before = Window.partitionBy(*ray).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("base", F.col("base") + F.coalesce(F.sum("optical").over(before), F.lit(0.0))).where(F.col("base") <= full)
        last = F.col("base") + F.col("optical") > full
        if i:
            rows = written(rows.withColumn("last", last), "opened")
            ends = rows.where("last").select(*ray, F.col("at").alias("above"), "base")
            rows = rows.where("not last")
        parts.append(rows.select(*ray, "optical", "n"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*ray).agg(F.sum("n").alias("samples"), (1 - F.exp(-F.sum("optical"))).alias("image"))


def likeness(pairs: DataFrame, key: str, pixels: int) -> DataFrame:
    """Per key of pairs (key, truth, image) the error and PSNR of images of so many pixels; pixels without a row are black in both."""
    out = pairs.groupBy(key).agg(F.sum(F.expr("pow(truth - image, 2)")).alias("sse"), F.greatest(F.lit(1e-6), F.max("truth")).alias("peak"))
    out = out.withColumn("rmse", F.sqrt(F.col("sse") / pixels))
    return out.withColumn("psnr", psnr(F.col("rmse"), F.col("peak"))).drop("sse")
