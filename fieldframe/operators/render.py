"""Render assets decoded and sampled: controls by frame, points in world space, shells and backgrounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import payload

LEAF = 8


@dataclass(frozen=True)
class Frame:
    """Where the volume lies in the world (corner of cell 0 and side of a cell), its size, and what is outside of it."""

    origin: tuple[float, float, float]
    voxel: float
    size: tuple[int, int, int]
    background: float = 0.0


def controls_at(series: DataFrame, wanted: DataFrame) -> DataFrame:
    """(leaf_id, t, coarse, fine, shell) for each wanted (leaf_id, t): the control grids' values as arrays in their order, the shell's as a map from voxels.

    Only leaves and frames that are asked for are decoded, each once, however many points look into them.
    """
    met = series.where("not broken").join(wanted.select("leaf_id", "t").distinct(), "leaf_id")
    met = met.withColumns({"low": F.expr("try_element_at(filter(keys, k -> k.t <= t), -1)"), "high": F.expr("get(filter(keys, k -> k.t >= t), 0)")})
    # on the line between the neighbours, constant outside them, 0 without any
    line = F.expr("low.v + cast(t - low.t as double) / (high.t - low.t) * (high.v - low.v)")
    v = F.when(F.col("low").isNull(), F.coalesce("high.v", F.lit(0.0))).when(F.col("high").isNull() | (F.col("low.t") == F.col("high.t")), F.col("low.v")).otherwise(line)
    values = met.select("leaf_id", "t", "stream", "control", v.alias("v"))
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("stream") == s, F.struct("control", "v"))))
    held = values.groupBy("leaf_id", "t").agg(of("coarse").alias("coarse"), of("fine").alias("fine"), of("shell").alias("shell"))
    return held.select("leaf_id", "t", F.expr("transform(coarse, s -> s.v)").alias("coarse"), F.expr("transform(fine, s -> s.v)").alias("fine"), F.map_from_entries("shell").alias("shell"))


def _with_grid(rows: DataFrame, values: str, r: str, name: str) -> DataFrame:
    """rows with name: a control grid (values, in their order) of r points an axis, 7 / (r - 1) apart, at (l*) clamped to the leaf's extents (w*), trilinear; 0 without values."""
    rows = rows.withColumns({f"g{a}": F.expr(f"least(greatest(l{a}, 0D), cast(w{a} - 1 as double)) * ({r} - 1) / 7") for a in "xyz"})
    rows = rows.withColumns({f"i{a}": F.expr(f"cast(greatest(0, least({r} - 2, ceil(g{a}) - 1)) as int)") for a in "xyz"})
    rows = rows.withColumns({f"f{a}": F.expr(f"g{a} - i{a}") for a in "xyz"} | {"base": F.expr(f"(iz * {r} + iy) * {r} + ix")})
    steps = [(k & 1, k >> 1 & 1, k >> 2) for k in range(8)]
    parts = [f"get({values}, base + {x} + ({y} + {z} * {r}) * {r}) * " + " * ".join(f"f{a}" if s else f"(1 - f{a})" for a, s in zip("xyz", (x, y, z), strict=True)) for x, y, z in steps]
    held = F.expr(f"if({r} > 1, {' + '.join(parts)}, get({values}, 0))")
    return rows.withColumn(name, F.coalesce(held, F.lit(0.0))).drop(*[f"{c}{a}" for c in "gif" for a in "xyz"], "base")


def placed(points: DataFrame, frame: Frame) -> DataFrame:
    """points (x, y, z in the world, t, ...) with inside, leaf_id, local coordinates l* and the leaf's extents w*: an affine step to cells, then the leaf."""
    out = points.withColumns({f"p{a}": (F.col(a) - F.lit(o)) / F.lit(frame.voxel) for a, o in zip("xyz", frame.origin, strict=True)})
    inside = F.lit(True)
    for a, n in zip("xyz", frame.size, strict=True):
        inside = inside & (F.col(f"p{a}") >= 0) & (F.col(f"p{a}") <= n - 1)
    blocks = [-(-n // LEAF) for n in frame.size]
    out = out.withColumn("inside", inside).withColumns({f"b{a}": F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.floor(f"p{a}") / float(LEAF)))).cast("long") for a, n in zip("xyz", blocks, strict=True)})
    out = out.withColumns({f"l{a}": F.col(f"p{a}") - F.col(f"b{a}") * LEAF for a in "xyz"} | {f"w{a}": F.least(F.lit(LEAF), F.lit(n) - F.col(f"b{a}") * LEAF) for a, n in zip("xyz", frame.size, strict=True)})
    return out.withColumn("leaf_id", F.when(F.col("inside"), (F.col("bz") * blocks[1] + F.col("by")) * blocks[0] + F.col("bx")))


def sampled(points: DataFrame, leaves: DataFrame, frame: Frame, keep_interior: bool = False) -> DataFrame:
    """points (x, y, z, t in the world, ...) with mode, plain and value, from leaves (leaf_id, payload).

    Outside the volume and in empty or missing leaves both are the background. plain is the
    control grids' sum; value adds the residual of the voxel nearest to the point in shells, and where such a
    voxel is not occupied a negative value becomes the background, unless keep_interior. Headers are
    looked at first: empty leaves go before any payload is read, and so do leaves that no point lies in. Controls of the asked leaves
    and frames are decoded once and written. A leaf with an error raises.
    """
    kept = points.columns
    at = placed(points, frame)
    asked = at.where("leaf_id is not null").select("leaf_id", "t").distinct()
    first = F.expr(payload._u("0", 1)) % 4
    held = leaves.where(first != payload.EMPTY).join(asked.select("leaf_id").distinct(), "leaf_id", "left_semi")
    sound = payload.laid_out(held).withColumn("error", F.expr("if(error is null, error, cast(raise_error(concat('leaf ', leaf_id, ': ', error)) as string))"))
    heads = payload.with_head(held).select("leaf_id", "mode", "coarse_resolution", "fine_resolution")
    cached = written(controls_at(written(payload.series_of(sound), "series"), asked).join(heads, "leaf_id"), "controls")
    met = at.join(cached, ["leaf_id", "t"], "left")
    met = _with_grid(_with_grid(met, "coarse", "coarse_resolution", "coarse_value"), "fine", "fine_resolution", "fine_value")
    nearest = " + ".join(f"cast(least(greatest(floor(l{a} + 0.5D), 0), 7) as int) * {s}" for a, s in (("x", 1), ("y", 8), ("z", 64)))
    met = met.withColumns({"residual": F.expr(f"if(mode = {payload.SHELL}, element_at(shell, {nearest}), null)"), "grid": F.expr(f"coarse_value + if(mode = {payload.FINE}, fine_value, 0D)")})
    outside, empty = F.col("mode").isNull(), F.lit(float(frame.background))
    hollow = F.lit(not keep_interior) & (F.col("mode") == payload.SHELL) & F.col("residual").isNull() & (F.col("grid") < 0)
    value = F.when(outside | hollow, empty).otherwise(F.col("grid") + F.coalesce("residual", F.lit(0.0)))
    return met.select(*kept, F.coalesce("mode", F.lit(payload.EMPTY)).alias("mode"), F.when(outside, empty).otherwise(F.col("grid")).alias("plain"), value.alias("value"))


def decoded_leaves(leaves: DataFrame, frames: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """(leaf_id, t, x, y, z, value): every cell of the asked (leaf_id, t); empty leaves are 0, and so are unoccupied cells of shells whose value is negative."""
    blocks = [-(-n // LEAF) for n in size]
    cells = frames.select("leaf_id", "t", F.explode(F.sequence(F.lit(0), F.lit(LEAF**3 - 1))).alias("voxel"))
    base = {"x": F.col("leaf_id") % blocks[0], "y": F.expr(f"leaf_id div {blocks[0]} % {blocks[1]}"), "z": F.expr(f"leaf_id div {blocks[0] * blocks[1]}")}
    local = {"x": F.col("voxel") % LEAF, "y": F.expr(f"voxel div {LEAF} % {LEAF}"), "z": F.expr(f"voxel div {LEAF * LEAF}")}
    spots = cells.select(F.col("leaf_id").alias("leaf"), "t", *[(base[a] * LEAF + local[a]).cast("double").alias(a) for a in "xyz"])
    inside = spots.where(" and ".join(f"{a} < {n}" for a, n in zip("xyz", size, strict=True)))
    return sampled(inside, leaves, Frame((0.0, 0.0, 0.0), 1.0, size)).select(F.col("leaf").alias("leaf_id"), "t", *[F.col(a).cast("long").alias(a) for a in "xyz"], "mode", "value")
