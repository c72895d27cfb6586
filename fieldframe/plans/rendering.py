"""Registered queries of render payloads, with their DuckDB equivalents.

Every leaf of the volume becomes a payload whose mode follows from its number: means of
octants as coarse controls, means of 27 parts as fine ones, bright cells as a shell. Values
are eighths, which half and single floats hold exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields, payload, rays, render
from ..sources.shared import written
from .catalog import CELLS, T, _cells, _r, _table, query

WORLD = render.Frame((2.0, -1.0, 0.0), 0.5, (32, 32, fields.DEEPEST), background=-3.0)
_MODE = "get(array(1, 3, 2, 0), cast((leaf_id + leaf_id div 4) % 4 as int))"

ASSET = f"""{CELLS}, heads AS (SELECT DISTINCT leaf_id, [1, 3, 2, 0][(leaf_id + leaf_id // 4) % 4 + 1] AS mode FROM leafed),
parts AS (SELECT leaf_id, mode, voxel, t, v, voxel % 8 AS lx, voxel // 8 % 8 AS ly, voxel // 64 AS lz FROM leafed JOIN heads USING (leaf_id) WHERE mode <> 0),
keys AS (SELECT leaf_id, 'coarse' AS stream, (lz // 4 * 2 + ly // 4) * 2 + lx // 4 AS control, t, round(avg(v) * 8) / 8 AS v FROM parts GROUP BY 1, 2, 3, 4
UNION ALL SELECT leaf_id, 'fine', (lz * 3 // 8 * 3 + ly * 3 // 8) * 3 + lx * 3 // 8, t, round(avg(v) * 8) / 8 - 25 FROM parts WHERE mode = 3 GROUP BY 1, 2, 3, 4
UNION ALL SELECT leaf_id, 'shell', voxel, t, round(v * 8) / 8 - 40 FROM parts WHERE mode = 2 AND v >= 40)"""
CONTROLS = """spread AS (SELECT leaf_id, stream, control, f AS t, max(t) FILTER (t <= f) AS t0, arg_max(v, t) FILTER (t <= f) AS v0, min(t) FILTER (t >= f) AS t1, arg_min(v, t) FILTER (t >= f) AS v1 FROM keys, range(16) r(f) GROUP BY 1, 2, 3, 4),
controls AS (SELECT leaf_id, stream, control, t, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (t - t0) / CAST(t1 - t0 AS DOUBLE) * (v1 - v0) END AS v FROM spread)"""


def _asset(spark, sf_dir):
    """(leaf_id, mode, payload) of all leaves, written."""
    cells = _cells(spark, sf_dir)
    heads = cells.select("leaf_id").distinct().select("leaf_id", F.expr(_MODE).alias("mode"))
    heads = heads.withColumns({"coarse_codec": F.lit(payload.SINGLE), "fine_codec": F.lit(payload.HALF), "coarse_resolution": F.lit(2), "fine_resolution": F.when(F.col("mode") >= payload.SHELL, 3).otherwise(0)})
    parts = cells.join(heads.select("leaf_id", "mode"), "leaf_id").where("mode <> 0").withColumns({"lx": F.expr("voxel % 8"), "ly": F.expr("voxel div 8 % 8"), "lz": F.expr("voxel div 64")})
    # to nine places first: a mean halfway between eighths is there in whatever order it was summed
    mean = lambda stream, control, shift: parts.groupBy("leaf_id", "t", F.expr(control).alias("control")).agg((F.round(F.round(F.avg("v") * 8, 9)) / 8 - shift).alias("v")).select("leaf_id", F.lit(stream).alias("stream"), "control", "t", "v")
    coarse = mean("coarse", "(lz div 4 * 2 + ly div 4) * 2 + lx div 4", 0)
    fine = mean("fine", "(lz * 3 div 8 * 3 + ly * 3 div 8) * 3 + lx * 3 div 8", 25).join(heads.where(f"mode = {payload.FINE}").select("leaf_id"), "leaf_id", "left_semi")
    shell = parts.where(f"mode = {payload.SHELL} and v >= 40").select("leaf_id", F.lit("shell").alias("stream"), F.col("voxel").alias("control"), "t", (F.round(F.col("v") * 8) / 8 - 40).alias("v"))
    made = payload.built(heads, coarse.unionByName(fine).unionByName(shell), T)
    return written(made.join(heads.select("leaf_id", F.col("mode").alias("told")), "leaf_id"), "asset")


@query(f"""WITH {ASSET} SELECT leaf_id, stream, CAST(control AS INT) AS control, t, v FROM keys""")
def payload_keys(spark, sf_dir):
    """All keyframes written into payloads and read back from their bytes."""
    series = payload.series_of(payload.laid_out(_asset(spark, sf_dir)))
    return series.select("leaf_id", "stream", F.col("control").cast("int").alias("control"), F.explode("keys").alias("k")).select("leaf_id", "stream", "control", "k.t", "k.v")


_HARMS = ("sound", "cut", "longer", "six bytes", "two bytes", "prefix", "mask")


@query(f"""WITH {ASSET}, shells AS (SELECT leaf_id, count(DISTINCT control) AS active, count(DISTINCT control) FILTER (control < 64) AS first FROM keys WHERE stream = 'shell' GROUP BY 1),
x AS (SELECT leaf_id, mode, coalesce(active, 0) AS active, coalesce(first, 0) AS first, unnest({list(_HARMS)}) AS harm FROM heads LEFT JOIN shells USING (leaf_id))
SELECT leaf_id, harm, CASE WHEN harm = 'two bytes' OR (mode = 0 AND harm = 'cut') THEN '{payload.ERRORS[0]}' WHEN mode = 0 THEN NULL WHEN harm = 'six bytes' THEN '{payload.ERRORS[1]}' WHEN harm = 'cut' AND (mode <> 2 OR active = 0) THEN '{payload.ERRORS[2]}' WHEN mode <> 2 THEN NULL
WHEN harm = 'prefix' THEN '{payload.ERRORS[3]}' WHEN harm = 'mask' OR active = 0 THEN '{payload.ERRORS[4]}' WHEN harm = 'cut' THEN '{payload.ERRORS[5]}' WHEN harm = 'longer' THEN '{payload.ERRORS[6]}' END AS error FROM x""")
def payload_errors(spark, sf_dir):
    """Every payload harmed in six ways, and what the check says of each."""
    laid = payload.laid_out(_asset(spark, sf_dir)).select("leaf_id", "told", "payload", "n_bytes", "fine_at")
    harmed = {
        "sound": "payload",
        "cut": "substring(payload, 1, n_bytes - 4)",
        "longer": "concat(payload, unhex('00000000'))",
        "six bytes": "substring(payload, 1, 6)",
        "two bytes": "substring(payload, 1, 2)",
        "prefix": f"if(told = 2, concat(substring(payload, 1, fine_at + {payload.MASK_BYTES} + 2), unhex('FFFF'), substring(payload, fine_at + {payload.MASK_BYTES} + 5, n_bytes)), payload)",
        "mask": f"if(told = 2, concat(substring(payload, 1, fine_at), unhex(repeat('00', {payload.SHELL_BYTES})), substring(payload, fine_at + {payload.SHELL_BYTES} + 1, n_bytes)), payload)",
    }
    ways = F.explode(F.array(*[F.struct(F.lit(name).alias("harm"), F.expr(e).alias("payload")) for name, e in harmed.items()]))
    return payload.laid_out(laid.select("leaf_id", ways.alias("h")).select("leaf_id", "h.harm", "h.payload")).select("leaf_id", "harm", "error")


_POINTS = f"""asked AS (SELECT o_orderkey AS qid, (o_orderkey * 7 % 330) / 10.0 - 0.5 AS px, (o_custkey % 325) / 10.0 - 0.3 AS py, o_orderkey % 8 + 8 * (o_orderkey // 8192) + (o_custkey % 10) / 10.0 AS pz, (o_orderkey * 5 + o_custkey) % 16 AS t FROM orders),
spots AS (SELECT *, px >= 0 AND py >= 0 AND px <= 31 AND py <= 31 AS inside, CAST(floor(pz / 8) * 16 + floor(py / 8) * 4 + floor(px / 8) AS BIGINT) AS leaf_id, px - floor(px / 8) * 8 AS lx, py - floor(py / 8) * 8 AS ly, pz - floor(pz / 8) * 8 AS lz FROM asked)"""


def _trilinear(stream, r):
    at = {a: f"(least(l{a}, 7.0) * {r - 1} / 7)" for a in "xyz"}
    low = {a: f"CAST(greatest(0, least({r - 2}, ceil({p}) - 1)) AS BIGINT)" for a, p in at.items()}
    return f"""{stream}_corners AS (SELECT qid, leaf_id, t, (({low['z']} + k // 4) * {r} + {low['y']} + k // 2 % 2) * {r} + {low['x']} + k % 2 AS control,
(CASE k % 2 WHEN 1 THEN {at['x']} - {low['x']} ELSE 1 - ({at['x']} - {low['x']}) END) * (CASE k // 2 % 2 WHEN 1 THEN {at['y']} - {low['y']} ELSE 1 - ({at['y']} - {low['y']}) END) * (CASE k // 4 WHEN 1 THEN {at['z']} - {low['z']} ELSE 1 - ({at['z']} - {low['z']}) END) AS w FROM spots, range(8) r(k) WHERE inside),
{stream}_values AS (SELECT qid, sum(w * v) AS {stream} FROM {stream}_corners JOIN controls USING (leaf_id, t, control) WHERE stream = '{stream}' GROUP BY 1)"""


@query(f"""WITH {ASSET}, {CONTROLS}, {_POINTS}, {_trilinear('coarse', 2)}, {_trilinear('fine', 3)},
met AS (SELECT s.qid, s.t, CASE WHEN inside THEN coalesce(mode, 0) ELSE 0 END AS mode, coalesce(coarse, 0) + coalesce(fine, 0) AS grid, c.v AS residual FROM spots s LEFT JOIN heads USING (leaf_id) LEFT JOIN coarse_values USING (qid) LEFT JOIN fine_values USING (qid)
LEFT JOIN controls c ON c.leaf_id = s.leaf_id AND c.t = s.t AND c.stream = 'shell' AND inside AND c.control = least(7, floor(lx + 0.5)) + 8 * least(7, floor(ly + 0.5)) + 64 * least(7, floor(lz + 0.5)))
SELECT qid, t, CAST(mode AS INT) AS mode, round(CASE WHEN mode = 0 THEN -3.0 WHEN mode = 2 AND residual IS NULL AND grid < 0 THEN -3.0 ELSE grid + coalesce(residual, 0) END, 6) AS value, round(CASE WHEN mode = 0 THEN -3.0 ELSE grid END, 6) AS plain FROM met""")
def render_points(spark, sf_dir):
    """Points in world space sampled from payloads of all four modes, with shells and background, and without."""
    e = F.expr
    cells = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), e("(o_orderkey * 7 % 330) / 10D - 0.5D").alias("px"), e("(o_custkey % 325) / 10D - 0.3D").alias("py"), (fields.slab_z("o_orderkey") + e("(o_custkey % 10) / 10D")).alias("pz"), e("(o_orderkey * 5 + o_custkey) % 16").alias("t"))
    points = cells.select("qid", "t", *[(F.lit(o) + F.lit(WORLD.voxel) * F.col(f"p{a}")).alias(a) for a, o in zip("xyz", WORLD.origin, strict=True)])
    asset = _asset(spark, sf_dir).drop("told")
    return render.sampled(points, asset, WORLD).select("qid", "t", "mode", _r("value"), _r("plain"))


@query(f"""WITH {ASSET}, {CONTROLS}, asked AS (SELECT DISTINCT leaf_id, t FROM leafed WHERE t = leaf_id % 16), cells8 AS (SELECT leaf_id, t, unnest(range(512)) AS voxel FROM asked),
spots AS (SELECT row_number() OVER () AS qid, leaf_id, t, voxel, true AS inside, voxel % 8 + 0.0 AS lx, voxel // 8 % 8 + 0.0 AS ly, voxel // 64 + 0.0 AS lz FROM cells8), {_trilinear('coarse', 2)}, {_trilinear('fine', 3)},
met AS (SELECT s.*, mode, coalesce(coarse, 0) + coalesce(fine, 0) AS grid, c.v AS residual FROM spots s JOIN heads USING (leaf_id) LEFT JOIN coarse_values USING (qid) LEFT JOIN fine_values USING (qid) LEFT JOIN controls c ON c.leaf_id = s.leaf_id AND c.t = s.t AND c.stream = 'shell' AND c.control = voxel)
SELECT leaf_id, t, count(*) AS cells, round(sum(CASE WHEN mode = 0 THEN 0 WHEN mode = 2 AND residual IS NULL AND grid < 0 THEN 0 ELSE grid + coalesce(residual, 0) END), 5) AS total,
round(max(CASE WHEN mode = 0 THEN 0 WHEN mode = 2 AND residual IS NULL AND grid < 0 THEN 0 ELSE grid + coalesce(residual, 0) END), 6) AS high FROM met GROUP BY 1, 2""")
def render_leaf_frames(spark, sf_dir):
    """One frame of every leaf decoded whole from its payload."""
    asset = _asset(spark, sf_dir).drop("told")
    frames = _cells(spark, sf_dir).where("t = leaf_id % 16").select("leaf_id", "t").distinct()
    cells = render.decoded_leaves(asset, frames, (32, 32, fields.DEEPEST))
    return cells.groupBy("leaf_id", "t").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("value"), 5).alias("total"), F.round(F.max("value"), 6).alias("high"))


MARCH = rays.March(level=20.0, longest_step=4.0)


@query(None)
def oblique_hits(spark, sf_dir):
    """A ray a customer through the volume at any angle: hit, normal, thickness, and whether the hit lies in shadow. Steps follow what was sampled, so SQL has no form for it."""
    e = F.expr
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("ray"))
    deepest = _table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    depth = 8 * ((deepest or 0) // fields.SLAB + 1)
    angle = c.withColumns({"t": e("ray % 16"), "turn": e("ray * 0.61803398875D * 2 * pi()"), "rise": e("(ray % 19 - 9) / 10D")})
    way = {"dx": e("cos(turn) * sqrt(1 - rise * rise)"), "dy": e("sin(turn) * sqrt(1 - rise * rise)"), "dz": F.col("rise")}
    cast = angle.withColumns({"ox": e("cast(ray % 32 as double)"), "oy": e("cast(ray * 7 % 32 as double)"), "oz": e(f"cast(ray * 5 % {depth} as double)"), "length": F.lit(24.0)} | way)
    cast = cast.select("ray", "t", "ox", "oy", "oz", "dx", "dy", "dz", "length")
    cells = written(fields.field_cells(_table(spark, sf_dir, "lineitem")), "cells")
    hits = written(rays.surface_hits(cast, cells, MARCH), "hits")
    light = {"x": 0.48, "y": 0.6, "z": 0.64}
    off = cast.drop("length").join(hits.where("hit is not null"), "ray").select("ray", "t", *[(F.col(f"o{a}") + F.col("hit") * F.col(f"d{a}") + F.col(f"n{a}")).alias(f"o{a}") for a in "xyz"], *[F.lit(v).alias(f"d{a}") for a, v in light.items()], F.lit(16.0).alias("length"))
    dark = rays.shadowed(off, cells, MARCH)
    return hits.join(dark, "ray", "left").select("ray", *[_r(x) for x in ("hit", "nx", "ny", "nz", "facing", "thickness")], "shadow")
