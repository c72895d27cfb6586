"""Registered queries of codes, byte estimates, energies of tiles, neighbourhoods, correlations and control grids of other shapes, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions import columns as C
from ..operators import codec, fields, lattice
from .catalog import CELLS, PEAK, RESID, H, W, _cells, _paired, _r, _residuals, _table, query


@query(f"""WITH {RESID}, e AS (SELECT leaf_id, (voxel // 64 // 2 * 4 + voxel // 8 % 8 // 2) * 4 + voxel % 8 // 2 AS tile, sum(r * r) AS energy FROM resid GROUP BY 1, 2), k AS (SELECT *, sum(energy) OVER (PARTITION BY leaf_id) AS total, coalesce(sum(energy) OVER (PARTITION BY leaf_id ORDER BY round(energy, 6) DESC, tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e WHERE energy > 0)
SELECT leaf_id, count(*) FILTER (before / total < 0.995) AS tiles, coalesce(bit_or(CASE WHEN before / total < 0.995 AND tile < 32 THEN CAST(1 AS BIGINT) << CAST(tile AS INT) END), 0) AS mask_low, coalesce(bit_or(CASE WHEN before / total < 0.995 AND tile >= 32 THEN CAST(1 AS BIGINT) << CAST(tile - 32 AS INT) END), 0) AS mask_high, round(max(total), 4) AS total FROM k GROUP BY 1""")
def tile_energies(spark, sf_dir):
    """Tiles of 2 x 2 x 2 voxels by energy until 99.5 % of a leaf's is covered, as a mask of two words of 32 tiles."""
    tile = F.expr("(voxel div 64 div 2 * 4 + voxel div 8 % 8 div 2) * 4 + voxel % 8 div 2").alias("tile")
    e = _residuals(spark, sf_dir).groupBy("leaf_id", tile).agg(F.sum(F.expr("r * r")).alias("energy"))
    k = codec.covered(e, "leaf_id", "tile", 0.995)
    word = lambda n: F.coalesce(F.bit_or(F.when(F.col("needed") & (F.expr("tile div 32") == n), F.expr("shiftleft(1L, cast(tile % 32 as int))"))), F.lit(0).cast("long"))
    return k.groupBy("leaf_id").agg(F.count_if(F.col("needed")).alias("tiles"), word(0).alias("mask_low"), word(1).alias("mask_high"), F.round(F.max("total"), 4).alias("total"))


@query(f"""WITH {RESID}, n AS (SELECT leaf_id, count(*) FILTER (abs(r) / 50 >= 0.4) AS n, count(DISTINCT voxel) FILTER (abs(r) / 50 >= 0.4) AS tiles FROM resid GROUP BY 1), c AS (SELECT *, CASE WHEN n <= 64 THEN 64 WHEN n <= 256 THEN 256 WHEN n <= 768 THEN 768 ELSE 1024 END AS tier, least(64, tiles) AS active FROM n)
SELECT leaf_id, n, CAST(100 + tier * 2 + (tier + 1) // 2 AS BIGINT) AS sparse, CAST(16 * (2 + (512 * 3 + 7) // 8) AS BIGINT) AS dense, CAST(6 * (2 + (512 * 3 + 7) // 8) AS BIGINT) AS basis, CAST(12 + 6 * (2 + (greatest(1, active * 8) * 3 + 7) // 8) AS BIGINT) AS tile, CAST(14 + 6 * (2 + (greatest(1, active * 8) * 3 + 7) // 8) AS BIGINT) AS patch FROM c""")
def byte_estimates(spark, sf_dir):
    """What each leaf's residuals would take as events, dense blocks, temporal bases, tiles or patches."""
    big = F.abs("r") / PEAK >= 0.4
    n = _residuals(spark, sf_dir).groupBy("leaf_id").agg(F.count_if(big).alias("n"), F.countDistinct(F.when(big, F.col("voxel"))).alias("tiles"))
    active = F.least(F.lit(64).cast("long"), F.col("tiles"))
    sizes = {"sparse": codec.sparse_bytes(F.expr(C.tier("n"))), "dense": codec.dense_bytes(F.lit(16), 3, F.lit(512)), "basis": codec.dense_bytes(F.lit(6), 3, F.lit(512)), "tile": 12 + codec.dense_bytes(F.lit(6), 3, active * 8), "patch": 14 + codec.dense_bytes(F.lit(6), 3, active * 8)}
    return n.select("leaf_id", "n", *[c.cast("long").alias(name) for name, c in sizes.items()])


@query(f"""WITH {RESID}, s AS (SELECT *, max(abs(r)) OVER (PARTITION BY leaf_id, t) AS scale FROM resid), q AS (SELECT *, CASE WHEN scale <= 1e-12 OR r / scale BETWEEN -0.6666667 AND -1e-300 THEN 1 WHEN r / scale < -0.6666667 THEN 0 WHEN r / scale < 0.6666667 THEN 2 ELSE 3 END AS two, CASE WHEN scale <= 1e-12 THEN 1 ELSE CAST(floor(0.5 * (r / scale + 1) * 15 + 0.5) AS INT) END AS four FROM s)
SELECT leaf_id, t, count(*) AS n, count(*) FILTER (two = 0) AS lowest, count(*) FILTER (two = 3) AS highest, CAST(sum(four) AS BIGINT) AS fours, round(sqrt(avg(pow(r - scale * CASE two WHEN 0 THEN -1 WHEN 1 THEN -0.3333333 WHEN 2 THEN 0.3333333 ELSE 1 END, 2))), 6) AS rmse_two, round(sqrt(avg(pow(r - scale * (four / 15.0::DOUBLE * 2 - 1), 2))), 6) AS rmse_four FROM q GROUP BY 1, 2""")
def block_codes(spark, sf_dir):
    """Residuals in two bits of fixed levels and in four bits of even ones, by a scale for each leaf and frame, and what both lose."""
    s = _residuals(spark, sf_dir).withColumn("scale", F.max(F.abs("r")).over(Window.partitionBy("leaf_id", "t")))
    q = s.withColumn("two", codec.block_code(F.col("r"), F.col("scale"), 2)).withColumn("four", codec.block_code(F.col("r"), F.col("scale"), 4))
    lost = lambda c, n: F.round(F.sqrt(F.avg(F.pow(F.col("r") - codec.block_value(F.col(c), F.col("scale"), n), F.lit(2.0)))), 6)
    return q.groupBy("leaf_id", "t").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("two") == 0).alias("lowest"), F.count_if(F.col("two") == 3).alias("highest"), F.sum("four").cast("long").alias("fours"), lost("two", 2).alias("rmse_two"), lost("four", 4).alias("rmse_four"))


@query(f"""WITH {CELLS}, j AS (SELECT 'y' AS axis, a.v, b.v AS w FROM cells a JOIN cells b ON b.x = a.x AND b.y = a.y + 1 AND b.z = a.z AND b.t = a.t UNION ALL SELECT 'z', a.v, b.v FROM cells a JOIN cells b ON b.x = a.x AND b.y = a.y AND b.z = a.z + 1 AND b.t = a.t)
SELECT axis, count(*) AS n, CASE WHEN count(*) < 2 OR var_pop(v) = 0 OR var_pop(w) = 0 THEN 0.0 ELSE round(corr(v, w), 6) END AS correlation FROM j GROUP BY 1""")
def axis_correlations(spark, sf_dir):
    """Correlation of cells with their next ones along y and z, 0 where it isn't defined."""
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem"))
    parts = []
    for axis in "yz":
        moved = cells.select(*[(F.col(a) - 1).alias(a) if a == axis else a for a in "xyzt"], F.col("v").alias("w"))
        parts.append(cells.join(moved, list("xyzt")).select(F.lit(axis).alias("axis"), "v", "w"))
    n, defined = F.count(F.lit(1)), (F.var_pop("v") > 0) & (F.var_pop("w") > 0)
    return parts[0].unionByName(parts[1]).groupBy("axis").agg(n.alias("n"), F.when((n >= 2) & defined, F.round(F.corr("v", "w"), 6)).otherwise(0.0).alias("correlation"))


@query(f"""WITH {CELLS}, h AS (SELECT leaf_id, leaf_id % 4 AS bx, leaf_id // 4 % 4 AS by_, leaf_id // 16 AS bz, round(sum((v - p) * (v - p)), 6) AS sse FROM paired GROUP BY 1), s AS (SELECT *, 5.0 - row_number() OVER (ORDER BY sse DESC, leaf_id) AS severity FROM h QUALIFY severity >= 1),
f AS (SELECT *, CASE WHEN severity > 3 THEN 0.15 WHEN severity > 2 THEN 0.25 WHEN severity > 1.5 THEN 0.35 ELSE 0.5 END AS centre FROM s), p AS (SELECT n.leaf_id, abs(n.bx - f.bx) + abs(n.by_ - f.by_) + abs(n.bz - f.bz) AS steps, greatest(abs(n.bx - f.bx), abs(n.by_ - f.by_), abs(n.bz - f.bz)) AS ring, centre, severity FROM f JOIN h n ON abs(n.bx - f.bx) <= 2 AND abs(n.by_ - f.by_) <= 2 AND abs(n.bz - f.bz) <= 2)
SELECT leaf_id, CAST(min(steps) FILTER (steps <= 2) AS BIGINT) AS steps, round(min(CASE WHEN ring = 0 THEN centre WHEN ring = 1 THEN least(0.75, centre + 0.2) END), 6)::DOUBLE AS factor, CAST(max(severity) FILTER (ring <= 1) AS DOUBLE) AS severity FROM p GROUP BY 1 HAVING min(steps) <= 2 OR min(ring) <= 1""")
def leaf_neighbourhoods(spark, sf_dir):
    """Leaves around the four worst ones in all three directions: steps to the nearest within two, and in the ring around each the least factor and the greatest severity. Offsets are unrolled on the seeds."""
    stats = _paired(spark, sf_dir).groupBy("leaf_id").agg(F.round(F.sum(F.expr("(v - p) * (v - p)")), 6).alias("sse"))
    place = [F.expr("leaf_id % 4").alias("bx"), F.expr("leaf_id div 4 % 4").alias("by"), F.expr("leaf_id div 16").alias("bz")]
    worst = stats.orderBy(F.desc("sse"), "leaf_id").limit(4)
    severity = (5.0 - F.row_number().over(Window.orderBy(F.desc("sse"), "leaf_id"))).alias("severity")
    seeds = worst.select("leaf_id", severity).select("severity", *place)
    offsets = F.expr("inline(flatten(flatten(transform(sequence(-2, 2), a -> transform(sequence(-2, 2), b -> transform(sequence(-2, 2), c -> struct(a as dx, b as dy, c as dz)))))))")
    near = seeds.select("severity", "bx", "by", "bz", offsets)
    d = [F.abs(c) for c in ("dx", "dy", "dz")]
    s = F.col("severity")
    centre = F.when(s > 4, 0.08).when(s > 3, 0.15).when(s > 2, 0.25).when(s > 1.5, 0.35).otherwise(0.5)
    near = near.select("severity", *[(F.col(f"b{a}") + F.col(f"d{a}")).alias(f"b{a}") for a in "xyz"], (d[0] + d[1] + d[2]).cast("long").alias("steps"), F.greatest(*d).alias("ring"), centre.alias("centre"))
    met = near.join(stats.select("leaf_id", *place), ["bx", "by", "bz"])
    factor = F.when(F.col("ring") == 0, F.col("centre")).when(F.col("ring") == 1, F.least(F.lit(0.75), F.col("centre") + 0.2))
    out = met.groupBy("leaf_id").agg(F.min(F.when(F.col("steps") <= 2, F.col("steps"))).alias("steps"), F.round(F.min(factor), 6).alias("factor"), F.max(F.when(F.col("ring") <= 1, s)).cast("double").alias("severity"))
    return out.where("steps is not null or factor is not null")


@query(f"""WITH {CELLS}, o AS (SELECT leaf_id, voxel, row_number() OVER (PARTITION BY leaf_id ORDER BY voxel) - 1 AS rank FROM (SELECT leaf_id, voxel FROM leafed GROUP BY 1, 2 HAVING max(v) >= 0.9 * 50)), d AS (SELECT leaf_id, voxel, t, v - 25 AS residual FROM leafed WHERE t = 5)
SELECT o.leaf_id, o.voxel, rank, residual IS NOT NULL AS found, round(coalesce(residual, 0), 6) AS residual FROM o LEFT JOIN d USING (leaf_id, voxel)""")
def shell_ranks(spark, sf_dir):
    """Occupied voxels of each leaf with their rank, as a bitmap's popcount gives it, and their residual in frame 5."""
    cells = _cells(spark, sf_dir)
    held = cells.groupBy("leaf_id", "voxel").agg(F.max("v").alias("top")).where(F.col("top") >= 0.9 * PEAK)
    ranked = held.select("leaf_id", "voxel", (F.row_number().over(Window.partitionBy("leaf_id").orderBy("voxel")) - 1).alias("rank"))
    d = cells.where("t = 5").select("leaf_id", "voxel", (F.col("v") - 25).alias("residual"))
    return ranked.join(d, ["leaf_id", "voxel"], "left").select("leaf_id", "voxel", "rank", F.col("residual").isNotNull().alias("found"), F.round(F.coalesce("residual", F.lit(0.0)), 6).alias("residual"))


@query(f"""WITH {CELLS}, s AS (SELECT x, y, z, list_transform(range(16), lambda i: coalesce(m[i][1], 0.0)) AS series FROM (SELECT x, y, z, map_from_entries(list((t, v))) AS m FROM cells GROUP BY 1, 2, 3))
SELECT x, y, z, len(series) AS frames, round(list_sum(series), 6) AS total, round(list_sum(series[4:7]), 6) AS part, series[1] AS first FROM s""".replace("m[i][1]", "element_at(m, i)[1]"))
def voxel_series(spark, sf_dir):
    """Every voxel's series with time fastest: its sum, that of frames 3 to 6, and its first value."""
    s = fields.dense_frames(fields.field_cells(_table(spark, sf_dir, "lineitem")), 16)
    added = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    return s.select("x", "y", "z", F.size("series").cast("long").alias("frames"), F.round(added(F.col("series")), 6).alias("total"), F.round(added(F.slice("series", 4, 4)), 6).alias("part"), F.get("series", 0).alias("first"))


@query(f"""WITH {CELLS}, q AS (SELECT o_orderkey AS qid, o_orderkey * 7 % 32 AS x, o_custkey % 32 AS y, o_orderkey % 8 + 8 * (o_orderkey // 8192) AS z FROM orders), l AS (SELECT CAST(floor(z / 8.0) * 16 + floor(y / 8.0) * 4 + floor(x / 8.0) AS BIGINT) AS leaf_id, count(*) AS n FROM q GROUP BY 1),
e AS (SELECT leaf_id, count(*) FILTER (abs(v - p) >= 20) AS events, CASE WHEN count(*) < 1670 THEN 'sparse' ELSE 'dense' END AS mode FROM paired GROUP BY 1)
SELECT mode, CAST(sum(n) AS BIGINT) AS queries, count(*) AS leaves, max(n) AS most, round(sum(n * events) / CAST(sum(n) AS DOUBLE), 6) AS mean_events FROM l JOIN e USING (leaf_id) GROUP BY 1""")
def query_modes(spark, sf_dir):
    """A query batch by the mode of the leaves that it hits: queries, leaves, the most of one leaf, and the mean events met."""
    q = _table(spark, sf_dir, "orders").select(F.expr("o_orderkey * 7 % 32").alias("x"), F.expr("o_custkey % 32").alias("y"), fields.slab_z("o_orderkey").alias("z"))
    n = q.groupBy(fields.leaf_id(W, H, fields.DEEPEST).alias("leaf_id")).agg(F.count(F.lit(1)).alias("n"))
    e = _paired(spark, sf_dir).groupBy("leaf_id").agg(F.count_if(F.abs(F.expr("v - p")) >= 20).alias("events"), F.when(F.count(F.lit(1)) < 1670, "sparse").otherwise("dense").alias("mode"))
    return n.join(e, "leaf_id").groupBy("mode").agg(F.sum("n").alias("queries"), F.count(F.lit(1)).alias("leaves"), F.max("n").alias("most"), F.round(F.sum(F.expr("n * events")) / F.sum("n"), 6).alias("mean_events"))


_BENT = (0, 2, 5, 7)


def _at(p):
    """Bracket and part of a coordinate among _BENT."""
    return f"CASE WHEN {p} < 2 THEN 0 WHEN {p} < 5 THEN 1 ELSE 2 END", f"CASE WHEN {p} < 2 THEN {p} / 2.0 WHEN {p} < 5 THEN ({p} - 2) / 3.0 ELSE ({p} - 5) / 2.0 END"


_CORNERS = " + ".join(f"{'fx' if dx else '(1 - fx)'} * {'fy' if dy else '(1 - fy)'} * {'fz' if dz else '(1 - fz)'} * ctrl[((iz + {dz}) * 4 + iy + {dy}) * 4 + ix + {dx} + 1]" for dz in (0, 1) for dy in (0, 1) for dx in (0, 1))


@query(f"""WITH c AS (SELECT vec_id AS leaf_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS ctrl, least(4, vec_id % 8) AS px, vec_id // 8 % 8 AS py, vec_id * 3 % 8 AS pz FROM embeddings), b AS (SELECT *, {_at('px')[0]} AS ix, CAST({_at('px')[1]} AS DOUBLE) AS fx, {_at('py')[0]} AS iy, CAST({_at('py')[1]} AS DOUBLE) AS fy, {_at('pz')[0]} AS iz, CAST({_at('pz')[1]} AS DOUBLE) AS fz FROM c)
SELECT leaf_id, px, py, pz, round({_CORNERS}, 6) AS value FROM b""")
def bent_control_samples(spark, sf_dir):
    """Control grids whose points lie at 0, 2, 5 and 7 on each axis, sampled in a leaf that is cut off after x = 4."""
    c = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("leaf_id"), "embedding", (F.col("vec_id") % 8).alias("wx"), F.expr("vec_id div 8 % 8").alias("py"), F.expr("vec_id * 3 % 8").alias("pz"))
    c = c.withColumn("px", F.least(F.lit(4), F.col("wx")))
    return c.select("leaf_id", "px", "py", "pz", F.round(lattice.control_sample(F.col("embedding"), _BENT, F.col("px"), F.col("py"), F.col("pz")), 6).alias("value"))


@query(f"""WITH {CELLS} SELECT x, y, z, t, CAST(CASE WHEN abs(v - 30) <= 2 THEN 4 WHEN v >= 30 THEN 2 WHEN v >= 26 THEN 1.5 ELSE 1 END AS DOUBLE) AS density_weight, CAST(CASE WHEN abs(v - 25) <= 1 THEN 4 WHEN abs(v - 25) <= 4 THEN 2.5 WHEN abs(v - 25) <= 10 THEN 1.5 ELSE 1 END AS DOUBLE) AS surface_weight,
round(0.01 + 0.05 * greatest(abs(v), d), 6) AS tolerance FROM (SELECT *, stddev_pop(v) OVER (PARTITION BY x, y, z) AS d FROM cells)""")
def semantic_weights(spark, sf_dir):
    """Weights of cells by their distance from a cutoff and from a surface, and the tolerance that keyframes would have there."""
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem"))
    spread = cells.groupBy("x", "y", "z").agg(F.stddev_pop("v").alias("d"))
    v = F.col("v")
    tolerance = 0.01 + 0.05 * F.greatest(F.abs(v), F.col("d"))
    return cells.join(spread, ["x", "y", "z"]).select("x", "y", "z", "t", bits.density_weight(v, 30.0, 2.0).alias("density_weight"), C.band_weight(F.abs(v - 25), [(1, 4.0), (4, 2.5), (10, 1.5)], 1.0).alias("surface_weight"), F.round(tolerance, 6).alias("tolerance"))
