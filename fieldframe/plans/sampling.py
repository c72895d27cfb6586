"""Registered queries of query patterns, lattices, samples between cells and rays, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields, lattice, ranks
from .catalog import CELLS, D, H, T, W, _cells, _r, _table, query

_DRAW = "((k % 1000003 + 7919 * {s}) * 48271 + (k * 69621) % 65537) % 2147483647 % {n}"


def _draw(salt, n, key="o_orderkey"):
    return "(" + _DRAW.format(s=salt, n=n).replace("k ", f"{key} ") + ")"


#: The volume's planes: eight for each slab of orders.
_DEPTH = "(SELECT 8 * (max(o_orderkey) // 8192 + 1) FROM orders)"
_FREE = [_draw(1, 32), _draw(2, 32), _draw(3, _DEPTH), _draw(4, 16)]
_HELD = [_draw(11 + i, n, "0::BIGINT") for i, n in enumerate((32, 32, _DEPTH, 16))]
_TILE = [f"least({n} - 1, CAST(floor({_FREE[i]} / 8.0) * 8 AS BIGINT) + CAST(floor(o_orderkey / {8**i}.0) AS BIGINT) % 8)" for i, n in enumerate((32, 32, _DEPTH))]


def _pattern_sql(x, y, z, t):
    return f"""WITH {CELLS}, q AS (SELECT o_orderkey AS qid, CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y, CAST({z} AS BIGINT) AS z, CAST({t} AS BIGINT) AS t FROM orders)
SELECT qid, x, y, z, t, coalesce(v, 0.0) AS v FROM q LEFT JOIN cells USING (x, y, z, t)"""


def _depth(spark, sf_dir):
    """How many planes the orders fill: one number for the driver."""
    top = _table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return 8 * ((top or 0) // fields.SLAB + 1)


def _pattern(spark, sf_dir, name):
    ids = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"))
    queries = lattice.query_pattern(ids, name, W, H, _depth(spark, sf_dir), T)
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem"))
    return queries.join(cells, ["x", "y", "z", "t"], "left").select("qid", "x", "y", "z", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


@query(_pattern_sql(*_FREE))
def random_queries(spark, sf_dir):
    """A query an order at drawn places and frames, joined with the cells."""
    return _pattern(spark, sf_dir, "random")


@query(_pattern_sql(*_FREE[:3], _HELD[3]))
def same_frame_queries(spark, sf_dir):
    """Drawn places of one frame."""
    return _pattern(spark, sf_dir, "same_t")


@query(_pattern_sql(*_HELD[:3], _FREE[3]))
def same_place_queries(spark, sf_dir):
    """Drawn frames of one place."""
    return _pattern(spark, sf_dir, "same_xyz")


@query(_pattern_sql(*_TILE, _HELD[3]))
def coherent_queries(spark, sf_dir):
    """Tiles of 8 x 8 x 8 at drawn blocks of one frame."""
    return _pattern(spark, sf_dir, "coherent")


@query(f"""WITH {CELLS}, q AS (SELECT o_orderkey AS qid, CAST({_FREE[0]} AS BIGINT) AS x, CAST({_FREE[1]} AS BIGINT) AS y, CAST({_FREE[2]} AS BIGINT) AS z, CAST({_FREE[3]} AS BIGINT) AS t FROM orders),
l AS (SELECT *, CAST(floor(z / 8.0) * 16 + floor(y / 8.0) * 4 + floor(x / 8.0) AS BIGINT) AS leaf_id FROM q)
SELECT *, CAST(sum(n) OVER (ORDER BY leaf_id, t) AS BIGINT) - n AS begins, CAST(sum(n) OVER (ORDER BY leaf_id, t) AS BIGINT) AS ends FROM (SELECT leaf_id, t, min(z * 1024 + y * 32 + x) AS first_cell, max(z * 1024 + y * 32 + x) AS last_cell, count(*) AS n, count(DISTINCT (x, y, z)) AS places FROM l GROUP BY 1, 2)""")
def query_segments(spark, sf_dir):
    """Queries in the order leaf, frame, z, y, x: where the segment of each leaf and frame begins and ends in it, and the cells it spans."""
    ids, depth = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid")), _depth(spark, sf_dir)
    q = lattice.query_pattern(ids, "random", W, H, depth, T).withColumn("leaf_id", fields.leaf_id(W, H, depth)).withColumn("cell", F.expr(f"(z * {H} + y) * {W} + x"))
    runs = q.groupBy("leaf_id", "t").agg(F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"), F.count(F.lit(1)).alias("n"), F.countDistinct("cell").alias("places"))
    return ranks.running(runs, [F.col("leaf_id"), F.col("t")], F.col("n"), "begins", "ends")


@query(f"""WITH {CELLS} SELECT x, y, z, t, v, (x % 6 = 0 AND y % 6 = 0 AND z % 6 = 0 AND t % 6 = 0) AS metric, (x % 4 = 0 AND y % 4 = 0 AND z % 4 = 0 AND t % 4 = 0) AS route FROM cells
WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0 AND t % 2 = 0 AND ((x % 6 = 0 AND y % 6 = 0 AND z % 6 = 0 AND t % 6 = 0) OR (x % 4 = 0 AND y % 4 = 0 AND z % 4 = 0 AND t % 4 = 0))""")
def common_lattice(spark, sf_dir):
    """Cells of two sampling contracts, steps of 6 and of 4, read once on their common lattice."""
    on = lambda step: (F.col("x") % step == 0) & (F.col("y") % step == 0) & (F.col("z") % step == 0) & (F.col("t") % step == 0)
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem")).where(on(2))
    return cells.withColumn("metric", on(6)).withColumn("route", on(4)).where("metric or route")


@query(f"""WITH {CELLS}, h AS (SELECT *, (x % 16 = 0 OR (x >= 4 AND (x - 4) % 16 = 0)) AND (y % 8 = 0 OR (y >= 4 AND (y - 4) % 8 = 0)) AND z % 3 = 0 AS hit FROM leafed) SELECT leaf_id, count(*) AS n, round(sum(v), 6) AS total FROM h WHERE hit GROUP BY 1""")
def phased_lattice(spark, sf_dir):
    """A lattice with steps of 16, 8 and 3: where a step is a multiple of the leaf, a second phase starts at half a leaf."""
    hit = lattice.on_lattice("x", 16) & lattice.on_lattice("y", 8) & lattice.on_lattice("z", 3)
    return _cells(spark, sf_dir).where(hit).groupBy("leaf_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query(f"""WITH {CELLS}, p AS (SELECT i, CAST((i * 17) % 32 AS BIGINT) AS x, CAST((i * 29) % 32 AS BIGINT) AS y, CAST((i * 43) % 8 AS BIGINT) AS z, CAST((i * 7) % 16 AS BIGINT) AS t FROM range(257) r(i)) SELECT i, x, y, z, t, v IS NOT NULL AS held, coalesce(v, 0.0) AS v FROM p LEFT JOIN cells USING (x, y, z, t)""")
def probe_points(spark, sf_dir):
    """257 fixed positions looked up in the volume."""
    place = lambda f, n: F.expr(f"i * {f} % {n}")
    p = spark.range(257).withColumnRenamed("id", "i").select("i", place(17, W).alias("x"), place(29, H).alias("y"), place(43, 8).alias("z"), place(7, T).alias("t"))
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem"))
    return cells.join(F.broadcast(p), ["x", "y", "z", "t"], "right").select("i", "x", "y", "z", "t", F.col("v").isNotNull().alias("held"), F.coalesce("v", F.lit(0.0)).alias("v"))


@query(f"""WITH {CELLS}, l AS (SELECT DISTINCT CAST(floor(x / 8.0) AS BIGINT) AS bx, CAST(floor(y / 8.0) AS BIGINT) AS by_, CAST(floor(z / 8.0) AS BIGINT) AS bz, t FROM cells WHERE x < 28 AND y < 27 AND z < 6), s AS (SELECT *, unnest(range(512)) AS voxel FROM l),
a AS (SELECT *, least(27, bx * 8 + voxel % 8) AS x, least(26, by_ * 8 + voxel // 8 % 8) AS y, least(5, bz * 8 + voxel // 64) AS z FROM s), j AS (SELECT a.*, coalesce(v, 0.0) AS v FROM a LEFT JOIN cells USING (x, y, z, t))
SELECT bx, by_ AS "by", bz, t, count(*) AS n, round(sum(v), 6) AS total, max(v) AS high, round(sum(v * (voxel + 1)), 4) AS weighted FROM j GROUP BY 1, 2, 3, 4""")
def padded_edge_leaves(spark, sf_dir):
    """Leaves of a cropped volume of 28 x 27 x 6, filled to 512 values with the nearest cells of its edges."""
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem"))
    leaves = cells.where("x < 28 and y < 27 and z < 6").select(*[fields.block(a).alias(f"b{a}") for a in "xyz"], "t").distinct()
    filled = lattice.padded_leaves(cells, leaves, 28, 27, 6)
    return filled.groupBy("bx", "by", "bz", "t").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"), F.max("v").alias("high"), F.round(F.sum(F.col("v") * (F.col("voxel") + 1)), 4).alias("weighted"))


@query(f"""WITH {CELLS}, p AS (SELECT o_orderkey AS pid, (o_orderkey * 37 % 331) / 10.0::DOUBLE - 0.5 AS px, (o_orderkey * 53 % 317) / 10.0::DOUBLE AS py, (o_orderkey * 11 % 83) / 10.0::DOUBLE - 0.3 + 8 * (o_orderkey // 8192) AS pz, o_orderkey % 16 AS t FROM orders),
c AS (SELECT *, least(31.0::DOUBLE, greatest(0.0::DOUBLE, px)) AS ax, least(31.0::DOUBLE, greatest(0.0::DOUBLE, py)) AS ay, least(CAST({_DEPTH} - 1 AS DOUBLE), greatest(0.0::DOUBLE, pz)) AS az FROM p),
f AS (SELECT *, CAST(least(floor(ax), 30) AS BIGINT) AS lx, CAST(least(floor(ay), 30) AS BIGINT) AS ly, CAST(least(floor(az), {_DEPTH} - 2) AS BIGINT) AS lz, unnest(range(8)) AS k FROM c),
e AS (SELECT *, lx + k % 2 AS x, ly + k // 2 % 2 AS y, lz + k // 4 AS z, (CASE WHEN k % 2 = 1 THEN ax - lx ELSE 1 - (ax - lx) END) * (CASE WHEN k // 2 % 2 = 1 THEN ay - ly ELSE 1 - (ay - ly) END) * (CASE WHEN k // 4 = 1 THEN az - lz ELSE 1 - (az - lz) END) AS w FROM f)
SELECT pid, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz, t, round(sum(w * coalesce(v, 0.0)), 6) AS v FROM e LEFT JOIN cells USING (x, y, z, t) GROUP BY ALL""")
def dense_samples(spark, sf_dir):
    """Points between cells, some outside the volume, by trilinear interpolation with clamped edges."""
    e = F.expr
    p = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), e("(o_orderkey * 37 % 331) / 10.0D - 0.5D").alias("px"), e("(o_orderkey * 53 % 317) / 10.0D").alias("py"), e("(o_orderkey * 11 % 83) / 10.0D - 0.3D + 8 * (o_orderkey div 8192)").alias("pz"), e("o_orderkey % 16").alias("t"))
    sampled = lattice.between_cells(p, fields.field_cells(_table(spark, sf_dir, "lineitem")), W, H, _depth(spark, sf_dir))
    return sampled.select("pid", _r("px"), _r("py"), _r("pz"), "t", _r("v"))


@query(f"""WITH {CELLS}, leaves AS (SELECT DISTINCT leaf_id % 4 AS bx, leaf_id // 4 % 4 AS by_, leaf_id // 16 AS bz, t FROM leafed), g AS (SELECT bx, by_, bz, t, i, j, k, bx * 8 + i * 7 / 3.0::DOUBLE AS ax, by_ * 8 + j * 7 / 3.0::DOUBLE AS ay, bz * 8 + k * 7 / 3.0::DOUBLE AS az FROM leaves, range(4) a(i), range(4) b(j), range(4) c(k)),
f AS (SELECT *, CAST(least(floor(ax), 30) AS BIGINT) AS lx, CAST(least(floor(ay), 30) AS BIGINT) AS ly, CAST(least(floor(az), {_DEPTH} - 2) AS BIGINT) AS lz, unnest(range(8)) AS q FROM g),
e AS (SELECT *, lx + q % 2 AS x, ly + q // 2 % 2 AS y, lz + q // 4 AS z, (CASE WHEN q % 2 = 1 THEN ax - lx ELSE 1 - (ax - lx) END) * (CASE WHEN q // 2 % 2 = 1 THEN ay - ly ELSE 1 - (ay - ly) END) * (CASE WHEN q // 4 = 1 THEN az - lz ELSE 1 - (az - lz) END) AS w FROM f)
SELECT (bz * 4 + by_) * 4 + bx AS leaf_id, t, CAST((k * 4 + j) * 4 + i AS BIGINT) AS control, round(sum(w * coalesce(v, 0.0)), 6) AS v FROM e LEFT JOIN cells USING (x, y, z, t) GROUP BY 1, 2, 3""")
def sampled_control_grids(spark, sf_dir):
    """Control grids of 4 x 4 x 4 points of every leaf, sampled at the control points instead of fitted."""
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem"))
    leaves = _cells(spark, sf_dir).select("leaf_id", "t").distinct()
    grid = leaves.withColumn("control", F.explode(F.expr("sequence(0L, 63L)")))
    at = lambda block, i: F.col(block) * 8 + F.expr(f"control div {4**i} % 4") * 7 / F.lit(3.0)
    placed = grid.withColumns({"bx": F.expr("leaf_id % 4"), "by": F.expr("leaf_id div 4 % 4"), "bz": F.expr("leaf_id div 16")}).withColumn("pid", F.expr("(leaf_id * 16 + t) * 64 + control"))
    points = placed.select("pid", "leaf_id", "control", at("bx", 0).alias("px"), at("by", 1).alias("py"), at("bz", 2).alias("pz"), "t")
    return lattice.between_cells(points, cells, W, H, _depth(spark, sf_dir)).select("leaf_id", "t", "control", _r("v"))


@query("""WITH p AS (SELECT o_orderkey AS ray, o_orderkey % 64 AS px, o_orderkey // 64 % 48 AS py, o_custkey % 13 * 0.1::DOUBLE AS yaw, o_custkey % 7 * 0.05::DOUBLE - 0.1 AS pitch, 1.5 + o_custkey % 3 * 0.25::DOUBLE AS distance FROM orders),
o AS (SELECT *, cos(pitch) * sin(yaw) AS ox, sin(pitch) AS oy, cos(pitch) * cos(yaw) AS oz, (2 * (px + 0.5) / 64 - 1) * (64 / 48.0::DOUBLE) * tan(radians(40) / 2) AS sx, (1 - 2 * (py + 0.5) / 48) * tan(radians(40) / 2) AS sy FROM p),
r AS (SELECT *, oz / sqrt(ox * ox + oz * oz) AS rx, -ox / sqrt(ox * ox + oz * oz) AS rz FROM o), u AS (SELECT *, -rz * oy AS ux, rx * oz - rz * ox AS uy, -rx * oy AS uz FROM r),
d AS (SELECT *, -ox + rx * sx + ux * sy AS qx, -oy + uy * sy AS qy, -oz + rz * sx + uz * sy AS qz FROM u), n AS (SELECT *, sqrt(qx * qx + qy * qy + qz * qz) AS l, 16 + ox * distance * 32 AS cx, 16 + oy * distance * 32 AS cy, 4 + oz * distance * 32 AS cz FROM d),
e AS (SELECT ray, qx / l AS dx, qy / l AS dy, qz / l AS dz, cx, cy, cz FROM n), s AS (SELECT *, -cx / dx AS x0, (32 - cx) / dx AS x1, -cy / dy AS y0, (32 - cy) / dy AS y1, -cz / dz AS z0, (8 - cz) / dz AS z1 FROM e),
t AS (SELECT *, greatest(0, least(x0, x1), least(y0, y1), least(z0, z1)) AS n, least(greatest(x0, x1), greatest(y0, y1), greatest(z0, z1)) AS f FROM s)
SELECT ray, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz, CASE WHEN f > n THEN round(n, 4) END AS near, CASE WHEN f > n THEN round(f - n, 4) ELSE 0 END AS span FROM t""")
def orbit_rays(spark, sf_dir):
    """A perspective ray an order from a camera on an orbit, clipped to the volume's box."""
    e = F.expr
    p = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ray"), e("o_orderkey % 64").alias("px"), e("o_orderkey div 64 % 48").alias("py"), e("o_custkey % 13 * 0.1D").alias("yaw"), e("o_custkey % 7 * 0.05D - 0.1D").alias("pitch"), e("1.5D + o_custkey % 3 * 0.25D").alias("distance"))
    rays = lattice.orbit_rays(p, 64, 48, (32.0, 32.0, 8.0), F.col("yaw"), F.col("pitch"), F.col("distance"), 40.0)
    return rays.select("ray", _r("dx"), _r("dy"), _r("dz"), F.when(F.col("hit"), F.round("near", 4)).alias("near"), F.when(F.col("hit"), F.round(e("far - near"), 4)).otherwise(0.0).alias("span"))


_BINS = ", ".join(f"round(sum(CASE WHEN bin = {b} THEN v ELSE 0 END), 6) AS bin{b}" for b in range(8))


@query(f"""WITH {CELLS}, r AS (SELECT DISTINCT y AS py, z AS pz, t FROM cells), s AS (SELECT *, unnest(range(48)) AS i FROM r), a AS (SELECT *, CAST(floor((i + 0.5) * 32 / 48.0) AS BIGINT) AS x, least(i * 8 // 48, 7) AS bin FROM s)
SELECT py, pz, a.t, count(*) AS steps, round(sum(coalesce(v, 0.0)) * 32 / 48, 6) AS integral, {_BINS.replace('v ELSE', 'coalesce(v, 0.0) ELSE')} FROM a LEFT JOIN cells c ON c.x = a.x AND c.y = py AND c.z = pz AND c.t = a.t GROUP BY 1, 2, 3""")
def depth_bins(spark, sf_dir):
    """Rays along x with 48 midpoint steps: the integral, and the sums of eight depth bins."""
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem"))
    steps = cells.select(F.col("y").alias("py"), F.col("z").alias("pz"), "t").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(47))))
    steps = steps.select("py", "pz", "t", F.floor((F.col("i") + 0.5) * W / F.lit(48.0)).alias("x"), F.least(F.expr("i * 8 div 48"), F.lit(7)).alias("bin"))
    hit = steps.join(cells.withColumnRenamed("y", "py").withColumnRenamed("z", "pz"), ["py", "pz", "t", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    bins = [F.round(F.sum(F.when(F.col("bin") == b, F.col("v")).otherwise(0.0)), 6).alias(f"bin{b}") for b in range(8)]
    return hit.groupBy("py", "pz", "t").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum("v") * W / 48, 6).alias("integral"), *bins)


_SUB = (lattice.sub_start(32, 12), lattice.sub_start(32, 20, 30), lattice.sub_start(8, 9), lattice.sub_start(16, 6, 4))


@query(f"""WITH {CELLS}, s AS (SELECT x - 10 AS x, y - 12 AS y, z, t - 4 AS t, v FROM cells WHERE x BETWEEN 10 AND 21 AND y BETWEEN 12 AND 31 AND z BETWEEN 0 AND 8 AND t BETWEEN 4 AND 9)
SELECT t, count(*) AS n, min(v) AS low, max(v) AS high, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM s GROUP BY 1""")
def subvolume(spark, sf_dir):
    """A part of the volume in space and time, from the middle of x and as wanted of the others, with the bounds of its values."""
    x, y, z, t = _SUB
    part = fields.cropped(fields.field_cells(_table(spark, sf_dir, "lineitem")), (x, y, z), (12, 20, 9)).where(F.col("t").between(t, t + 5)).withColumn("t", F.col("t") - t)
    return part.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
