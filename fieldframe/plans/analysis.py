"""Registered queries of fits, shapes, files and streams, with their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields, fits, surfaces
from ..sources import raw
from ..sources.shared import new_path, written
from ..streaming import windows
from .catalog import CELLS, SERIES, D, H, PEAK, W, T, _cells, _paired, _r, _series, _table, query


@query(f"""WITH RECURSIVE {SERIES}, d AS (SELECT user_id, t, CAST(cents AS DOUBLE) AS v, 2000 + 0.05 * abs(cents) AS eps FROM series),
seg AS (SELECT user_id, min(t) AS a, max(t) AS b FROM d GROUP BY 1 UNION ALL
SELECT user_id, unnest([a, m.t]) AS a, unnest([m.t, b]) AS b FROM (SELECT s.user_id, s.a, s.b, min({{'e': -abs(d.v - (p.v + (d.t - s.a) / CAST(s.b - s.a AS DOUBLE) * (q.v - p.v))) / d.eps, 't': d.t}}) AS m
FROM seg s JOIN d ON d.user_id = s.user_id AND d.t > s.a AND d.t < s.b JOIN d p ON p.user_id = s.user_id AND p.t = s.a JOIN d q ON q.user_id = s.user_id AND q.t = s.b GROUP BY 1, 2, 3) WHERE m.e < -1)
SELECT d.user_id, d.t, d.v FROM d JOIN (SELECT user_id, unnest([a, b]) AS t FROM seg) USING (user_id, t) GROUP BY ALL""")
def adaptive_keyframes(spark, sf_dir):
    """Keyframes of every series by splitting at the worst error."""
    return fits.adaptive_keys(_series(spark, sf_dir), "user_id", "cents", "2000 + 0.05 * abs(cents)")


def _axis(a, divisor, k):
    return f"(1 / 8.0 + (voxel // {divisor} % 8 - 3.5) * {k - 0.5} * 7 / 42.0)"


_FIT = ", ".join(f"round(sum(v * {_axis('z', 64, k >> 2 & 1)} * {_axis('y', 8, k >> 1 & 1)} * {_axis('x', 1, k & 1)}) / 49, 6)" for k in range(8))


@query(f"""WITH {CELLS}, f AS (SELECT leaf_id, t, [{_FIT}] AS c FROM leafed GROUP BY 1, 2) SELECT leaf_id, t, CAST(unnest(range(8)) AS BIGINT) AS control, unnest(c) AS c FROM f""")
def control_grid_fit(spark, sf_dir):
    """Least-squares 2 x 2 x 2 control grids of every leaf and frame, over the span of values (1 to 50); in SQL the pseudo-inverse is a closed form."""
    return fits.control_fit(_cells(spark, sf_dir), 2).select("leaf_id", "t", F.col("control").cast("long").alias("control"), _r("c", "c / 49"))


_B = "(CASE WHEN {k} = 0 THEN sqrt(1 / 8.0) ELSE sqrt(2 / 8.0) END * cos(pi() / 8 * ({i} + 0.5) * {k}))"
_STEP = "SELECT leaf_id, t, {keep}, k, sum(v * " + _B.format(k="k", i="{i}") + ") AS v FROM (SELECT *, unnest(range(8)) AS k FROM {frm}) GROUP BY ALL"


@query(f"""WITH {CELLS}, a AS ({_STEP.format(keep="voxel // 8 AS zy", i="voxel % 8", frm="leafed")}), a1 AS (SELECT leaf_id, t, zy, k AS kx, v FROM a),
b AS ({_STEP.format(keep="zy // 8 AS z, kx", i="zy % 8", frm="a1")}), b1 AS (SELECT leaf_id, t, z, kx, k AS ky, v FROM b),
c AS ({_STEP.format(keep="kx, ky", i="z", frm="b1")}) SELECT leaf_id, t, round(sum(v * v), 6) AS total, round(sum(v * v) FILTER (greatest(k, kx, ky) = 0) / sum(v * v), 6) AS dc, round(sum(v * v) FILTER (greatest(k, kx, ky) < 2) / sum(v * v), 6) AS low, round(sum(v * v) FILTER (greatest(k, kx, ky) >= 4) / sum(v * v), 6) AS high FROM c GROUP BY 1, 2""")
def cosine_energies(spark, sf_dir):
    """Energy of every leaf's frame and the shares of three bands of 3-D cosine coefficients."""
    return fits.cosine_energies(_cells(spark, sf_dir)).select("leaf_id", "t", _r("total"), *[_r(c, f"{c} / total") for c in ("dc", "low", "high")])


@query(f"""WITH {SERIES}, d AS (SELECT user_id, CAST(cents AS DOUBLE) AS v, 1 + t % 3 AS w, sqrt(1 / 30.0) AS p, sqrt(2 / 30.0) * cos(pi() / 30 * (t + 0.5)) AS q FROM series),
s AS (SELECT user_id, sum(w * p * p) AS a, sum(w * p * q) AS b, sum(w * q * q) AS d, sum(w * v * p) AS e, sum(w * v * q) AS f, count(*) AS n, sum(v * p) AS g, sum(v * q) AS h FROM d GROUP BY 1)
SELECT user_id, CAST(unnest([0, 1]) AS BIGINT) AS k, round(unnest(CASE WHEN n > 1 THEN [(e * d - b * f) / (a * d - b * b), (a * f - b * e) / (a * d - b * b)] ELSE [g, h] END), 3) AS c FROM s""")
def weighted_cosine_fit(spark, sf_dir):
    """Two cosine coefficients of every series by weighted least squares."""
    return fits.weighted_cosines(_series(spark, sf_dir), "user_id", "cents", "1 + t % 3", 30, 2).withColumn("c", F.round("c", 3))


@query(None)
def leaf_clusters(spark, sf_dir):
    """Greedy clusters of voxel series by leaf: the order decides, so SQL has no form for it."""
    return fits.leaf_clusters(_cells(spark, sf_dir), T, 6.0, 0.5, 3.0)


@query(f"""WITH RECURSIVE {CELLS}, n AS (SELECT ((t * 8388608 + z) * 32 + y) * 32 + x AS a, x, y, z FROM cells WHERE v >= 40),
e AS (SELECT p.a, q.a AS b FROM n p JOIN n q ON (q.a = p.a + 1 AND p.x < 31) OR (q.a = p.a + 32 AND p.y < 31) OR q.a = p.a + 1024), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, a AS root FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.a WHERE r.root < u.b), l AS (SELECT a, min(root) AS component FROM r GROUP BY 1)
SELECT CAST(component // 8589934592 AS BIGINT) AS t, component, count(*) AS cells FROM l GROUP BY 2""")
def visible_components(spark, sf_dir):
    """Connected parts of what is visible in every frame, with their sizes."""
    parts = surfaces.visible_parts(_cells(spark, sf_dir).where("v >= 40"), W, H, D)
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("cells")).select(F.expr(f"component div {W * H * D}L").alias("t"), "component", "cells")


@query(f"""WITH {CELLS}, p AS (SELECT x, y, t, z, floor(v) - 24.5 AS p1, lag(z) OVER w AS z0, lag(floor(v) - 24.5) OVER w AS p0 FROM cells WINDOW w AS (PARTITION BY x, y, t ORDER BY z)),
f AS (SELECT x, y, t, min({{'z1': z, 'z0': z0, 'p0': p0, 'p1': p1}}) AS c FROM p WHERE p0 > 0 AND p1 <= 0 GROUP BY 1, 2, 3)
SELECT x, y, t, round(c.z0 + (c.z1 - c.z0) * ((ceil(32 * c.p0 / (c.p0 - c.p1)) - 1) / 32 + 1 / 64.0), 6) AS hit FROM f""")
def level_set_hits(spark, sf_dir):
    """Where rays along z first enter the level set, by five halvings; in SQL a closed form."""
    samples = _cells(spark, sf_dir).withColumn("phi", F.floor("v") - F.lit(24.5).cast("double"))
    return surfaces.first_hits(samples, ["x", "y", "t"], "z", "phi", 5).select("x", "y", "t", _r("hit"))


@query(f"""WITH {CELLS}, s AS (SELECT t, x, y, z, ((z * 32 + y) * 32) + x AS id FROM cells WHERE v >= 46), d AS (SELECT a.t, a.id, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d2 FROM s a JOIN s b ON b.t = a.t + 1 GROUP BY 1, 2)
SELECT t, count(*) AS n, round(avg(sqrt(d2)), 6) AS chamfer, round(avg(d2), 6) AS chamfer2, CAST(max(d2) AS BIGINT) AS hausdorff2 FROM d GROUP BY 1""")
def surface_distances(spark, sf_dir):
    """Distances of every frame's bright points to the next frame's."""
    s = written(_cells(spark, sf_dir).where("v >= 46").select("t", F.expr(f"(z * {H} + y) * {W} + x").alias("id"), "x", "y", "z"), "bright")
    # every distance is within the volume's own extent
    deepest = s.agg(F.coalesce(F.max("z"), F.lit(0))).first()[0]
    extent = max(W, H, deepest + 1)
    d = surfaces.nearest(s, s.select((F.col("t") - 1).alias("t"), "x", "y", "z"), "t", extent)
    return d.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.sqrt("d2")), 6).alias("chamfer"), F.round(F.avg("d2"), 6).alias("chamfer2"), F.max("d2").cast("long").alias("hausdorff2"))


@query(f"""WITH {CELLS}, i AS (SELECT t, x AS px, y AS py, avg(v) AS a, avg(p) AS b FROM paired GROUP BY 1, 2, 3), k AS (SELECT t, floor(px / 8.0) AS bx, floor(py / 8.0) AS by_, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cov, count(*) AS n, sum((a - b) * (a - b)) AS sse, sum(abs(a - b)) AS sae, max(abs(a - b)) AS top FROM i GROUP BY 1, 2, 3)
SELECT t, CAST(sum(n) AS BIGINT) AS n, round(sum(sse) / sum(n), 6) AS mse, round(sum(sae) / sum(n), 6) AS mae, round(max(top), 6) AS max_ae, round(avg((2 * ma * mb + 0.25) * (2 * cov + 2.25) / ((ma * ma + mb * mb + 0.25) * (va + vb + 2.25))), 6) AS ssim FROM k GROUP BY 1""")
def image_likeness(spark, sf_dir):
    """Projections of every frame against those of its prediction: errors and structural similarity."""
    image = _paired(spark, sf_dir).groupBy("t", F.col("x").alias("px"), F.col("y").alias("py")).agg(F.avg("v").alias("a"), F.avg("p").alias("b"))
    return surfaces.image_likeness(image, "t", 8, PEAK).select("t", "n", *[_r(c) for c in ("mse", "mae", "max_ae", "ssim")])


@query(f"""WITH {CELLS} SELECT x, y, z, t, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS v FROM cells""")
def raw_round_trip(spark, sf_dir):
    """Every slice of the volume written as a raw file and read back."""
    folder = new_path(spark, "slices")
    written(raw.write_slices(fields.field_cells(_table(spark, sf_dir, "lineitem")), folder, W, H), "slice-manifest")
    return raw.read_slices(spark, folder, W, H).select("x", "y", "z", "t", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("""WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2)
SELECT date_diff('day', DATE '1970-01-01', CAST(day AS DATE)) AS day, event_type, n, cents FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def streamed_days(spark, sf_dir):
    """Daily sums of the event stream, of the days that its watermark has closed."""
    return windows.drained(spark, f"{sf_dir}/events*.parquet")
