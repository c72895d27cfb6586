"""Registered queries of keyframes, polynomial fits and marches along rays, with their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fields, fits, series
from ..sources.shared import written
from .catalog import CELLS, SERIES, STATE, _cells, _r, _series, _table, query


def _split_sql(rows):
    """Keys of a table d (id, t, v, eps) by splitting at the worst place."""
    return f"""{rows}, seg AS (SELECT id, min(t) AS a, max(t) AS b FROM d GROUP BY 1 UNION ALL
SELECT id, unnest([a, m.t]) AS a, unnest([m.t, b]) AS b FROM (SELECT s.id, s.a, s.b, min({{'e': -abs(d.v - (p.v + (d.t - s.a) / CAST(s.b - s.a AS DOUBLE) * (q.v - p.v))) / d.eps, 't': d.t}}) AS m
FROM seg s JOIN d ON d.id = s.id AND d.t > s.a AND d.t < s.b JOIN d p ON p.id = s.id AND p.t = s.a JOIN d q ON q.id = s.id AND q.t = s.b GROUP BY 1, 2, 3) WHERE m.e < -1),
keys AS (SELECT DISTINCT id, unnest([a, b]) AS t FROM seg)"""


@query(f"""WITH RECURSIVE {SERIES}, {_split_sql("d AS (SELECT user_id AS id, t, CAST(cents AS DOUBLE) AS v, 9000.0::DOUBLE AS eps FROM series)")}, f AS (SELECT user_id, stddev_pop(cents) < 8000 AS flat, min(t) AS first FROM series GROUP BY 1),
s AS (SELECT *, {STATE} AS state FROM series), b AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY t) AS before FROM s), p AS (SELECT user_id, unnest([t - 1, t, t + 1]) AS t FROM b WHERE before <> state),
k AS (SELECT id AS user_id, t FROM keys UNION SELECT user_id, t FROM p JOIN series USING (user_id, t)) SELECT DISTINCT user_id, t FROM k JOIN f USING (user_id) WHERE NOT flat UNION SELECT user_id, first FROM f WHERE flat""")
def guarded_keyframes(spark, sf_dir):
    """Keyframes with the shortcut for nearly constant series, and with crossings of a cutoff protected."""
    s = _series(spark, sf_dir)
    near = series.around(series.crossings(s, "user_id", "cents", 15000, 3000).select("user_id", "t"), "user_id", 29)
    return fits.guarded_keys(s, "user_id", "cents", "9000", 8000, near)


@query(f"""WITH RECURSIVE {CELLS}, m AS (SELECT leaf_id AS id, t, round(avg(v), 6) AS v FROM leafed GROUP BY 1, 2), {_split_sql("d AS (SELECT *, 0.4::DOUBLE AS eps FROM m)")} SELECT id AS leaf_id, t, v FROM keys JOIN m USING (id, t)""")
def mean_series_keyframes(spark, sf_dir):
    """Keyframes of every leaf's mean over its voxels."""
    m = _cells(spark, sf_dir).groupBy("leaf_id", "t").agg(F.round(F.avg("v"), 6).alias("v"))
    return fits.adaptive_keys(m, "leaf_id", "v", "0.4e0")


@query(f"""WITH RECURSIVE {CELLS}, top AS (SELECT z * 1024 + y * 32 + x AS id, max(v) < 25 AS quiet FROM cells GROUP BY 1), {_split_sql("d AS (SELECT z * 1024 + y * 32 + x AS id, t, v, 12.0::DOUBLE AS eps FROM cells JOIN top ON top.id = z * 1024 + y * 32 + x WHERE NOT quiet)")},
k AS (SELECT id, t, v FROM keys JOIN d USING (id, t)), r AS (SELECT d.id, d.t, d.v, a.t AS t0, a.v AS v0 FROM d ASOF JOIN k a ON a.id = d.id AND d.t >= a.t), l AS (SELECT r.*, b.t AS t1, b.v AS v1 FROM r ASOF JOIN k b ON b.id = r.id AND r.t <= b.t),
p AS (SELECT id, t, v, CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / CAST(t1 - t0 AS DOUBLE) END AS p FROM l), n AS (SELECT id // 8192 AS slab, count(*) AS keys FROM keys GROUP BY 1), z AS (SELECT id // 8192 AS slab, count(*) AS voxels, count(*) FILTER (quiet) AS background FROM top GROUP BY 1)
SELECT z.slab, voxels, background, coalesce(keys, 0) AS keys, round(sqrt(avg((v - p) * (v - p))), 6) AS rmse, round(max(abs(v - p)), 6) AS peak FROM z LEFT JOIN n USING (slab) LEFT JOIN p ON p.id // 8192 = z.slab GROUP BY 1, 2, 3, 4""")
def temporal_probe(spark, sf_dir):
    """Every voxel's series by keyframes, background voxels as nothing: keys and errors by slab of 8 planes."""
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem")).select(F.expr("z * 1024 + y * 32 + x").alias("id"), "t", "v")
    top = cells.groupBy("id").agg((F.max("v") < 25).alias("quiet"))
    loud = cells.join(top.where("not quiet"), "id", "left_semi")
    keys = written(fits.adaptive_keys(loud, "id", "v", "12e0").select("id", "t"), "keys")
    marked = loud.join(keys.withColumn("is_key", F.lit(True)), ["id", "t"], "left").withColumn("is_key", F.coalesce("is_key", F.lit(False)))
    slab = F.expr("id div 8192").alias("slab")
    p = series.interpolated(marked, "id", "v", F.col("is_key")).groupBy(slab).agg(F.round(F.sqrt(F.avg(F.expr("(v - p) * (v - p)"))), 6).alias("rmse"), F.round(F.max(F.abs(F.expr("v - p"))), 6).alias("peak"))
    z = top.groupBy(slab).agg(F.count(F.lit(1)).alias("voxels"), F.count_if(F.col("quiet")).alias("background"))
    n = keys.groupBy(slab).agg(F.count(F.lit(1)).alias("keys"))
    return z.join(n, "slab", "left").join(p, "slab", "left").withColumn("keys", F.coalesce("keys", F.lit(0).cast("long")))


@query(None)
def budget_keyframes(spark, sf_dir):
    """The six keyframes of each series that leave the least squared error: a table of best ways, which SQL has no form for."""
    return fits.budget_keys(_series(spark, sf_dir), "user_id", "cents", 6).select("user_id", "t", "v", F.round("sse", 3).alias("sse"))


@query(None)
def polynomial_fits(spark, sf_dir):
    """Polynomials of eight terms fitted to every leaf and frame; a system of eight equations has no short form in SQL."""
    return fits.polynomial_fit(_cells(spark, sf_dir), ["leaf_id", "t"]).withColumn("c", F.round("c", 6))


@query(f"""WITH {CELLS}, s AS (SELECT x, y, t, z, v - 25 AS phi FROM cells), e AS (SELECT x, y, t, min(z) FILTER (phi <= 0) AS entry FROM s GROUP BY 1, 2, 3), o AS (SELECT s.x, s.y, s.t, entry, min(z) FILTER (phi > 0 AND z > entry) AS way_out, max(z) AS last FROM s JOIN e USING (x, y, t) WHERE entry IS NOT NULL GROUP BY 1, 2, 3, 4),
d AS (SELECT o.x, o.y, o.t, entry, coalesce(way_out, last + 1) - entry AS thickness, coalesce(sum(s.v), 0) AS above FROM o LEFT JOIN cells s ON s.x = o.x AND s.y = o.y AND s.t = o.t AND s.z < entry GROUP BY 1, 2, 3, 4, 5)
SELECT x, y, t, CAST(entry AS BIGINT) AS entry, CAST(thickness AS BIGINT) AS thickness, round(exp(-0.02 * above), 6) AS light FROM d""")
def ray_marches(spark, sf_dir):
    """Rays along z: where each enters the level set, how far it stays inside, and how much light reaches the entry from above."""
    s = fields.field_cells(_table(spark, sf_dir, "lineitem")).select("x", "y", "t", "z", "v", (F.col("v") <= 25).alias("inside"))
    ray = Window.partitionBy("x", "y", "t")
    s = s.withColumn("entry", F.min(F.when(F.col("inside"), F.col("z"))).over(ray)).where("entry is not null")
    leaves = F.min(F.when(~F.col("inside") & (F.col("z") > F.col("entry")), F.col("z")))
    d = s.groupBy("x", "y", "t", "entry").agg((F.coalesce(leaves, F.max("z") + 1) - F.col("entry")).alias("thickness"), F.sum(F.when(F.col("z") < F.col("entry"), F.col("v")).otherwise(0.0)).alias("above"))
    return d.select("x", "y", "t", "entry", "thickness", F.round(F.exp(-0.02 * F.col("above")), 6).alias("light"))
