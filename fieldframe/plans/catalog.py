"""Registered field queries and their DuckDB equivalents.

The driver's tables hold no volumes; lineitem stands for a sparse volume of 32 x 32 cells a
plane and 16 frames, whose depth grows with the orders, events for daily series by user,
embeddings for 4 x 4 x 4 control grids, and the dimension tables for manifests. Doubles are
rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import codec, fields, metrics, ranks, series

W, H, D, T = 32, 32, fields.DEEPEST, 16
PEAK = 50.0

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}

CELLS = """cells AS (SELECT l_partkey % 32 AS x, l_suppkey % 32 AS y, l_orderkey % 8 + 8 * (l_orderkey // 8192) AS z,
  CAST((year(l_shipdate) * 12 + month(l_shipdate)) % 16 AS BIGINT) AS t, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
leafed AS (SELECT *, CAST(floor(z / 8.0) * 16 + floor(y / 8.0) * 4 + floor(x / 8.0) AS BIGINT) AS leaf_id, (z % 8 * 8 + y % 8) * 8 + x % 8 AS voxel FROM cells),
paired AS (SELECT *, avg(v) OVER (PARTITION BY leaf_id, t) AS p, avg(v) OVER (PARTITION BY leaf_id) AS p0 FROM leafed)"""
SERIES = """series AS (SELECT user_id, CAST(day(ts) - 1 AS BIGINT) AS t, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2)"""


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark, sf_dir):
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem"))
    return cells.withColumn("leaf_id", fields.leaf_id(W, H, D)).withColumn("voxel", fields.local_voxel())


def _paired(spark, sf_dir):
    """Cells with two predictions: the mean of leaf and frame, and that of the leaf. Means are partial aggregates that are joined back."""
    cells = _cells(spark, sf_dir)
    sums = cells.groupBy("leaf_id", "t").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = sums.groupBy("leaf_id").agg((F.sum("s") / F.sum("n")).alias("p0"))
    means = sums.select("leaf_id", "t", (F.col("s") / F.col("n")).alias("p")).join(whole, "leaf_id")
    return cells.join(means, ["leaf_id", "t"])


def _leafwise(spark, sf_dir):
    """Cells with the mean of leaf and frame, laid out by leaf. The window holds a leaf's frame, 512 cells at most."""
    cells = fields.leaf_cells(_table(spark, sf_dir, "lineitem"), fields.leaf_id(W, H, D))
    return cells.withColumn("p", F.avg("v").over(Window.partitionBy("leaf_id", "t")))


def _series(spark, sf_dir):
    return fields.event_series(_table(spark, sf_dir, "events")).withColumn("cents", F.col("cents").cast("long"))


def _r(name, expr=None):
    return F.round(F.expr(expr or name), 6).alias(name)


def query(sql: str | None):
    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {CELLS}, frames AS (SELECT leaf_id, t, max(v) AS top, max(v) - min(v) AS spread FROM leafed GROUP BY 1, 2),
win AS (SELECT leaf_id, coalesce(min(CASE WHEN top > 0.25 * 190 OR spread > 0.5 * 97.5 THEN t END), 0) AS first_frame, coalesce(max(CASE WHEN top > 0.25 * 190 OR spread > 0.5 * 97.5 THEN t END), 0) AS last_frame FROM frames GROUP BY 1),
agg AS (SELECT leaf_id, count(*) AS n, min(v) AS low, max(v) AS high, round(max(v) - min(v), 6) AS spread, round(avg(v), 6) AS mean FROM leafed GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY spread DESC, n DESC, leaf_id) AS place FROM agg JOIN win USING (leaf_id)""")
def leaf_overview(spark, sf_dir):
    """Per leaf count, range and active window, ranked by spread over all leaves."""
    cells = _cells(spark, sf_dir)
    frames = cells.groupBy("leaf_id", "t").agg(F.max("v").alias("top"), (F.max("v") - F.min("v")).alias("spread"))
    leaves = cells.groupBy("leaf_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.max("v") - F.min("v"), 6).alias("spread"), F.round(F.avg("v"), 6).alias("mean")
    )
    found = leaves.join(series.active_window(frames, "leaf_id", 190, 97.5), "leaf_id")
    return ranks.ranked(found, [F.desc("spread"), F.desc("n"), F.col("leaf_id")], "place")


@query(f"""WITH {CELLS} SELECT x, y, z, t, leaf_id, voxel, ((t * 8388608 + z) * 32 + y) * 32 + x AS frame_major, ((z * 32 + y) * 32 + x) * 16 + t AS time_fastest,
CAST(floor(x / 32.0) AS BIGINT) AS root, (x >> 3) & 3 AS inner_x, x & 7 AS local_x, xor(xor(x >> 3, (y >> 3) << 21), (z >> 3) << 42) AS block_key,
leaf_id % 4 AS bx, CAST(floor(leaf_id / 4.0) AS BIGINT) % 4 AS by_, CAST(floor(leaf_id / 16.0) AS BIGINT) AS bz FROM leafed""")
def cell_addresses(spark, sf_dir):
    """Every address of a cell: leaf, voxel, both storage orders, tree levels, packed block key, and blocks from the leaf id."""
    e = F.expr
    return _cells(spark, sf_dir).select(
        "x", "y", "z", "t", "leaf_id", "voxel",
        e(f"((t * {D} + z) * 32 + y) * 32 + x").alias("frame_major"), e("((z * 32 + y) * 32 + x) * 16 + t").alias("time_fastest"),
        e("cast(floor(x / 32.0) as bigint)").alias("root"), e("shiftright(x, 3) & 3").alias("inner_x"), e("x & 7L").alias("local_x"),
        e("shiftright(x, 3) ^ shiftleft(shiftright(y, 3), 21) ^ shiftleft(shiftright(z, 3), 42)").alias("block_key"),
        e("leaf_id % 4").alias("bx"), e("cast(floor(leaf_id / 4.0) as bigint) % 4").alias("by_"), e("cast(floor(leaf_id / 16.0) as bigint)").alias("bz"),
    )


@query(f"""WITH {CELLS} SELECT x - 4 AS x, y - 6 AS y, z - 1 AS z, t, v FROM cells WHERE x BETWEEN 4 AND 19 AND y BETWEEN 6 AND 15 AND z BETWEEN 1 AND 6 AND t BETWEEN 3 AND 12""")
def crop_box(spark, sf_dir):
    """A box of 16 x 10 x 6 cells in frames 3 to 12, moved to the origin."""
    return fields.cropped(fields.field_cells(_table(spark, sf_dir, "lineitem")), (4, 6, 1), (16, 10, 6)).where("t between 3 and 12")


@query(f"""WITH {CELLS} SELECT leaf_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n, round(sum(v), 6) AS total FROM leafed
WHERE x BETWEEN 5 AND 18 AND y BETWEEN 9 AND 14 AND z BETWEEN 0 AND 7 GROUP BY 1""")
def leaf_pruned_range(spark, sf_dir):
    """A range query whose coordinate predicate also names the leaves it touches."""
    inside = fields.leaf_range(_cells(spark, sf_dir), (5, 18), (9, 14), (0, 7), W, H)
    return inside.groupBy("leaf_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query(f"""WITH {CELLS} SELECT leaf_id, count(*) AS n, round(avg(abs(v - p)), 6) AS mean_abs, round(sqrt(avg((v - p) * (v - p))), 6) AS rmse, round(max(abs(v - p)), 6) AS max_abs,
round(20 * log10(greatest(max(v), 1e-12) / sqrt(avg((v - p) * (v - p)))), 6) AS psnr FROM paired GROUP BY 1""")
def leaf_errors(spark, sf_dir):
    """Error of the leaf-and-frame mean by leaf."""
    return metrics.error_stats(_paired(spark, sf_dir), "leaf_id").select("leaf_id", "n", _r("mean_abs"), _r("rmse"), _r("max_abs"), _r("psnr"))


def _ranked_sql(pick):
    return f"""WITH {CELLS}, e AS (SELECT leaf_id, abs(v - p) AS e FROM paired), r AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY e) - 1 AS i, count(*) OVER (PARTITION BY leaf_id) AS n FROM e)
SELECT leaf_id, round(e, 6) AS percentile FROM r WHERE i = {pick}"""


@query(_ranked_sql("least(n - 1, CAST(floor(n * 99 / 100.0) AS BIGINT))"))
def error_p99_floor(spark, sf_dir):
    """Exact 99th percentile of errors by leaf, at place floor(0.99 n)."""
    e = _paired(spark, sf_dir).select("leaf_id", F.abs(F.expr("v - p")).alias("e"))
    return metrics.floor_percentile(e, "leaf_id", "e", 99, 100).select("leaf_id", _r("percentile"))


@query(_ranked_sql("CAST(floor((n - 1) * 9 / 10.0) AS BIGINT)"))
def error_p90_last_floor(spark, sf_dir):
    """The other floor rule: place floor(0.9 (n - 1))."""
    e = _paired(spark, sf_dir).select("leaf_id", F.abs(F.expr("v - p")).alias("e"))
    return metrics.floor_percentile(e, "leaf_id", "e", 9, 10, last=True).select("leaf_id", _r("percentile"))


@query(f"""WITH {CELLS}, e AS (SELECT leaf_id, abs(v - p) AS e FROM paired) SELECT leaf_id, round(min(e), 6) AS low, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.9), 6) AS p90,
round(quantile_cont(e, 0.95), 6) AS p95, round(quantile_cont(e, 0.99), 6) AS p99, round(max(e), 6) AS high FROM e GROUP BY 1""")
def error_profile(spark, sf_dir):
    """Profile line of errors by leaf with interpolated percentiles."""
    e = _paired(spark, sf_dir).select("leaf_id", F.abs(F.expr("v - p")).alias("e"))
    places = [F.round(F.percentile("e", F.lit(q)), 6).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))]
    return e.groupBy("leaf_id").agg(F.round(F.min("e"), 6).alias("low"), F.round(F.avg("e"), 6).alias("mean"), *places, F.round(F.max("e"), 6).alias("high"))


@query(f"""WITH {CELLS}, e AS (SELECT abs(v - p) AS e FROM paired), s AS (SELECT max(e) AS top, count(*) AS n FROM e), b AS (SELECT CAST(floor(e / top * 4095) AS BIGINT) AS bin, count(*) AS c FROM e, s GROUP BY 1),
r AS (SELECT bin, sum(c) OVER (ORDER BY bin) AS run FROM b) SELECT (SELECT n FROM s) AS n, min(bin) AS bin, round((min(bin) + 1) / 4095 * (SELECT top FROM s), 6) AS edge FROM r WHERE run >= ceil(0.99 * (SELECT n FROM s))""")
def error_tail_histogram(spark, sf_dir):
    """The 99th percentile of all errors from a histogram of 4096 bins."""
    e = _paired(spark, sf_dir).select(F.abs(F.expr("v - p")).alias("e"))
    return metrics.histogram_tail(e, "e", 4096, 0.99).select("n", "bin", _r("edge"))


@query(f"""WITH {CELLS}, e AS (SELECT *, round(abs(v - p), 9) AS e FROM paired), r AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY e DESC, t, z, y, x) AS k FROM e)
SELECT leaf_id, x, y, z, t, round(v, 6) AS v, round(p, 6) AS p, round(e, 6) AS e FROM r WHERE k = 1""")
def worst_voxel(spark, sf_dir):
    """Where each leaf's largest error lies; ties go to the first in t, z, y, x order."""
    e = _paired(spark, sf_dir).withColumn("e", F.round(F.abs(F.expr("v - p")), 9))
    best = F.max_by(F.struct("x", "y", "z", "t", "v", "p", "e"), F.struct("e", -F.col("t"), -F.col("z"), -F.col("y"), -F.col("x"))).alias("b")
    return e.groupBy("leaf_id").agg(best).select("leaf_id", "b.x", "b.y", "b.z", "b.t", _r("v", "b.v"), _r("p", "b.p"), _r("e", "b.e"))


@query(f"""WITH {CELLS}, e AS (SELECT leaf_id, round(abs(v - p), 9) AS a, round(abs(v - p0), 9) AS b FROM paired) SELECT leaf_id, count(*) FILTER (a < b) AS improved, count(*) FILTER (a > b) AS worsened, count(*) AS n FROM e GROUP BY 1""")
def improved_worsened(spark, sf_dir):
    """How many cells the finer prediction brings nearer or farther."""
    e = _paired(spark, sf_dir).select("leaf_id", F.round(F.abs(F.expr("v - p")), 9).alias("a"), F.round(F.abs(F.expr("v - p0")), 9).alias("b"))
    return e.groupBy("leaf_id").agg(F.count_if(F.col("a") < F.col("b")).alias("improved"), F.count_if(F.col("a") > F.col("b")).alias("worsened"), F.count(F.lit(1)).alias("n"))


MODES = "CASE WHEN v < 15 THEN 'low' WHEN v < 35 THEN 'middle' ELSE 'high' END"


@query(f"""WITH {CELLS}, m AS (SELECT {MODES} AS mode, v, p FROM paired) SELECT coalesce(mode, 'TOTAL') AS mode, count(*) AS n, round(sqrt(avg((v - p) * (v - p))), 6) AS rmse, round(max(abs(v - p)), 6) AS max_abs,
count(*) FILTER (abs(v - p) <= 5) AS within_5, count(*) FILTER (abs(v - p) > 5 AND abs(v - p) <= 15) AS within_15, count(*) FILTER (abs(v - p) > 15) AS beyond FROM m GROUP BY ROLLUP (mode)""")
def mode_summary(spark, sf_dir):
    """Errors by mode with a total row and bucket counts."""
    # to nine places: an error that lies on a bound is on it in whatever order its mean was summed
    m = _paired(spark, sf_dir).select(F.expr(MODES).alias("mode"), F.abs(F.expr("v - p")).alias("e")).withColumn("near", F.round("e", 9))
    out = m.rollup("mode").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.expr("e * e"))), 6).alias("rmse"), F.round(F.max("e"), 6).alias("max_abs"),
        F.count_if(F.col("near") <= 5).alias("within_5"), F.count_if((F.col("near") > 5) & (F.col("near") <= 15)).alias("within_15"), F.count_if(F.col("near") > 15).alias("beyond"),
    )
    return out.withColumn("mode", F.coalesce("mode", F.lit("TOTAL")))


@query(f"""WITH {SERIES}, d AS (SELECT *, abs(cents - lag(cents) OVER (PARTITION BY user_id ORDER BY t)) AS delta FROM series), r AS (SELECT user_id, delta, row_number() OVER (PARTITION BY user_id ORDER BY delta) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM d WHERE delta IS NOT NULL),
q AS (SELECT user_id, delta AS p90 FROM r WHERE i = CAST(floor(n * 9 / 10.0) AS BIGINT))
SELECT user_id, count(*) AS n, round(avg(cents), 6) AS mean, round(stddev_pop(cents), 6) AS spread, max(p90) AS p90 FROM d LEFT JOIN q USING (user_id) GROUP BY 1""")
def series_statistics(spark, sf_dir):
    """Mean, deviation and 90th percentile of steps of each series."""
    d = series.deltas(_series(spark, sf_dir), "user_id", "cents")
    p90 = metrics.floor_percentile(d.where("delta is not null"), "user_id", "delta", 9, 10)
    stats = d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cents"), 6).alias("mean"), F.round(F.stddev_pop("cents"), 6).alias("spread"))
    return stats.join(p90.withColumnRenamed("percentile", "p90"), "user_id", "left")


STATE = "CASE WHEN cents < 12000 THEN 0 WHEN cents > 18000 THEN 2 ELSE 1 END"


@query(f"""WITH {SERIES}, s AS (SELECT *, {STATE} AS state FROM series), b AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY t) AS before FROM s) SELECT user_id, t, cents, state, before FROM b WHERE before <> state""")
def state_crossings(spark, sf_dir):
    """Where a series changes its side of a cutoff with a band."""
    return series.crossings(_series(spark, sf_dir), "user_id", "cents", 15000, 3000)


@query(f"""WITH {SERIES}, s AS (SELECT *, {STATE} AS state FROM series), b AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY t) AS before FROM s), k AS (SELECT user_id, t FROM b WHERE before <> state),
u AS (SELECT user_id, unnest([t - 1, t, t + 1]) AS t FROM k UNION ALL SELECT user_id, min(t) FROM series GROUP BY 1 UNION ALL SELECT user_id, max(t) FROM series GROUP BY 1) SELECT DISTINCT user_id, t FROM u WHERE t BETWEEN 0 AND 29""")
def protected_keys(spark, sf_dir):
    """Key times: crossings with their neighbours, and both ends."""
    s = _series(spark, sf_dir)
    near = series.around(series.crossings(s, "user_id", "cents", 15000, 3000).select("user_id", "t"), "user_id", 29)
    ends = s.groupBy("user_id").agg(F.array(F.min("t"), F.max("t")).alias("e")).select("user_id", F.explode("e").alias("t"))
    return near.unionByName(ends).distinct()


@query(f"""WITH {SERIES}, d AS (SELECT user_id, t, CAST(cents AS DOUBLE) AS v FROM series), a AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS n FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t)),
o AS (SELECT user_id, t, CASE WHEN b IS NULL OR n IS NULL THEN v ELSE v * (1 - 2 * 0.25) + (b + n) * 0.25 END AS v FROM a), c AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS n FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, t, round(CASE WHEN b IS NULL OR n IS NULL THEN v ELSE v * (1 - 2 * 0.25) + (b + n) * 0.25 END, 6) AS v FROM c""")
def smoothed_series(spark, sf_dir):
    """Two passes of three-tap smoothing."""
    d = _series(spark, sf_dir).select("user_id", "t", F.col("cents").cast("double").alias("v"))
    return series.smoothed(d, "user_id", "v", 0.25, 2).select("user_id", "t", _r("v"))


@query(f"""WITH {SERIES}, m AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS a, max(t) OVER (PARTITION BY user_id) AS z FROM series), k AS (SELECT user_id, t, cents FROM m WHERE t % 7 = 0 OR t = a OR t = z),
j AS (SELECT s.user_id, s.t, s.cents, k0.t AS t0, k0.cents AS v0 FROM series s ASOF JOIN k k0 ON s.user_id = k0.user_id AND s.t >= k0.t), l AS (SELECT j.*, k1.t AS t1, k1.cents AS v1 FROM j ASOF JOIN k k1 ON j.user_id = k1.user_id AND j.t <= k1.t)
SELECT user_id, t, cents, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * ((t - t0) / CAST(t1 - t0 AS DOUBLE)) END, 6) AS p FROM l""")
def keyframe_interpolation(spark, sf_dir):
    """Every series rebuilt from its ends and every seventh frame."""
    whole = Window.partitionBy("user_id")
    s = _series(spark, sf_dir).withColumn("a", F.min("t").over(whole)).withColumn("z", F.max("t").over(whole))
    marked = s.withColumn("is_key", F.expr("t % 7 = 0 or t = a or t = z"))
    return series.interpolated(marked, "user_id", "cents", F.col("is_key")).select("user_id", "t", "cents", _r("p"))


@query(f"""WITH {SERIES}, k AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM series WHERE t % 3 = 0), b AS (SELECT DISTINCT user_id, unnest([0, 1, 2, 3]) AS bin FROM k)
SELECT b.user_id, CAST(b.bin AS BIGINT) AS bin, CAST(CASE WHEN min(CASE WHEN k.t >= b.bin * 8 THEN k.i END) IS NULL THEN max(k.n) - 1 ELSE greatest(min(CASE WHEN k.t >= b.bin * 8 THEN k.i END) - 1, 0) END AS BIGINT) AS first_key FROM b JOIN k USING (user_id) GROUP BY 1, 2""")
def time_bin_index(spark, sf_dir):
    """For each of four time bins of a series the key before the first one inside it."""
    keys = _series(spark, sf_dir).where("t % 3 = 0")
    keys = keys.select("user_id", "t", (F.row_number().over(series.by("user_id")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))
    spread = keys.withColumn("bin", F.explode(F.array(*[F.lit(b).cast("long") for b in range(4)])))
    first = F.greatest(F.min(F.when(F.expr("t >= bin * 8"), F.col("i"))) - 1, F.lit(0))
    no_later = F.min(F.when(F.expr("t >= bin * 8"), F.col("i"))).isNull()
    return spread.groupBy("user_id", "bin").agg(F.when(no_later, F.max("n") - 1).otherwise(first).cast("long").alias("first_key"))


@query(f"""WITH {CELLS}, m AS (SELECT leaf_id, x, y, z, max(v) AS top, bool_or(abs(v - 25) <= 2) AS near_iso, bool_or((v >= 25) <> (p >= 25)) AS flips, bool_or(v >= 0.35 * 50) AS shell FROM paired GROUP BY 1, 2, 3, 4)
SELECT leaf_id, count(*) AS voxels, count(*) FILTER (top < 30) AS background, count(*) FILTER (near_iso) AS near_iso, count(*) FILTER (flips) AS flips, count(*) FILTER (near_iso OR flips) AS surface, count(*) FILTER (shell) AS shell, max(top) < 30 AS is_empty FROM m GROUP BY 1""")
def voxel_activity(spark, sf_dir):
    """Background, surface and shell voxels of each leaf, over all frames. Means count to nine places, as the order in which they are summed decides those behind."""
    m = _paired(spark, sf_dir).groupBy("leaf_id", "x", "y", "z").agg(
        F.max("v").alias("top"), F.bool_or(F.abs(F.col("v") - 25) <= 2).alias("near_iso"), F.bool_or((F.col("v") >= 25) != (F.round("p", 9) >= 25)).alias("flips"), F.bool_or(F.col("v") >= 0.35 * PEAK).alias("shell")
    )
    count = lambda c, n: F.count_if(c).alias(n)
    return m.groupBy("leaf_id").agg(
        F.count(F.lit(1)).alias("voxels"), count(F.col("top") < 30, "background"), count(F.col("near_iso"), "near_iso"), count(F.col("flips"), "flips"), count(F.expr("near_iso or flips"), "surface"), count(F.col("shell"), "shell"), (F.max("top") < 30).alias("is_empty")
    )


def _tri_sql():
    return C.trilinear("ctrl", 4, "px", "py", "pz")


@query(f"""WITH c AS (SELECT vec_id AS leaf_id, embedding AS ctrl, vec_id % 8 AS px, (vec_id // 8) % 8 AS py, (vec_id * 3) % 8 AS pz FROM embeddings) SELECT leaf_id, px, py, pz, round({_tri_sql().replace('element_at(ctrl,', 'list_extract(ctrl,').replace('cast(floor', 'CAST(floor')}, 6) AS value FROM c""")
def control_grid_samples(spark, sf_dir):
    """4 x 4 x 4 control grids sampled at one voxel each by trilinear interpolation."""
    c = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("leaf_id"), F.col("embedding").alias("ctrl"), F.expr("vec_id % 8").alias("px"), F.expr("(vec_id div 8) % 8").alias("py"), F.expr("(vec_id * 3) % 8").alias("pz"))
    return c.select("leaf_id", "px", "py", "pz", _r("value", _tri_sql()))


@query(f"""WITH {CELLS}, q AS (SELECT o_orderkey AS qid, o_orderkey * 7 % 32 AS x, o_custkey % 32 AS y, o_orderkey % 8 + 8 * (o_orderkey // 8192) AS z, (o_orderkey * 5 + o_custkey) % 16 AS t FROM orders)
SELECT qid, x, y, z, t, CAST(floor(z / 8.0) * 16 + floor(y / 8.0) * 4 + floor(x / 8.0) AS BIGINT) AS leaf_id, coalesce(v, 0.0) AS v FROM q LEFT JOIN cells USING (x, y, z, t)""")
def point_queries(spark, sf_dir):
    """A batch of point queries, one an order, joined with the cells; a missing cell is 0."""
    q = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.expr("o_orderkey * 7 % 32").alias("x"), F.expr("o_custkey % 32").alias("y"), fields.slab_z("o_orderkey").alias("z"), F.expr("(o_orderkey * 5 + o_custkey) % 16").alias("t"))
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem"))
    return q.join(cells, ["x", "y", "z", "t"], "left").select("qid", "x", "y", "z", "t", fields.leaf_id(W, H, D).alias("leaf_id"), F.coalesce("v", F.lit(0.0)).alias("v"))


@query(f"""WITH q AS (SELECT o_orderkey AS qid, CAST(o_orderkey // 8192 * 16 + floor((o_custkey % 32) / 8.0) * 4 + floor((o_orderkey * 7 % 32) / 8.0) AS BIGINT) AS leaf_id, (o_orderkey * 5 + o_custkey) % 16 AS t FROM orders)
SELECT leaf_id, count(*) AS queries, count(DISTINCT t) AS frames, min(qid) AS first_query FROM q GROUP BY 1""")
def query_histogram(spark, sf_dir):
    """Queries and frames by leaf of a batch."""
    q = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.expr("o_orderkey * 7 % 32").alias("x"), F.expr("o_custkey % 32").alias("y"), fields.slab_z("o_orderkey").alias("z"), F.expr("(o_orderkey * 5 + o_custkey) % 16").alias("t"))
    return q.groupBy(fields.leaf_id(W, H, D).alias("leaf_id")).agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("t").alias("frames"), F.min("qid").alias("first_query"))


@query(f"""WITH {CELLS} SELECT x AS px, y AS py, t, count(*) AS steps, round(sum(v), 6) AS integral, max(v) AS top, round(sum(CASE WHEN z < 4 THEN v ELSE 0 END), 6) AS near_half FROM cells GROUP BY 1, 2, 3""")
def ray_integrals(spark, sf_dir):
    """Orthographic rays along z: each ray's sum over its cells, and that of its nearer half."""
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem"))
    return cells.groupBy(F.col("x").alias("px"), F.col("y").alias("py"), "t").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum("v"), 6).alias("integral"), F.max("v").alias("top"), F.round(F.sum(F.when(F.col("z") < 4, F.col("v")).otherwise(0.0)), 6).alias("near_half"))


@query(f"""WITH {CELLS}, a AS (SELECT *, least(0.95, {C.opacity('v', '2.0', '10.0', '40.0')}) AS alpha FROM cells), w AS (SELECT *, coalesce(exp(sum(ln(1 - alpha)) OVER (PARTITION BY x, y, t ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS trans FROM a)
SELECT x AS px, y AS py, t, round(sum(trans * alpha), 6) AS accumulated, round(min(trans), 6) AS least_trans FROM w GROUP BY 1, 2, 3""")
def composited_rays(spark, sf_dir):
    """Front-to-back compositing along z as a running product."""
    a = fields.field_cells(_table(spark, sf_dir, "lineitem")).withColumn("alpha", F.expr(f"least(0.95, {C.opacity('v', '2.0', '10.0', '40.0')})"))
    w = Window.partitionBy("x", "y", "t").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    a = a.withColumn("trans", F.coalesce(F.exp(F.sum(F.ln(1 - F.col("alpha"))).over(w)), F.lit(1.0)))
    return a.groupBy(F.col("x").alias("px"), F.col("y").alias("py"), "t").agg(F.round(F.sum(F.expr("trans * alpha")), 6).alias("accumulated"), F.round(F.min("trans"), 6).alias("least_trans"))


@query(f"""WITH {SERIES}, s AS (SELECT user_id, t, CAST(cents AS DOUBLE) AS v, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k FROM series) SELECT user_id, CAST(k AS INT) AS k, round(sum(v * {C.dct_basis('30e0', 't', 'k')}), 4) AS c FROM s GROUP BY 1, 2""")
def dct_coefficients(spark, sf_dir):
    """The first eight DCT coefficients of each series of 30 days."""
    s = _series(spark, sf_dir).select("user_id", "t", F.col("cents").cast("double").alias("v"))
    return codec.dct(s, "user_id", "v", 30, 8).select("user_id", "k", F.round("c", 4).alias("c"))


@query(f"""WITH {SERIES}, s AS (SELECT user_id, t, CAST(cents AS DOUBLE) AS v, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k FROM series), c AS (SELECT user_id, k, sum(v * {C.dct_basis('30e0', 't', 'k')}) AS c FROM s GROUP BY 1, 2)
SELECT CAST(k AS INT) AS k, round(max(abs(c)) / 127, 4) AS scale, count(*) AS n FROM c WHERE k > 0 GROUP BY 1""")
def coefficient_scales(spark, sf_dir):
    """One scale a coefficient over all series, for eight-bit storage."""
    s = _series(spark, sf_dir).select("user_id", "t", F.col("cents").cast("double").alias("v"))
    return codec.dct(s, "user_id", "v", 30, 8).where("k > 0").groupBy("k").agg(F.round(F.max(F.abs("c")) / 127, 4).alias("scale"), F.count(F.lit(1)).alias("n"))


RESID = f"{CELLS}, resid AS (SELECT leaf_id, voxel, t, round(v - p, 9) AS r, 50.0 AS norm FROM paired)"


def _residuals(spark, sf_dir):
    return _paired(spark, sf_dir).select("leaf_id", "voxel", "t", F.round(F.expr("v - p"), 9).alias("r"), F.lit(PEAK).alias("norm"))


@query(f"""WITH {RESID}, s AS (SELECT *, max(abs(r)) OVER (PARTITION BY leaf_id, t) / 7 AS scale FROM resid), q AS (SELECT *, {C.quantised('r', 'scale', '7')} AS q FROM s)
SELECT leaf_id, t, count(*) AS n, round(max(scale), 6) AS scale, CAST(sum(q) AS BIGINT) AS total, count(*) FILTER (q = 0) AS zeros, round(sqrt(avg((r - q * scale) * (r - q * scale))), 6) AS rmse FROM q GROUP BY 1, 2""")
def block_floating_point(spark, sf_dir):
    """Residuals of each leaf and frame as four-bit multiples of a common scale, and what that loses."""
    q = codec.frame_scales(_residuals(spark, sf_dir), 7)
    return q.groupBy("leaf_id", "t").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("scale"), 6).alias("scale"), F.sum("q").alias("total"), F.count_if(F.col("q") == 0).alias("zeros"), F.round(F.sqrt(F.avg(F.expr("(r - decoded) * (r - decoded)"))), 6).alias("rmse"))


@query(f"""WITH {RESID}, e AS (SELECT * FROM resid WHERE abs(r) > 1e-12 AND abs(r) / norm >= 0.4), c AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY abs(r) DESC, t, voxel) AS place FROM e) SELECT leaf_id, voxel, t, round(r, 6) AS r, place FROM c WHERE place <= 64""")
def strongest_events(spark, sf_dir):
    """The 64 strongest events of each leaf."""
    top = codec.strongest(codec.events(_residuals(spark, sf_dir), 0.4), "leaf_id", 64)
    return top.select("leaf_id", "voxel", "t", _r("r"), "place")


@query(f"""WITH {RESID}, e AS (SELECT * FROM resid WHERE abs(r) > 1e-12 AND abs(r) / norm >= 0.3), f AS (SELECT *, row_number() OVER (PARTITION BY leaf_id, t ORDER BY abs(r) DESC, voxel) AS i FROM e), g AS (SELECT f.*, (SELECT count(DISTINCT t) FROM e e2 WHERE e2.leaf_id = f.leaf_id) AS frames FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY CASE WHEN i > greatest(1, floor(100 / CAST(frames AS DOUBLE))) THEN 1 ELSE 0 END, abs(r) DESC, t, voxel) AS place FROM g) SELECT leaf_id, voxel, t, round(r, 6) AS r, place FROM h WHERE place <= 100""")
def stratified_events(spark, sf_dir):
    """100 events of each leaf with a fair share for each frame."""
    top = codec.stratified(codec.events(_residuals(spark, sf_dir), 0.3), "leaf_id", 100)
    return top.select("leaf_id", "voxel", "t", _r("r"), "place")


@query(f"""WITH {RESID}, e AS (SELECT * FROM resid WHERE abs(r) > 1e-12 AND abs(r) / norm >= 0.4), s AS (SELECT *, max(abs(r)) OVER (PARTITION BY leaf_id) / 7 AS scale FROM e), q AS (SELECT *, {C.quantised('r', 'scale', '7')} AS q FROM s)
SELECT leaf_id, voxel, t, q, CAST(floor(t / 1.0) AS BIGINT) AS bin, (t % 1) * 512 + voxel AS coord, CASE WHEN q < 0 THEN q + 16 ELSE q END AS nibble FROM q WHERE q <> 0""")
def packed_events(spark, sf_dir):
    """Quantised events with their time bin, coordinate word and four-bit code."""
    q = codec.quantised_events(codec.events(_residuals(spark, sf_dir), 0.4), "leaf_id")
    return q.select("leaf_id", "voxel", "t", "q", F.expr("cast(floor(t / 1.0) as bigint)").alias("bin"), F.expr("(t % 1) * 512 + voxel").alias("coord"), F.expr("case when q < 0 then q + 16 else q end").alias("nibble"))


@query(f"""WITH {RESID}, e AS (SELECT leaf_id, voxel, t, abs(r) AS a FROM resid WHERE abs(r) > 1e-12 AND abs(r) / norm >= 0.4), n AS (SELECT leaf_id, count(*) AS n, count(DISTINCT voxel) AS voxels, count(DISTINCT t) AS frames FROM e GROUP BY 1)
SELECT leaf_id, n, voxels, frames, round(voxels / 512.0, 6) AS voxel_share, round(frames / 16.0, 6) AS frame_share, {C.tier('n')} AS tier, 4 * CAST(ceil((4 + 2 * 16 + 3 * n) / 4.0) AS BIGINT) AS bytes FROM n""")
def event_occupancy(spark, sf_dir):
    """Distinct voxels and frames with events, the tier that holds them and an estimate of bytes."""
    e = codec.events(_residuals(spark, sf_dir), 0.4)
    n = e.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("voxel").alias("voxels"), F.countDistinct("t").alias("frames"))
    return n.select("leaf_id", "n", "voxels", "frames", _r("voxel_share", "voxels / 512.0D"), _r("frame_share", "frames / 16.0D"), F.expr(C.tier("n")).alias("tier"), F.expr("4 * cast(ceil((4 + 2 * 16 + 3 * n) / 4.0) as bigint)").alias("bytes"))


@query(f"""WITH {RESID}, e AS (SELECT leaf_id, voxel, sum(r * r) AS energy FROM resid GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY round(energy, 6) DESC, voxel) AS place, sum(energy) OVER (PARTITION BY leaf_id) AS total, coalesce(sum(energy) OVER (PARTITION BY leaf_id ORDER BY round(energy, 6) DESC, voxel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT leaf_id, round(max(total), 4) AS total, round(sum(CASE WHEN place <= 16 THEN energy ELSE 0 END) / max(total), 6) AS top_share, count(*) FILTER (before / total < 0.9) AS needed FROM k GROUP BY 1""")
def energy_shares(spark, sf_dir):
    """What share of a leaf's residual energy its 16 strongest voxels hold, and how many voxels reach nine tenths."""
    e = _residuals(spark, sf_dir).groupBy("leaf_id", "voxel").agg(F.sum(F.expr("r * r")).alias("energy"))
    order, whole = Window.partitionBy("leaf_id").orderBy(F.round("energy", 6).desc(), "voxel"), Window.partitionBy("leaf_id")
    k = e.withColumn("place", F.row_number().over(order)).withColumn("total", F.sum("energy").over(whole)).withColumn("before", F.coalesce(F.sum("energy").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return k.groupBy("leaf_id").agg(F.round(F.max("total"), 4).alias("total"), F.round(F.sum(F.when(F.col("place") <= 16, F.col("energy")).otherwise(0.0)) / F.max("total"), 6).alias("top_share"), F.count_if(F.expr("before / total < 0.9")).alias("needed"))


@query(f"""WITH {SERIES}, n AS (SELECT user_id, count(*) AS n FROM series GROUP BY 1), w AS (SELECT *, n * 2 + 1 AS words FROM n) SELECT user_id, n, CAST(coalesce(sum(words) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS word_begin, CAST(sum(words) OVER (ORDER BY user_id) AS BIGINT) AS word_end FROM w""")
def payload_offsets(spark, sf_dir):
    """Offset table of all series laid end to end, by sums inside ranges of keys and of ranges."""
    n = _series(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return codec.offsets(n, "user_id", F.expr("n * 2 + 1")).select("user_id", "n", "word_begin", "word_end")


ROUTE_SQL = f"""{CELLS}, e AS (SELECT leaf_id, v, abs(v - p0) AS coarse, abs(v - p) AS fine, v >= 0.35 * 50 AS shell FROM paired),
m AS (SELECT leaf_id, max(v) < 5 AS is_empty, sqrt(avg(coarse * coarse)) / 50 AS coarse_rmse, max(coarse) / 50 AS coarse_peak, sqrt(avg(fine * fine)) / 50 AS fine_rmse,
avg(CASE WHEN v >= 47 THEN 1.0 ELSE 0.0 END) AS visible_share, avg(CASE WHEN abs(v - 25) <= 2 THEN 1.0 ELSE 0.0 END) AS band_share, avg(CASE WHEN shell THEN 1.0 ELSE 0.0 END) AS shell_share,
coalesce(sqrt(avg(CASE WHEN shell THEN coarse * coarse END)) / 50, 0) AS coarse_shell_rmse, coalesce(max(CASE WHEN shell THEN coarse END) / 50, 0) AS coarse_shell_peak, coalesce(sqrt(avg(CASE WHEN shell THEN fine * fine END)) / 50, 0) AS shell_voxel_rmse FROM e GROUP BY 1),
g AS (SELECT *, (coarse_rmse - fine_rmse) / greatest(coarse_rmse, 1e-12) AS fine_gain, (coarse_shell_rmse - shell_voxel_rmse) / greatest(coarse_shell_rmse, 1e-12) AS shell_gain FROM m)"""
LIMITS = codec.RouteLimits(rmse=0.28, peak=0.55, visible=0.08, band=0.1, fine_gain=0.004, shell_share=0.66, shell_rmse=0.24, shell_peak=0.6, shell_gain=0.003)
_ROUTE = ("coarse_rmse", "coarse_peak", "fine_rmse", "visible_share", "band_share", "shell_share", "coarse_shell_rmse", "coarse_shell_peak", "shell_voxel_rmse")


@query(f"""WITH {ROUTE_SQL} SELECT leaf_id, is_empty, {", ".join(f"round({c}, 6) AS {c}" for c in _ROUTE)},
CASE WHEN is_empty THEN 'empty' WHEN shell_share >= 0.66 AND (coarse_shell_rmse > 0.24 OR coarse_shell_peak > 0.6) AND shell_gain >= 0.003 THEN 'shell'
WHEN (coarse_rmse > 0.28 OR coarse_peak > 0.55) AND (visible_share >= 0.08 OR band_share >= 0.1) AND fine_gain >= 0.004 THEN 'fine' ELSE 'coarse' END AS mode FROM g""")
def leaf_routes(spark, sf_dir):
    """Route metrics of each leaf (the leaf's mean as coarse, the frame's mean as fine prediction) and the representation they choose."""
    e = _paired(spark, sf_dir).select("leaf_id", "v", F.abs(F.expr("v - p0")).alias("coarse"), F.abs(F.expr("v - p")).alias("fine"), (F.col("v") >= 0.35 * PEAK).alias("shell"))
    rmse, share = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c))) / PEAK, lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    in_shell = lambda c: F.when(F.col("shell"), F.col(c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    m = e.groupBy("leaf_id").agg(
        (F.max("v") < 5).alias("is_empty"), rmse("coarse").alias("coarse_rmse"), (F.max("coarse") / PEAK).alias("coarse_peak"), rmse("fine").alias("fine_rmse"),
        share(F.col("v") >= 47).alias("visible_share"), share(F.abs(F.col("v") - 25) <= 2).alias("band_share"), share(F.col("shell")).alias("shell_share"),
        zero(F.sqrt(F.avg(in_shell("coarse") * in_shell("coarse"))) / PEAK).alias("coarse_shell_rmse"), zero(F.max(in_shell("coarse")) / PEAK).alias("coarse_shell_peak"), zero(F.sqrt(F.avg(in_shell("fine") * in_shell("fine"))) / PEAK).alias("shell_voxel_rmse"),
    )
    return codec.route(m, LIMITS).select("leaf_id", "is_empty", *[_r(c) for c in _ROUTE], "mode")


@query(f"""WITH {CELLS}, e AS (SELECT leaf_id, 'leaf_frame' AS candidate, 1 AS place, 16 * 4 AS bytes, abs(v - p) / 50 AS e FROM paired UNION ALL SELECT leaf_id, 'leaf', 2, 4, abs(v - p0) / 50 FROM paired UNION ALL SELECT leaf_id, 'raw', 3, NULL, 0.0 FROM paired),
k AS (SELECT *, row_number() OVER (PARTITION BY leaf_id, place ORDER BY e) - 1 AS i, count(*) OVER (PARTITION BY leaf_id, place) AS n FROM e),
s AS (SELECT leaf_id, candidate, place, coalesce(max(bytes), 4 * max(n)) AS bytes, sqrt(avg(e * e)) AS rmse, max(e) FILTER (i = least(n - 1, CAST(floor(n * 99 / 100.0) AS BIGINT))) AS p99, max(e) AS peak FROM k GROUP BY 1, 2, 3),
c AS (SELECT *, greatest(rmse, 2 * p99, 4 * peak) + 350 * bytes / 1048576.0 AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY score, place) AS k FROM c)
SELECT leaf_id, candidate, CAST(bytes AS BIGINT) AS bytes, round(rmse, 6) AS rmse, round(p99, 6) AS p99, round(peak, 6) AS peak, round(score, 6) AS score FROM r WHERE k = 1""")
def rate_distortion_choice(spark, sf_dir):
    """The representation of each leaf with the least distortion (the largest of rmse, twice p99, four times the peak) and weighted size; ties go to the earlier one."""
    kind = lambda name, place, e: F.struct(F.lit(name).alias("candidate"), F.lit(place).alias("place"), e.alias("e"))
    options = F.array(kind("leaf_frame", 1, F.abs(F.expr("v - p")) / PEAK), kind("leaf", 2, F.abs(F.expr("v - p0")) / PEAK), kind("raw", 3, F.lit(0.0)))
    e = _paired(spark, sf_dir).select("leaf_id", F.inline(options)).withColumn("option", F.concat_ws(":", "leaf_id", "place"))
    p99 = metrics.floor_percentile(e, "option", "e", 99, 100).withColumnRenamed("percentile", "p99")
    stats = e.groupBy("option", "leaf_id", "candidate", "place").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.expr("e * e"))).alias("rmse"), F.max("e").alias("peak"))
    n_bytes = F.when(F.col("place") == 1, 16 * 4).when(F.col("place") == 2, 4).otherwise(4 * F.col("n")).cast("long")
    c = stats.join(p99, "option").withColumn("bytes", n_bytes)
    c = c.withColumn("score", codec.rate_distortion(codec.distortion(F.col("rmse"), F.col("p99"), F.col("peak")), F.col("bytes"), 350.0))
    best = c.groupBy("leaf_id").agg(F.min(F.struct("score", "place", "candidate", "bytes", "rmse", "p99", "peak")).alias("b"))
    return best.select("leaf_id", "b.candidate", "b.bytes", _r("rmse", "b.rmse"), _r("p99", "b.p99"), _r("peak", "b.peak"), _r("score", "b.score"))


@query(f"""WITH {CELLS}, s AS (SELECT DISTINCT leaf_id % 4 AS bx, CAST(floor(leaf_id / 4.0) AS BIGINT) AS by_, leaf_id FROM leafed), h AS (SELECT leaf_id, sum((v - p) * (v - p)) AS sse FROM paired GROUP BY 1), seed AS (SELECT leaf_id, row_number() OVER (ORDER BY round(sse, 6) DESC, leaf_id) AS severity FROM h QUALIFY severity <= 3)
SELECT n.leaf_id, count(*) AS seeds, min(abs(n.bx - c.bx) + abs(n.by_ - c.by_)) AS distance, min(seed.severity) AS severity FROM seed JOIN s c USING (leaf_id) JOIN s n ON abs(n.bx - c.bx) <= 1 AND abs(n.by_ - c.by_) <= 1 GROUP BY 1""")
def hotspot_neighbours(spark, sf_dir):
    """Leaves next to the three worst ones: offsets are unrolled on the seeds, so the range join is an equi-join."""
    cells = _paired(spark, sf_dir)
    place = F.expr("leaf_id % 4").alias("bx"), F.expr("cast(floor(leaf_id / 4.0) as bigint)").alias("by_")
    leaves = cells.select("leaf_id").distinct().select("leaf_id", *place)
    worst = cells.groupBy("leaf_id").agg(F.round(F.sum(F.expr("(v - p) * (v - p)")), 6).alias("sse")).orderBy(F.desc("sse"), "leaf_id").limit(3)
    seeds = worst.withColumn("severity", F.row_number().over(Window.orderBy(F.desc("sse"), "leaf_id"))).select("severity", *place)
    steps = F.expr("inline(flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a as dx, b as dy)))))")
    spread = seeds.select("severity", "bx", "by_", steps).select("severity", (F.col("bx") + F.col("dx")).alias("bx"), (F.col("by_") + F.col("dy")).alias("by_"), (F.abs("dx") + F.abs("dy")).cast("long").alias("d"))
    return spread.join(leaves, ["bx", "by_"]).groupBy("leaf_id").agg(F.count(F.lit(1)).alias("seeds"), F.min("d").alias("distance"), F.min("severity").alias("severity"))


@query(f"""WITH {CELLS}, n AS (SELECT a.v, b.v AS w FROM cells a JOIN cells b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z AND b.t = a.t), s AS (SELECT v, lead(v) OVER (PARTITION BY x, y, z ORDER BY t) AS w, lead(t) OVER (PARTITION BY x, y, z ORDER BY t) - t AS gap FROM cells)
SELECT 'x' AS axis, count(*) AS n, round(corr(v, w), 6) AS correlation FROM n UNION ALL SELECT 't', count(*), round(corr(v, w), 6) FROM s WHERE gap = 1""")
def neighbour_correlation(spark, sf_dir):
    """Correlation of cells with their next one along x and in time."""
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem"))
    moved = cells.select((F.col("x") - 1).alias("x"), "y", "z", "t", F.col("v").alias("w"))
    along = cells.join(moved, ["x", "y", "z", "t"]).select(F.lit("x").alias("axis"), "v", "w")
    order = Window.partitionBy("x", "y", "z").orderBy("t")
    later = cells.select(F.lit("t").alias("axis"), "v", F.lead("v").over(order).alias("w"), (F.lead("t").over(order) - F.col("t")).alias("gap")).where("gap = 1").drop("gap")
    return along.unionByName(later).groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("v", "w"), 6).alias("correlation"))


@query(f"""WITH {CELLS}, f AS (SELECT t, count(*) FILTER (v >= 25) AS visible, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(v) AS low, max(v) AS high FROM cells GROUP BY 1) SELECT *, row_number() OVER (ORDER BY visible DESC, t) AS place FROM f""")
def frame_visibility(spark, sf_dir):
    """Frames by how many cells reach a cutoff, with their bounding boxes; the first is the proxy frame."""
    f = fields.field_cells(_table(spark, sf_dir, "lineitem")).groupBy("t").agg(F.count_if(F.col("v") >= 25).alias("visible"), F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("v").alias("low"), F.max("v").alias("high"))
    return f.withColumn("place", F.row_number().over(Window.orderBy(F.desc("visible"), "t")))


@query("""WITH n AS (SELECT n_nationkey AS k, n_name FROM nation), s AS (SELECT s_nationkey AS k, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS customers, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1)
SELECT n.k, n_name, coalesce(suppliers, 0) AS suppliers, balance, coalesce(customers, 0) AS customers, mean, CASE WHEN s.k IS NULL AND c.k IS NULL THEN 'neither' WHEN s.k IS NULL THEN 'no supplier' WHEN c.k IS NULL THEN 'no customer' ELSE 'both' END AS found,
CASE WHEN coalesce(customers, 0) > 0 THEN round(coalesce(suppliers, 0) / CAST(customers AS DOUBLE), 6) ELSE 0.0 END AS ratio FROM n FULL JOIN s USING (k) FULL JOIN c USING (k)""")
def manifest_join(spark, sf_dir):
    """Manifests joined by key with the sides that lack it named, and ratios that are 0 without a denominator."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    s = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    c = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("c_acctbal"), 6).alias("mean"))
    j = n.join(s, "k", "full").join(c, "k", "full")
    found = F.when(F.col("suppliers").isNull() & F.col("customers").isNull(), "neither").when(F.col("suppliers").isNull(), "no supplier").when(F.col("customers").isNull(), "no customer").otherwise("both")
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    ratio = F.when(zero(F.col("customers")) > 0, F.round(zero(F.col("suppliers")) / F.col("customers"), 6)).otherwise(0.0)
    return j.select("k", "n_name", found.alias("found"), ratio.alias("ratio"), zero(F.col("suppliers")).alias("suppliers"), "balance", zero(F.col("customers")).alias("customers"), "mean")


@query("""SELECT c_custkey, c_name, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'matched' ELSE 'missing' END AS state FROM customer""")
def semi_and_anti(spark, sf_dir):
    """Keys of a list that have a match, by semi-join, and that have none, by anti-join."""
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    part = lambda how, state: c.join(o, "c_custkey", how).select("c_custkey", "c_name", F.lit(state).alias("state"))
    return part("left_semi", "matched").unionByName(part("left_anti", "missing"))


@query("""WITH measured AS (SELECT p_partkey AS k, p_name AS name, p_retailprice * 2 AS price FROM part WHERE p_partkey % 3 = 0) SELECT k, name, round(price, 6) AS price, 'new' AS origin FROM measured UNION ALL SELECT p_partkey, p_name, round(p_retailprice, 6), 'old' FROM part WHERE p_partkey NOT IN (SELECT k FROM measured)""")
def upsert(spark, sf_dir):
    """Rows measured anew replace the old ones of their key."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    new = part.where("k % 3 = 0").withColumn("price", F.col("price") * 2).withColumn("origin", F.lit("new"))
    return new.unionByName(part.join(new, "k", "left_anti").withColumn("origin", F.lit("old"))).withColumn("price", F.round("price", 6))


@query(f"""SELECT event_id, event_id % 37 AS n, {C.timeline('(event_id % 37)', 10, 'loop')} AS loop_frame, {C.timeline('(event_id % 37)', 10, 'once')} AS once_frame, {C.timeline('(event_id % 37)', 10, 'pingpong')} AS pingpong_frame FROM events""")
def timeline_frames(spark, sf_dir):
    """Frame shown after some advances in each loop mode."""
    e = _table(spark, sf_dir, "events").select("event_id", F.expr("event_id % 37").alias("n"))
    return e.select("event_id", "n", *[F.expr(C.timeline("n", 10, m)).alias(f"{m}_frame") for m in ("loop", "once", "pingpong")])


@query(f"""WITH {CELLS} SELECT x, y, z, t, round(1 - exp(-1.5 * greatest(0, v - 5) / 45), 6) AS opacity, round(CASE WHEN v <= 10 THEN 0 WHEN v >= 40 THEN 1 ELSE pow((v - 10) / 30, 2) * (3 - 2 * (v - 10) / 30) END, 6) AS gain,
round(v * (2.51 * v + 0.03) / (v * (2.43 * v + 0.59) + 0.14), 6) AS filmic, round(v / (1 + v), 6) AS reinhard, round((1 - 0.36) / (4 * pi() * pow(1.36 - 1.2 * cos(v), 1.5)), 6) AS phase, round(0.04 + 0.96 * pow(1 - abs(cos(v)), 5), 6) AS fresnel,
CASE WHEN v <= 10 THEN 4.0 WHEN v <= 20 THEN 2.5 WHEN v <= 30 THEN 2.0 WHEN v <= 40 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM cells""")
def shading_functions(spark, sf_dir):
    """Opacity, gain, tone curves, phase function, Fresnel term and band weight of every cell."""
    v = F.col("v")
    kinds = {
        "opacity": F.expr(C.opacity("v", "1.5D", "5.0D", "45.0D")),
        "gain": F.expr(C.smoothstep("v", "10.0D", "40.0D")),
        "filmic": C.filmic(v),
        "reinhard": C.reinhard(v),
        "phase": C.phase(F.cos(v), 0.6),
        "fresnel": C.fresnel(F.abs(F.cos(v)), 0.04),
        "weight": C.band_weight(v, [(10, 4.0), (20, 2.5), (30, 2.0), (40, 1.5)], 1.0),
    }
    return fields.field_cells(_table(spark, sf_dir, "lineitem")).select("x", "y", "z", "t", *[(c if n == "weight" else F.round(c, 6)).alias(n) for n, c in kinds.items()])


@query(f"""WITH {SERIES}, l AS (SELECT user_id, list(CASE WHEN cents > 15000 THEN 1 ELSE 0 END ORDER BY t) AS bits FROM series GROUP BY 1), g AS (SELECT bits, min(user_id) AS first_user, count(*) AS users FROM l GROUP BY 1) SELECT l.user_id, first_user, users, len(l.bits) AS n FROM l JOIN g USING (bits)""")
def sequence_pool(spark, sf_dir):
    """Series with equal contents share an entry; contents are compared, not hashes alone."""
    l = _series(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", (F.col("cents") > 15000).cast("int").alias("b")))).alias("s")).select("user_id", F.col("s.b").alias("bits"))
    g = l.groupBy("bits").agg(F.min("user_id").alias("first_user"), F.count(F.lit(1)).alias("users"))
    return l.join(g, "bits").select("user_id", "first_user", "users", F.size("bits").cast("long").alias("n"))


@query(f"""WITH {CELLS}, b AS (SELECT leaf_id, CAST(floor(voxel / 63.0) AS BIGINT) AS word, bit_or(CAST(1 AS BIGINT) << CAST(voxel % 63 AS INT)) AS mask, count(DISTINCT voxel) AS n FROM leafed WHERE v >= 30 GROUP BY 1, 2) SELECT leaf_id, word, mask, CAST(bit_count(mask) AS INT) AS held, n, CAST(coalesce(sum(n) OVER (PARTITION BY leaf_id ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM b""")
def occupancy_masks(spark, sf_dir):
    """Bit masks of occupied voxels by leaf with population and prefix counts."""
    b = _cells(spark, sf_dir).where("v >= 30").groupBy("leaf_id", F.expr("cast(floor(voxel / 63.0) as bigint)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(voxel % 63 as int)))").alias("mask"), F.countDistinct("voxel").alias("n"))
    before = Window.partitionBy("leaf_id").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    return b.select("leaf_id", "word", "mask", F.bit_count("mask").alias("held"), "n", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("prefix"))


@query(f"""WITH {CELLS}, c AS (SELECT leaf_id, t, voxel, row_number() OVER (PARTITION BY leaf_id, t ORDER BY voxel) AS i FROM leafed WHERE v >= 45) SELECT leaf_id, t, min(voxel) AS first_voxel, max(voxel) AS last_voxel, count(*) AS n FROM c GROUP BY leaf_id, t, voxel - i""")
def voxel_runs(spark, sf_dir):
    """Runs of neighbouring voxels at a threshold, by leaf and frame."""
    c = _cells(spark, sf_dir).where("v >= 45").withColumn("run", F.col("voxel") - F.row_number().over(Window.partitionBy("leaf_id", "t").orderBy("voxel")))
    return c.groupBy("leaf_id", "t", "run").agg(F.min("voxel").alias("first_voxel"), F.max("voxel").alias("last_voxel"), F.count(F.lit(1)).alias("n")).drop("run")


@query("""SELECT p_partkey, lower(p_name) AS name, upper(p_brand) AS brand, CAST(nullif(regexp_extract(p_brand, '(\\d+)$', 1), '') AS BIGINT) AS suffix, regexp_replace(p_brand, '\\d+$', '') AS prefix, contains(lower(p_type), 'steel') AS is_steel,
row_number() OVER (PARTITION BY p_size ORDER BY regexp_replace(p_brand, '\\d+$', ''), CAST(nullif(regexp_extract(p_brand, '(\\d+)$', 1), '') AS BIGINT), p_partkey) AS place FROM part""")
def natural_order(spark, sf_dir):
    """Names in natural order: prefix, numeric suffix, then key; with the text functions that roles are told by."""
    p = _table(spark, sf_dir, "part").withColumn("suffix", F.nullif(F.regexp_extract("p_brand", r"(\d+)$", 1), F.lit("")).cast("long")).withColumn("prefix", F.regexp_replace("p_brand", r"\d+$", ""))
    place = F.row_number().over(Window.partitionBy("p_size").orderBy("prefix", F.asc_nulls_last("suffix"), "p_partkey"))
    return p.select("p_partkey", F.lower("p_name").alias("name"), F.upper("p_brand").alias("brand"), "suffix", "prefix", F.contains(F.lower("p_type"), F.lit("steel")).alias("is_steel"), place.alias("place"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
