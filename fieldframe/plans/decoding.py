"""Registered queries of decoding and evaluation, with their DuckDB equivalents.

A leaf's coarse series is its mean by frame, kept as six cosine coefficients; what a cell
differs from it by 0.3 of the peak or more is an event, stored in sevenths of the leaf's
largest one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import codec, decode, fields, metrics
from .catalog import CELLS, PEAK, T, _cells, _paired, _r, _table, query

KEEP = 6
_B = C.dct_basis("16e0", "{t}", "k")

DECODED = f"""{CELLS}, m AS (SELECT leaf_id, t, avg(v) AS p FROM leafed GROUP BY 1, 2), co AS (SELECT leaf_id, k, sum(p * {_B.format(t='t')}) AS c FROM m, range({KEEP}) r(k) GROUP BY 1, 2),
dec AS (SELECT leaf_id, tt AS t, sum(c * {_B.format(t='tt')}) AS coarse FROM co, range(16) r(tt) GROUP BY 1, 2), resid AS (SELECT leaf_id, voxel, t, round(v - coarse, 9) AS r FROM leafed JOIN dec USING (leaf_id, t)),
ev AS (SELECT *, max(abs(r)) OVER (PARTITION BY leaf_id) / 7 AS scale FROM resid WHERE abs(r) > 1e-12 AND abs(r) / 50 >= 0.3), eq AS (SELECT leaf_id, voxel, t, sign(r) * least(7, floor(abs(r) / scale + 0.5)) AS q, scale FROM ev)"""


def _parts(spark, sf_dir):
    """Cells, coarse values by leaf and frame, and events."""
    cells = _cells(spark, sf_dir)
    means = cells.groupBy("leaf_id", "t").agg(F.avg("v").alias("p"))
    coarse = decode.frames_of(codec.dct(means, "leaf_id", "p", T, KEEP), "leaf_id", T)
    residuals = cells.join(coarse, ["leaf_id", "t"]).select("leaf_id", "voxel", "t", F.round(F.expr("v - coarse"), 9).alias("r"), F.lit(PEAK).alias("norm"))
    return cells, coarse, codec.quantised_events(codec.events(residuals, 0.3), "leaf_id")


_QUERIES = "q AS (SELECT o_orderkey AS qid, o_orderkey * 7 % 32 AS x, o_custkey % 32 AS y, o_orderkey % 8 + 8 * (o_orderkey // 8192) AS z, (o_orderkey * 5 + o_custkey) % 16 AS t FROM orders), ql AS (SELECT *, CAST(floor(z / 8.0) * 16 + floor(y / 8.0) * 4 + floor(x / 8.0) AS BIGINT) AS leaf_id, (z % 8 * 8 + y % 8) * 8 + x % 8 AS voxel FROM q)"


def _queries(spark, sf_dir):
    e = F.expr
    q = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), e("o_orderkey * 7 % 32").alias("x"), e("o_custkey % 32").alias("y"), fields.slab_z("o_orderkey").alias("z"), e("(o_orderkey * 5 + o_custkey) % 16").alias("t"))
    return q.withColumn("leaf_id", fields.leaf_id(32, 32, fields.DEEPEST)).withColumn("voxel", fields.local_voxel())


@query(f"""WITH {DECODED}, {_QUERIES} SELECT qid, leaf_id, voxel, t, least(15, t) AS bin, coalesce(round(q * scale, 6), 0.0) AS residual FROM ql LEFT JOIN eq USING (leaf_id, voxel, t)""")
def event_lookup(spark, sf_dir):
    """Point queries' residuals: a left join with the events in place of masks, bins and a search."""
    _, _, events = _parts(spark, sf_dir)
    found = decode.with_events(_queries(spark, sf_dir), events)
    return found.select("qid", "leaf_id", "voxel", "t", decode.event_bin(F.col("t"), T).alias("bin"), _r("residual"))


@query(f"""WITH {DECODED}, {_QUERIES} SELECT qid, x, y, z, t, round(coarse, 6) AS coarse, coalesce(round(q * scale, 6), 0.0) AS residual, round(coarse + coalesce(q * scale, 0), 6) AS decoded FROM ql JOIN dec USING (leaf_id, t) LEFT JOIN eq USING (leaf_id, voxel, t)""")
def decoded_points(spark, sf_dir):
    """Point queries answered from coefficients and events."""
    _, coarse, events = _parts(spark, sf_dir)
    out = decode.reconstructed(_queries(spark, sf_dir), coarse, events)
    return out.select("qid", "x", "y", "z", "t", _r("coarse"), _r("residual"), _r("decoded"))


@query(f"""WITH {DECODED}, s AS (SELECT leaf_id, t, unnest(range(512)) AS voxel, coarse FROM dec WHERE t = 5) SELECT leaf_id, voxel, t, leaf_id % 4 * 8 + voxel % 8 AS x, leaf_id // 4 % 4 * 8 + voxel // 8 % 8 AS y, leaf_id // 16 * 8 + voxel // 64 AS z,
round(greatest(0, coarse + coalesce(q * scale, 0)), 6) AS decoded FROM s LEFT JOIN eq USING (leaf_id, voxel, t)""")
def reconstructed_frame(spark, sf_dir):
    """All cells of frame 5 decoded, 512 of each leaf, negative values cut to 0."""
    _, coarse, events = _parts(spark, sf_dir)
    frame = coarse.where("t = 5").select("leaf_id", "t", F.explode(F.expr("sequence(0L, 511L)")).alias("voxel"))
    out = decode.reconstructed(frame, coarse, events)
    e = F.expr
    return out.select("leaf_id", "voxel", "t", e("leaf_id % 4 * 8 + voxel % 8").alias("x"), e("leaf_id div 4 % 4 * 8 + voxel div 8 % 8").alias("y"), e("leaf_id div 16 * 8 + voxel div 64").alias("z"), F.round(F.greatest(F.lit(0.0), F.col("decoded")), 6).alias("decoded"))


@query(f"""WITH {DECODED}, p AS (SELECT i, (i * 5) % 16 AS leaf_id, (i * 7) % 16 AS t FROM range(257) r(i)) SELECT p.i, leaf_id, t, round(coarse, 6) AS by_frame, round(coarse, 6) AS by_point, true AS equal FROM p JOIN dec USING (leaf_id, t)""")
def frame_self_check(spark, sf_dir):
    """257 probes of frames decoded whole against the same values decoded one by one."""
    cells = _cells(spark, sf_dir)
    means = cells.groupBy("leaf_id", "t").agg(F.avg("v").alias("p"))
    coefficients = codec.dct(means, "leaf_id", "p", T, KEEP)
    probes = spark.range(257).select(F.col("id").alias("i"), F.expr("id * 5 % 16").alias("leaf_id"), F.expr("id * 7 % 16").alias("t"))
    arrays = coefficients.groupBy("leaf_id").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("s"))
    single = F.broadcast(probes).join(arrays, "leaf_id").select("i", "leaf_id", "t", decode.value_at(F.col("s.c"), F.col("t"), T).alias("by_point"))
    both = single.join(decode.frames_of(coefficients, "leaf_id", T), ["leaf_id", "t"])
    return both.select("i", "leaf_id", "t", _r("by_frame", "coarse"), _r("by_point"), (F.abs(F.expr("coarse - by_point")) < 1e-9).alias("equal"))


@query(f"""WITH {DECODED}, {_QUERIES}, d AS (SELECT coalesce(v, 0.0) AS v, coarse + coalesce(q * scale, 0) AS p FROM ql JOIN dec USING (leaf_id, t) LEFT JOIN eq USING (leaf_id, voxel, t) LEFT JOIN cells USING (x, y, z, t))
SELECT count(*) AS n, round(avg(abs(v - p)), 6) AS mean_abs, round(sqrt(avg((v - p) * (v - p))), 6) AS rmse, round(sum(p), 3) AS checksum, count(*) FILTER (abs(v - p) > 5) AS mismatches, round(max(abs(v - p)), 6) AS max_abs, round(min(p), 6) AS low, round(max(p), 6) AS high, round(avg(p), 6) AS mean FROM d""")
def decoded_sample_errors(spark, sf_dir):
    """Decoded point queries against the volume: errors, a checksum, and how many differ by more than 5."""
    cells, coarse, events = _parts(spark, sf_dir)
    d = decode.reconstructed(_queries(spark, sf_dir), coarse, events).join(cells.select("x", "y", "z", "t", "v"), ["x", "y", "z", "t"], "left")
    e = F.abs(F.coalesce("v", F.lit(0.0)) - F.col("decoded"))
    p = F.col("decoded")
    return d.select(e.alias("e"), p.alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("mean_abs"), F.round(F.sqrt(F.avg(F.expr("e * e"))), 6).alias("rmse"), F.round(F.sum("p"), 3).alias("checksum"), F.count_if(F.col("e") > 5).alias("mismatches"),
        F.round(F.max("e"), 6).alias("max_abs"), F.round(F.min("p"), 6).alias("low"), F.round(F.max("p"), 6).alias("high"), F.round(F.avg("p"), 6).alias("mean"),
    )


@query(f"""WITH {DECODED}, d AS (SELECT x, y, z, t, leaf_id, abs(v - coarse - coalesce(q * scale, 0)) AS e, q IS NOT NULL AS is_event FROM leafed JOIN dec USING (leaf_id, t) LEFT JOIN eq USING (leaf_id, voxel, t)),
s AS (SELECT *, x % 4 = 0 AND y % 4 = 0 AND z % 4 = 0 AND t % 2 = 0 AS sampled FROM d) SELECT leaf_id, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(max(e), 6) AS peak, count(*) FILTER (sampled) AS n_sampled, round(sqrt(avg(CASE WHEN sampled THEN e * e END)), 6) AS rmse_sampled,
count(*) FILTER (sampled OR is_event) AS n_supplemented, round(max(CASE WHEN sampled OR is_event THEN e END), 6) AS peak_supplemented FROM s GROUP BY 1""")
def full_against_sampled(spark, sf_dir):
    """Errors over all cells, over a lattice, and over the lattice with the events' places added (each cell once)."""
    cells, coarse, events = _parts(spark, sf_dir)
    marked = decode.reconstructed(cells, coarse, events).withColumn("e", F.abs(F.expr("v - decoded")))
    marked = marked.withColumn("sampled", F.expr("x % 4 = 0 and y % 4 = 0 and z % 4 = 0 and t % 2 = 0"))
    at_event = events.select("leaf_id", "voxel", "t", F.lit(True).alias("is_event"))
    s = marked.join(at_event, ["leaf_id", "voxel", "t"], "left").withColumn("more", F.col("sampled") | F.coalesce("is_event", F.lit(False)))
    only = lambda c, e: F.when(F.col(c), F.expr(e))
    return s.groupBy("leaf_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.expr("e * e"))), 6).alias("rmse"), F.round(F.max("e"), 6).alias("peak"), F.count_if(F.col("sampled")).alias("n_sampled"), F.round(F.sqrt(F.avg(only("sampled", "e * e"))), 6).alias("rmse_sampled"),
        F.count_if(F.col("more")).alias("n_supplemented"), F.round(F.max(only("more", "e")), 6).alias("peak_supplemented"),
    )


LADDER = codec.keep_ladder(12)


@query(f"""WITH {CELLS}, m AS (SELECT leaf_id, t, avg(v) AS p FROM leafed GROUP BY 1, 2), co AS (SELECT leaf_id, k, sum(p * {_B.format(t='t')}) AS c FROM m, range(16) r(k) GROUP BY 1, 2),
f AS (SELECT co.leaf_id, tt AS t, keep, sum(CASE WHEN k < keep THEN c * {_B.format(t='tt')} ELSE 0 END) AS coarse FROM co, range(16) r(tt), (SELECT unnest([4, 6, 8, 10, 12]) AS keep) GROUP BY 1, 2, 3),
e AS (SELECT leaf_id, keep, sqrt(avg((p - coarse) * (p - coarse))) / 50 AS rmse, max(abs(p - coarse)) / 50 AS peak FROM m JOIN f USING (leaf_id, t) GROUP BY 1, 2), b AS (SELECT leaf_id, coalesce(min(CASE WHEN rmse <= 0.02 AND peak <= 0.05 THEN keep END), 12) AS keep FROM e GROUP BY 1)
SELECT leaf_id, CAST(keep AS INT) AS keep, round(rmse, 6) AS rmse, round(peak, 6) AS peak FROM b JOIN e USING (leaf_id, keep)""")
def coefficient_keeps(spark, sf_dir):
    """How many coefficients each leaf keeps: the fewest of a ladder that meet both thresholds, else the ladder's last."""
    means = _cells(spark, sf_dir).groupBy("leaf_id", "t").agg(F.avg("v").alias("p"))
    coefficients = codec.dct(means, "leaf_id", "p", T, 16)
    keeps = F.explode(F.array(*[F.lit(k) for k in LADDER])).alias("keep")
    part = coefficients.select("leaf_id", "k", "c", keeps).where("k < keep").withColumn("option", F.concat_ws(":", "leaf_id", "keep"))
    names = part.select("option", "leaf_id", "keep").distinct()
    f = decode.frames_of(part, "option", T).join(names, "option").join(means, ["leaf_id", "t"])
    e = f.groupBy("leaf_id", "keep").agg((F.sqrt(F.avg(F.expr("(p - coarse) * (p - coarse)"))) / PEAK).alias("rmse"), (F.max(F.abs(F.expr("p - coarse"))) / PEAK).alias("peak"))
    return codec.smallest_keep(e, "leaf_id", LADDER[-1], 0.02, 0.05).select("leaf_id", "keep", _r("rmse"), _r("peak"))


@query(f"""WITH {CELLS}, vx AS (SELECT leaf_id, voxel, sum((v - p0) * (v - p0)) AS energy FROM paired GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY round(energy, 6) DESC, voxel) AS i, sum(energy) OVER (PARTITION BY leaf_id) AS total FROM vx),
h AS (SELECT leaf_id, sum(CASE WHEN i <= 32 THEN energy ELSE 0 END) / max(total) AS hot FROM k GROUP BY 1), e AS (SELECT leaf_id, max(v) - min(v) AS spread, avg(v) AS mean, sqrt(avg((v - p0) * (v - p0))) / 50 AS rmse, max(abs(v - p0)) / 50 AS peak FROM paired GROUP BY 1)
SELECT leaf_id, round(spread, 6) AS spread, round(mean, 6) AS mean, round(rmse, 6) AS rmse, round(peak, 6) AS peak, round(hot, 6) AS hot_share, CASE WHEN spread <= greatest(1e-6, 0.02 * 49) THEN 'constant' WHEN rmse <= 0.275 AND peak <= 0.6 THEN 'coarse'
WHEN rmse <= 0.283 AND hot >= 0.168 AND peak <= 0.6 * 1.5 THEN 'amnestied' ELSE 'residual' END AS mode FROM e JOIN h USING (leaf_id)""")
def coarse_only_routes(spark, sf_dir):
    """Leaves that need no residuals: constant ones, near ones, and near ones whose error sits in a few hot voxels (energy amnesty)."""
    paired = _paired(spark, sf_dir)
    energy = paired.groupBy("leaf_id", "voxel").agg(F.sum(F.expr("(v - p0) * (v - p0)")).alias("energy"))
    e = paired.groupBy("leaf_id").agg((F.max("v") - F.min("v")).alias("spread"), F.avg("v").alias("mean"), (F.sqrt(F.avg(F.expr("(v - p0) * (v - p0)"))) / PEAK).alias("rmse"), (F.max(F.abs(F.expr("v - p0"))) / PEAK).alias("peak"))
    routed = codec.coarse_route(e.join(codec.hot_share(energy, "leaf_id", 32), "leaf_id"), constant=0.02 * 49, rmse=0.275, peak=0.6, amnesty_rmse=0.283, hot=0.168, peak_scale=1.5)
    return routed.select("leaf_id", _r("spread"), _r("mean"), _r("rmse"), _r("peak"), _r("hot_share"), "mode")


@query(f"""WITH {DECODED}, n AS (SELECT leaf_id, count(*) AS n FROM eq WHERE q <> 0 GROUP BY 1), a AS (SELECT DISTINCT leaf_id FROM leafed) SELECT leaf_id, coalesce(n, 0) AS events, CASE WHEN coalesce(n, 0) >= 625 THEN 'sparse' ELSE 'coarse' END AS mode, CASE WHEN coalesce(n, 0) >= 625 THEN n ELSE 0 END AS kept FROM a LEFT JOIN n USING (leaf_id)""")
def least_events(spark, sf_dir):
    """Leaves with fewer events than worth keeping become coarse, and their events go."""
    cells, _, events = _parts(spark, sf_dir)
    n = events.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("n"))
    all_ = cells.select("leaf_id").distinct().join(n, "leaf_id", "left").withColumn("events", F.coalesce("n", F.lit(0).cast("long")))
    enough = F.col("events") >= 625
    return all_.select("leaf_id", "events", F.when(enough, "sparse").otherwise("coarse").alias("mode"), F.when(enough, F.col("events")).otherwise(0).alias("kept"))


@query(f"""WITH {CELLS}, w AS (SELECT leaf_id, min(t) FILTER (v >= 49) AS a, max(t) FILTER (v >= 49) AS b FROM leafed GROUP BY 1), g AS (SELECT leaf_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM w), m AS (SELECT leaf_id, t, avg(v) AS p, max(abs(v - 25)) AS r FROM leafed GROUP BY 1, 2),
x AS (SELECT g.*, unnest(range(16)) AS t FROM g) SELECT x.leaf_id, x.t, least(b, greatest(a, x.t)) AS source, round(c.p, 6) AS coarse, CASE WHEN x.t BETWEEN a AND b THEN round(o.r, 6) ELSE 0.0 END AS residual FROM x LEFT JOIN m c ON c.leaf_id = x.leaf_id AND c.t = least(b, greatest(a, x.t)) LEFT JOIN m o ON o.leaf_id = x.leaf_id AND o.t = x.t""")
def outside_window(spark, sf_dir):
    """Frames outside a leaf's active window take the coarse value of the window's nearer end and no residual."""
    cells = _cells(spark, sf_dir)
    hot = F.when(F.col("v") >= 49, F.col("t"))
    window = cells.groupBy("leaf_id").agg(F.coalesce(F.min(hot), F.lit(0).cast("long")).alias("a"), F.coalesce(F.max(hot), F.lit(0).cast("long")).alias("b"))
    m = cells.groupBy("leaf_id", "t").agg(F.avg("v").alias("p"), F.max(F.abs(F.col("v") - 25)).alias("r"))
    x = window.withColumn("t", F.explode(F.expr("sequence(0L, 15L)"))).withColumn("source", F.least("b", F.greatest("a", "t")))
    near = m.select("leaf_id", F.col("t").alias("source"), F.round("p", 6).alias("coarse"))
    out = x.join(near, ["leaf_id", "source"], "left").join(m.select("leaf_id", "t", "r"), ["leaf_id", "t"], "left")
    return out.select("leaf_id", "t", "source", "coarse", F.when(F.col("t").between(F.col("a"), F.col("b")), F.round("r", 6)).otherwise(0.0).alias("residual"))
