"""Registered queries of field statistics, error tails, rankings and choices, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import codec, fields, metrics, ranks, tails
from .catalog import CELLS, PEAK, ROUTE_SQL, _cells, _paired, _r, _table, leaf_routes, query

_AT = "CAST(floor((n - 1) * {a} / {b}.0) AS BIGINT)"
TAILS = f"""{CELLS}, e AS (SELECT leaf_id, v, abs(v - p) AS e, abs(v - p0) AS te FROM paired), k AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY e) - 1 AS i, count(*) OVER (PARTITION BY leaf_id) AS n FROM e),
a AS (SELECT leaf_id, count(*) AS samples, greatest(1e-6, max(v) - min(v)) AS span, avg(e) AS mean, sqrt(avg(e * e)) AS rmse, max(e) AS top, sum(e * e) AS sse, sqrt(avg(te * te)) AS temporal_rmse, min(v) AS low, max(v) AS high, count(*) FILTER (v BETWEEN 20 AND 30) AS seen,
max(e) FILTER (i = {_AT.format(a=95, b=100)}) AS p95, max(e) FILTER (i = {_AT.format(a=99, b=100)}) AS p99, max(e) FILTER (i = {_AT.format(a=999, b=1000)}) AS p999 FROM k GROUP BY 1),
tails AS (SELECT *, rmse / span AS norm_rmse, temporal_rmse / span AS temporal_norm, rmse / greatest(1e-8, temporal_rmse) AS amplification FROM a)"""


@query(f"""WITH {TAILS} SELECT leaf_id, samples, round(span, 6) AS "range", round(mean, 6) AS mean, round(rmse, 6) AS rmse, round(top, 6) AS "max", round(p95, 6) AS p95, round(p99, 6) AS p99, round(p999, 6) AS p999, round(sse, 3) AS sse,
round(temporal_rmse, 6) AS temporal_rmse, round(norm_rmse, 6) AS norm_rmse, round(temporal_norm, 6) AS temporal_norm, round(amplification, 6) AS amplification FROM tails""")
def leaf_error_tails(spark, sf_dir):
    """Error statistics of every leaf with tails, against the error that the leaf's mean over time leaves."""
    out = tails.leaf_tails(_paired(spark, sf_dir), "leaf_id")
    return out.select("leaf_id", "samples", *[_r(c, f"`{c}`") for c in ("range", "mean", "rmse", "max", "p95", "p99", "p999")], F.round("sse", 3).alias("sse"), *[_r(c) for c in ("temporal_rmse", "norm_rmse", "temporal_norm", "amplification")])


_SEVERITY = "greatest(norm_rmse / greatest(0.35, 6 * temporal_norm), p95 / span / greatest(0.05, 2.5 * temporal_norm), top / span / greatest(0.2, 1.5 + 10 * temporal_norm), amplification / 8)"
_SCORE = "1.5 * norm_rmse + p95 / span + 0.35 * top / span + 0.1 * log2(greatest(1, amplification))"


@query(f"""WITH {TAILS}, s AS (SELECT leaf_id, round({_SEVERITY}, 6) AS severity, round({_SCORE}, 6) AS score FROM tails) SELECT *, row_number() OVER (ORDER BY severity DESC, score DESC, leaf_id) AS place FROM s""")
def hotspot_ranking(spark, sf_dir):
    """Leaves by how far they are over their error budgets, then by a score of their errors."""
    t = tails.leaf_tails(_paired(spark, sf_dir), "leaf_id")
    p95, peak = F.col("p95") / F.col("range"), F.col("max") / F.col("range")
    hot = tails.severity(F.col("norm_rmse"), p95, peak, F.col("amplification"), F.col("temporal_norm"))
    scored = t.select("leaf_id", F.round(hot, 6).alias("severity"), F.round(tails.hotspot_score(F.col("norm_rmse"), p95, peak, F.col("amplification")), 6).alias("score"))
    return ranks.ranked(scored, [F.desc("severity"), F.desc("score"), F.col("leaf_id")], "place")


@query(f"""WITH {TAILS}, c AS (SELECT *, high <= 49 AND seen = 0 AS below FROM tails), s AS (SELECT leaf_id, p999, rmse, round(greatest(norm_rmse, p999 / span) * CASE WHEN below THEN 0.25 ELSE 1 END, 6) AS score FROM c WHERE NOT (high <= 5 OR (below AND high - low <= greatest(5, 0.25 * 49)))),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, round(p999, 6) DESC, round(rmse, 6) DESC, leaf_id) AS place, count(*) OVER () AS n FROM s) SELECT leaf_id, score, place, place <= greatest(5, ceil(0.1 * n)) AS chosen FROM r""")
def residual_ranking(spark, sf_dir):
    """Leaves worth residuals by their relative error, and which of them a budget of five or a tenth takes."""
    paired = _paired(spark, sf_dir)
    seen = paired.groupBy("leaf_id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").between(20, 30)).alias("seen"))
    found = tails.residual_candidates(tails.leaf_tails(paired, "leaf_id").join(seen, "leaf_id"), zero=5.0, quiet=49.0)
    found = found.select("leaf_id", F.round("score", 6).alias("score"), F.round("p999", 6).alias("p999"), F.round("rmse", 6).alias("rmse"))
    placed = ranks.ranked(found, [F.desc("score"), F.desc("p999"), F.desc("rmse"), F.col("leaf_id")], "place")
    n = placed.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    within = placed.withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
    return within.select("leaf_id", "score", "place", (F.col("place") <= F.greatest(F.lit(5), F.ceil(0.1 * F.col("n")))).alias("chosen"))


_TIMES = "(0, 4, 8, 12, 15)"
BUDGET = f"""{CELLS}, s AS (SELECT *, lead(v) OVER (PARTITION BY y, z, t ORDER BY x) AS vx, lead(x) OVER (PARTITION BY y, z, t ORDER BY x) - x AS gx, lead(v) OVER (PARTITION BY x, z, t ORDER BY y) AS vy, lead(y) OVER (PARTITION BY x, z, t ORDER BY y) - y AS gy,
lead(v) OVER (PARTITION BY x, y, t ORDER BY z) AS vz, lead(z) OVER (PARTITION BY x, y, t ORDER BY z) - z AS gz FROM paired WHERE t IN {_TIMES}),
d AS (SELECT leaf_id, abs(vx - v) AS d FROM s WHERE gx = 1 AND x % 8 < 7 UNION ALL SELECT leaf_id, abs(vy - v) FROM s WHERE gy = 1 AND y % 8 < 7 UNION ALL SELECT leaf_id, abs(vz - v) FROM s WHERE gz = 1 AND z % 8 < 7),
dk AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY leaf_id) AS n FROM d), dp AS (SELECT leaf_id, max(d) FILTER (i = {_AT.format(a=9, b=10)}) AS d90, max(d) FILTER (i = {_AT.format(a=99, b=100)}) AS d99 FROM dk GROUP BY 1),
a AS (SELECT leaf_id, greatest(1e-6, max(v) - min(v)) AS span, sqrt(avg((v - p0) * (v - p0))) AS te FROM s GROUP BY 1), fs AS (SELECT leaf_id, t, max(v) - min(v) AS w FROM s GROUP BY 1, 2), fk AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY leaf_id) AS n FROM fs),
fp AS (SELECT leaf_id, max(w) FILTER (i = {_AT.format(a=9, b=10)}) AS f90 FROM fk GROUP BY 1), budget AS (SELECT leaf_id, span, te / span AS temporal, coalesce(d90 / span, 0) AS p90, coalesce(d99 / span, 0) AS p99, f90 / span AS frame_span FROM a LEFT JOIN dp USING (leaf_id) JOIN fp USING (leaf_id))"""
_CL = "least(1.0, greatest(0.0, {}))"
_RISK = f"{_CL.format('0.35 * ' + _CL.format('(p90 - 0.10) / 0.25') + ' + 0.20 * ' + _CL.format('(p99 - 0.25) / 0.50') + ' + 0.45 * ' + _CL.format('(frame_span - 0.55) / 0.35'))} * {_CL.format('(0.08 - temporal / 8) / 0.06')}"


@query(f"""WITH {BUDGET} SELECT leaf_id, round(span, 6) AS "range", round(temporal, 6) AS temporal, round(p90, 6) AS p90, round(p99, 6) AS p99, round(frame_span, 6) AS frame_span, round(2.0 * least(1.0, greatest(0.55, 1.0 - 0.45 * {_RISK})), 6) AS threshold FROM budget""")
def leaf_budgets(spark, sf_dir):
    """Range, error of time alone, differences to neighbours and spans at the quartile frames of each leaf, and the cluster threshold they allow (an eighth of the temporal error, for these are noisy data)."""
    s = _paired(spark, sf_dir).where(F.col("t").isin(0, 4, 8, 12, 15))
    near = []
    for a in "xyz":
        along = Window.partitionBy(*[b for b in "xyzt" if b != a]).orderBy(a)
        step = s.select("leaf_id", a, F.abs(F.lead("v").over(along) - F.col("v")).alias("d"), (F.lead(a).over(along) - F.col(a)).alias("gap"))
        near.append(step.where((F.col("gap") == 1) & (F.col(a) % 8 < 7)).select("leaf_id", "d"))
    d = near[0].unionByName(near[1]).unionByName(near[2])
    at = lambda rows, c, a, b, name: metrics.floor_percentile(rows, "leaf_id", c, a, b, last=True).withColumnRenamed("percentile", name)
    frames = s.groupBy("leaf_id", "t").agg((F.max("v") - F.min("v")).alias("w"))
    own = s.groupBy("leaf_id").agg(F.greatest(F.lit(1e-6), F.max("v") - F.min("v")).alias("range"), F.sqrt(F.avg(F.expr("(v - p0) * (v - p0)"))).alias("te"))
    all_ = own.join(at(d, "d", 9, 10, "d90"), "leaf_id", "left").join(at(d, "d", 99, 100, "d99"), "leaf_id", "left").join(at(frames, "w", 9, 10, "f90"), "leaf_id")
    norm = lambda c: F.coalesce(F.col(c) / F.col("range"), F.lit(0.0))
    b = all_.select("leaf_id", "range", norm("te").alias("temporal"), norm("d90").alias("p90"), norm("d99").alias("p99"), norm("f90").alias("frame_span"))
    threshold = tails.budget_threshold(2.0, F.col("temporal") / 8, p90=F.col("p90"), p99=F.col("p99"), span=F.col("frame_span"))
    return b.select("leaf_id", _r("range", "`range`"), _r("temporal"), _r("p90"), _r("p99"), _r("frame_span"), F.round(threshold, 6).alias("threshold"))


@query(f"""WITH {CELLS}, s AS (SELECT *, z // 8 AS slab FROM cells WHERE x % 2 = 0 AND y % 2 = 0), vk AS (SELECT *, row_number() OVER (PARTITION BY slab ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY slab) AS n FROM s),
q AS (SELECT slab, max(n) AS samples, min(v) AS low, max(v) AS high, max(v) FILTER (i = {_AT.format(a=1, b=100)}) AS q01, max(v) FILTER (i = {_AT.format(a=99, b=100)}) AS q99, max(v) FILTER (i = {_AT.format(a=5, b=1000)}) AS q005, max(v) FILTER (i = {_AT.format(a=995, b=1000)}) AS q995 FROM vk GROUP BY 1),
dt AS (SELECT a.slab, a.v, b.v AS w, abs(b.v - a.v) AS d FROM s a JOIN s b ON b.x = a.x AND b.y = a.y AND b.z = a.z AND b.t = a.t + 1), dk AS (SELECT *, row_number() OVER (PARTITION BY slab ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY slab) AS n FROM dt),
dp AS (SELECT slab, avg(d) AS delta_mean, max(d) FILTER (i = {_AT.format(a=90, b=100)}) AS delta_p90, max(d) FILTER (i = {_AT.format(a=99, b=100)}) AS delta_p99, corr(v, w) AS lag1 FROM dk GROUP BY 1),
sd AS (SELECT a.slab, abs(b.v - a.v) AS d FROM s a JOIN s b ON b.x = a.x + 2 AND b.y = a.y AND b.z = a.z AND b.t = a.t UNION ALL SELECT a.slab, abs(b.v - a.v) FROM s a JOIN s b ON b.x = a.x AND b.y = a.y + 2 AND b.z = a.z AND b.t = a.t UNION ALL SELECT a.slab, abs(b.v - a.v) FROM s a JOIN s b ON b.x = a.x AND b.y = a.y AND b.z = a.z + 1 AND b.t = a.t),
sk AS (SELECT *, row_number() OVER (PARTITION BY slab ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY slab) AS n FROM sd), sp AS (SELECT slab, avg(d) AS spatial_mean, max(d) FILTER (i = {_AT.format(a=90, b=100)}) AS spatial_p90, max(d) FILTER (i = {_AT.format(a=99, b=100)}) AS spatial_p99 FROM sk GROUP BY 1)
SELECT CAST(slab AS BIGINT) AS slab, samples, low, high, round(q01, 6) AS q01, round(q99, 6) AS q99, round(q005, 6) AS q005, round(q995, 6) AS q995, round(delta_mean, 6) AS delta_mean, round(delta_p90, 6) AS delta_p90, round(delta_p99, 6) AS delta_p99, round(lag1, 6) AS lag1, round(spatial_mean, 6) AS spatial_mean, round(spatial_p90, 6) AS spatial_p90, round(spatial_p99, 6) AS spatial_p99,
CASE WHEN (spatial_p90 / greatest(1e-6, q99 - q01) > 0.22) OR lag1 <= 0.35 THEN 'residual' ELSE 'multiscale' END AS mode FROM q LEFT JOIN dp USING (slab) LEFT JOIN sp USING (slab)""")
def field_statistics(spark, sf_dir):
    """Statistics of each slab on a lattice with steps of 2 in x and y: quantiles, steps in time and space, correlation in time, and the spatial route they recommend."""
    s = fields.field_cells(_table(spark, sf_dir, "lineitem")).where("x % 2 = 0 and y % 2 = 0").withColumn("slab", F.expr("z div 8"))

    def moved(axis, by):
        return s.select(*[(F.col(a) - by).alias(a) if a == axis else a for a in "xyzt"], F.col("v").alias("w"))

    pairs = lambda axis, by: s.join(moved(axis, by), list("xyzt")).select("slab", "v", "w", F.abs(F.col("w") - F.col("v")).alias("d"))
    at = lambda rows, c, a, b, name: metrics.floor_percentile(rows, "slab", c, a, b, last=True).select("slab", F.round("percentile", 6).alias(name))
    out = s.groupBy("slab").agg(F.count(F.lit(1)).alias("samples"), F.min("v").alias("low"), F.max("v").alias("high"))
    for name, a, b in (("q01", 1, 100), ("q99", 99, 100), ("q005", 5, 1000), ("q995", 995, 1000)):
        out = out.join(at(s, "v", a, b, name), "slab")
    dt, ds = pairs("t", 1), pairs("x", 2).unionByName(pairs("y", 2)).unionByName(pairs("z", 1))
    out = out.join(dt.groupBy("slab").agg(F.round(F.avg("d"), 6).alias("delta_mean"), F.corr("v", "w").alias("r")), "slab", "left").join(ds.groupBy("slab").agg(F.round(F.avg("d"), 6).alias("spatial_mean")), "slab", "left")
    for name, rows, a in (("delta_p90", dt, 90), ("delta_p99", dt, 99), ("spatial_p90", ds, 90), ("spatial_p99", ds, 99)):
        out = out.join(at(rows, "d", a, 100, name), "slab", "left")
    smooth = F.col("spatial_p90") / F.greatest(F.lit(1e-6), F.col("q99") - F.col("q01"))
    route = tails.spatial_route(F.lit("GENERIC"), F.lit(0.01), F.lit(7.0), F.col("r"), smooth)["mode"]
    return out.withColumn("mode", route).withColumn("lag1", F.round("r", 6)).drop("r")


@query(f"""WITH {CELLS}, d AS (SELECT leaf_id, v, abs(v - lag(v) OVER (PARTITION BY x, y, z ORDER BY t)) AS d FROM leafed), s AS (SELECT leaf_id, max(v) - min(v) AS spread, avg(d) AS delta, stddev_pop(v) AS deviation, avg(abs(v)) AS level FROM d GROUP BY 1),
u AS (SELECT leaf_id, unnest(['spread', 'delta', 'deviation', 'level']) AS score, unnest([round(spread, 6), round(delta, 6), round(deviation, 6), round(level, 6)]) AS value FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY score ORDER BY value DESC, leaf_id) AS k FROM u) SELECT leaf_id, min(score) AS score, max(value) FILTER (score = 'spread') AS spread, count(*) AS scores FROM r WHERE k = 1 GROUP BY 1""")
def calibration_leaves(spark, sf_dir):
    """The leaves that are first by range, steps in time, deviation or level: each once, with the scores it leads."""
    d = _cells(spark, sf_dir).withColumn("d", F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("x", "y", "z").orderBy("t"))))
    kinds = {"spread": F.max("v") - F.min("v"), "delta": F.avg("d"), "deviation": F.stddev_pop("v"), "level": F.avg(F.abs("v"))}
    s = d.groupBy("leaf_id").agg(*[F.round(c, 6).alias(n) for n, c in kinds.items()])
    firsts = s.agg(*[F.max(F.struct(F.col(n).alias("value"), (-F.col("leaf_id")).alias("leaf"))).alias(n) for n in kinds])
    each = firsts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("score"), F.col(n).alias("b")) for n in kinds])).alias("u")).select(F.col("u.score").alias("score"), (-F.col("u.b.leaf")).alias("leaf_id"), F.col("u.b.value").alias("value"))
    return each.groupBy("leaf_id").agg(F.min("score").alias("score"), F.max(F.when(F.col("score") == "spread", F.col("value"))).alias("spread"), F.count(F.lit(1)).alias("scores"))


@query(f"""WITH {TAILS} SELECT leaf_id // 16 AS slab, count(*) AS leaves, round(avg(4.0 * samples), 6) AS mean_bytes, round(max(p99), 6) AS p99, round(sqrt(avg(rmse * rmse)), 6) AS rmse, round(avg(mean), 6) AS mean FROM tails GROUP BY 1""")
def slab_metrics(spark, sf_dir):
    """Leaf metrics put together by slab: mean bytes, the largest p99, the root mean square of rmse."""
    t = tails.leaf_tails(_paired(spark, sf_dir), "leaf_id").withColumn("slab", F.expr("leaf_id div 16"))
    return t.groupBy("slab").agg(F.count(F.lit(1)).alias("leaves"), F.round(F.avg(4.0 * F.col("samples")), 6).alias("mean_bytes"), F.round(F.max("p99"), 6).alias("p99"), F.round(F.sqrt(F.avg(F.expr("rmse * rmse"))), 6).alias("rmse"), F.round(F.avg("mean"), 6).alias("mean"))


CANDIDATES = f"""{CELLS}, c AS (SELECT leaf_id, unnest([2, 4, 8, 16]) AS levels, v FROM leafed), q AS (SELECT leaf_id, levels, v, abs(v - (floor(v / (50.0::DOUBLE / levels)) + 0.5) * (50.0::DOUBLE / levels)) AS e FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY leaf_id, levels ORDER BY e) - 1 AS i, count(*) OVER (PARTITION BY leaf_id, levels) AS n FROM q),
cand AS (SELECT leaf_id, levels, max(n) * CAST(log2(levels) AS BIGINT) // 8 AS bytes, sqrt(avg(e * e)) AS rmse, max(e) FILTER (i = least(n - 1, CAST(floor(n * 99 / 100.0) AS BIGINT))) AS p99, max(e) FILTER (i = {_AT.format(a=999, b=1000)}) AS p999, 20 * log10(50 / sqrt(avg(e * e))) AS psnr FROM k GROUP BY 1, 2)"""


def _candidates(spark, sf_dir):
    """Each leaf stored in 2, 4, 8 or 16 levels: bytes and errors."""
    rows = _cells(spark, sf_dir).select("leaf_id", "v", F.explode(F.array(*[F.lit(n) for n in (2, 4, 8, 16)])).alias("levels"))
    step = PEAK / F.col("levels")
    e = rows.withColumn("e", F.abs(F.col("v") - (F.floor(F.col("v") / step) + 0.5) * step)).withColumn("option", F.concat_ws(":", "leaf_id", "levels"))
    stats = e.groupBy("option", "leaf_id", "levels").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.expr("e * e"))).alias("rmse"))
    p99 = metrics.floor_percentile(e, "option", "e", 99, 100).withColumnRenamed("percentile", "p99")
    p999 = metrics.floor_percentile(e, "option", "e", 999, 1000, last=True).withColumnRenamed("percentile", "p999")
    out = stats.join(p99, "option").join(p999, "option").withColumn("bytes", F.expr("n * cast(log2(levels) as bigint) div 8")).withColumn("psnr", metrics.psnr(F.col("rmse"), F.lit(PEAK)))
    return out.select("leaf_id", "levels", F.col("levels").alias("place"), "bytes", "rmse", "p99", "p999", "psnr")


@query(f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY bytes, levels) AS k FROM cand WHERE p99 <= 6.5 AND psnr >= 22) SELECT leaf_id, levels, bytes, round(rmse, 6) AS rmse, round(p99, 6) AS p99, round(psnr, 6) AS psnr FROM r WHERE k = 1""")
def targeted_choice(spark, sf_dir):
    """Of each leaf's candidates that meet targets of p99 and PSNR the smallest."""
    best = tails.least_bytes(_candidates(spark, sf_dir), ["leaf_id"], tails.meets(p99=6.5, psnr=22.0))
    return best.select("leaf_id", "levels", "bytes", _r("rmse"), _r("p99"), _r("psnr"))


@query(f"""WITH {CANDIDATES}, b AS (SELECT *, max(psnr) OVER (PARTITION BY leaf_id) AS top FROM cand), r AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY bytes, levels) AS k FROM b WHERE psnr + 0.25 >= top) SELECT leaf_id, levels, bytes, round(psnr, 6) AS psnr FROM r WHERE k = 1""")
def balanced_choice(spark, sf_dir):
    """Of each leaf's candidates within 0.25 dB of its best the smallest."""
    return tails.balanced(_candidates(spark, sf_dir), ["leaf_id"]).select("leaf_id", "levels", "bytes", _r("psnr"))


@query(f"""WITH {ROUTE_SQL}, r AS (SELECT leaf_id // 16 AS slab, CASE WHEN is_empty THEN 'empty' WHEN shell_share >= 0.66 AND (coarse_shell_rmse > 0.24 OR coarse_shell_peak > 0.6) AND shell_gain >= 0.003 THEN 'shell'
WHEN (coarse_rmse > 0.28 OR coarse_peak > 0.55) AND (visible_share >= 0.08 OR band_share >= 0.1) AND fine_gain >= 0.004 THEN 'fine' ELSE 'coarse' END AS mode FROM g), b AS (SELECT *, CASE mode WHEN 'empty' THEN 4 WHEN 'coarse' THEN 260 WHEN 'fine' THEN 868 ELSE 1100 END AS bytes FROM r),
d AS (SELECT DISTINCT slab, unnest(['empty', 'coarse', 'fine', 'shell']) AS mode FROM b), c AS (SELECT slab, mode, count(*) AS n, sum(bytes) AS bytes FROM b GROUP BY 1, 2), j AS (SELECT d.slab, d.mode, coalesce(n, 0) AS n, coalesce(bytes, 0) AS bytes FROM d LEFT JOIN c USING (slab, mode))
SELECT slab, mode, n, CAST(bytes AS BIGINT) AS bytes, round(100.0 * n / sum(n) OVER (PARTITION BY slab), 6) AS share, round(CASE WHEN n > 0 THEN bytes / CAST(n AS DOUBLE) ELSE 0 END, 6) AS mean_bytes FROM j""")
def mode_distribution(spark, sf_dir):
    """Leaves and bytes of each slab by mode, with rows of 0 for modes that it lacks."""
    cost = F.when(F.col("mode") == "empty", 4).when(F.col("mode") == "coarse", 260).when(F.col("mode") == "fine", 868).otherwise(1100).cast("long")
    b = leaf_routes(spark, sf_dir).select(F.expr("leaf_id div 16").alias("slab"), "mode", cost.alias("bytes"))
    counted = b.groupBy("slab", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    wanted = counted.select("slab").distinct().select("slab", F.explode(F.array(*[F.lit(m) for m in ("empty", "coarse", "fine", "shell")])).alias("mode"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    j = wanted.join(counted, ["slab", "mode"], "left").select("slab", "mode", zero("n"), zero("bytes"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("slab")), 6)
    return j.select("slab", "mode", "n", "bytes", share.alias("share"), F.round(F.when(F.col("n") > 0, F.col("bytes") / F.col("n")).otherwise(0.0), 6).alias("mean_bytes"))


@query(f"""WITH {CELLS}, i AS (SELECT t, x AS px, y AS py, avg(v) AS a FROM cells GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY a) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM i),
s AS (SELECT t, stddev_pop(a) AS deviation, max(a) FILTER (i = {_AT.format(a=995, b=1000)}) - max(a) FILTER (i = {_AT.format(a=5, b=1000)}) AS spread, avg(CASE WHEN a > 20 THEN 1.0 ELSE 0.0 END) AS foreground FROM k GROUP BY 1)
SELECT t, round(deviation, 6) AS deviation, round(spread, 6) AS spread, round(foreground, 6) AS foreground, deviation >= 0.5 AND spread >= 2 AND foreground BETWEEN 0.01 AND 0.999 AS shown FROM s""")
def nonblank_frames(spark, sf_dir):
    """Whether each frame's projection shows something: deviation, spread without outliers, and foreground."""
    i = fields.field_cells(_table(spark, sf_dir, "lineitem")).groupBy("t", "x", "y").agg(F.avg("v").alias("a"))
    at = lambda a, name: metrics.floor_percentile(i, "t", "a", a, 1000, last=True).withColumnRenamed("percentile", name)
    s = i.groupBy("t").agg(F.stddev_pop("a").alias("deviation"), F.avg(F.when(F.col("a") > 20, 1.0).otherwise(0.0)).alias("foreground")).join(at(995, "hi"), "t").join(at(5, "lo"), "t")
    shown = F.expr("deviation >= 0.5 and hi - lo >= 2 and foreground between 0.01 and 0.999")
    return s.select("t", _r("deviation"), _r("spread", "hi - lo"), _r("foreground"), shown.alias("shown"))


@query(f"""WITH {CELLS}, f AS (SELECT t, sqrt(avg((v - p) * (v - p))) AS rmse, avg(abs(v - p)) AS mae, max(abs(v - p)) AS peak FROM paired GROUP BY 1) SELECT count(*) AS frames, round(avg(rmse), 6) AS rmse, round(avg(mae), 6) AS mae, round(avg(peak), 6) AS peak, round(avg(20 * log10(50 / rmse)), 6) AS psnr FROM f""")
def mean_frame_metrics(spark, sf_dir):
    """Metrics of every frame, and their means."""
    e = F.abs(F.expr("v - p"))
    f = _paired(spark, sf_dir).groupBy("t").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mae"), F.max(e).alias("peak"))
    return f.agg(F.count(F.lit(1)).alias("frames"), *[F.round(F.avg(c), 6).alias(c) for c in ("rmse", "mae", "peak")], F.round(F.avg(metrics.psnr(F.col("rmse"), F.lit(PEAK))), 6).alias("psnr"))


@query(f"""WITH {CELLS}, d AS (SELECT leaf_id, count(*) FILTER (abs(v - 25) <= 2) AS band, avg(CASE WHEN (v >= 25) <> (p >= 25) THEN 1.0 ELSE 0.0 END) AS flips, coalesce(sqrt(avg(CASE WHEN abs(v - 25) <= 2 THEN (v - p) * (v - p) END)), 0) AS band_rmse, count(*) AS n FROM paired GROUP BY 1)
SELECT leaf_id, band, round(flips, 6) AS flips, round(band_rmse, 6) AS band_rmse FROM d ORDER BY band > 0 DESC, round(flips, 6) DESC, round(band_rmse, 6) DESC, leaf_id LIMIT 12""")
def worst_leaves(spark, sf_dir):
    """The twelve worst leaves: those at the surface first, by share of flipped signs, then by error at the surface."""
    near = F.abs(F.col("v") - 25) <= 2
    d = _paired(spark, sf_dir).groupBy("leaf_id").agg(
        F.count_if(near).alias("band"), F.round(F.avg(F.when((F.col("v") >= 25) != (F.col("p") >= 25), 1.0).otherwise(0.0)), 6).alias("flips"), F.round(F.coalesce(F.sqrt(F.avg(F.when(near, F.expr("(v - p) * (v - p)")))), F.lit(0.0)), 6).alias("band_rmse")
    )
    return d.orderBy((F.col("band") > 0).desc(), F.desc("flips"), F.desc("band_rmse"), "leaf_id").limit(12)


@query(f"""WITH {CELLS}, s AS (SELECT user_id, day(ts) - 1 AS t, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1, 2), k AS (SELECT user_id % 8 AS leaf, user_id, count(*) FILTER (cents > 15000) + 2 AS n FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY leaf) AS held FROM k), m AS (SELECT leaf, avg(n) AS mean, max(n) FILTER (i = least(held - 1, CAST(floor(held * 9 / 10.0) AS BIGINT))) AS p90 FROM r GROUP BY 1)
SELECT leaf, round(mean, 6) AS mean, p90, round(2.0 * (1 + 0.05 * pow(1 - greatest(least(1.0, greatest(0.0, (mean - 2) / 10.0)), least(1.0, greatest(0.0, (p90 - 4) / 12.0))), 1.5)), 6) AS threshold FROM m""")
def length_thresholds(spark, sf_dir):
    """Cluster thresholds of groups of series from the mean and 90th percentile of their key counts."""
    cents = fields.event_series(_table(spark, sf_dir, "events"))
    k = cents.groupBy(F.expr("user_id % 8").alias("leaf"), "user_id").agg((F.count_if(F.col("cents") > 15000) + 2).alias("n"))
    p90 = metrics.floor_percentile(k, "leaf", "n", 9, 10).withColumnRenamed("percentile", "p90")
    m = k.groupBy("leaf").agg(F.avg("n").alias("mean")).join(p90, "leaf")
    return m.select("leaf", _r("mean"), "p90", F.round(tails.length_threshold(2.0, mean=F.col("mean"), p90=F.col("p90")), 6).alias("threshold"))


@query(f"""WITH {CELLS}, s AS (SELECT user_id, day(ts) - 1 AS t, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS v FROM events GROUP BY 1, 2), c AS (SELECT user_id, k, sum(v * (CASE WHEN k = 0 THEN sqrt(1 / 30.0) ELSE sqrt(2 / 30.0) END) * cos(pi() / 30 * (t + 0.5) * k)) AS c FROM s, range(24) r(k) GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(c * c, 2) DESC, k) AS place, sum(c * c) OVER (PARTITION BY user_id) AS total FROM c) SELECT user_id, CAST(k AS INT) AS k, place, round(c * c / total, 6) AS share FROM p WHERE place <= 12""")
def strongest_coefficients(spark, sf_dir):
    """The twelve cosine coefficients of each series with most energy, and their shares."""
    s = fields.event_series(_table(spark, sf_dir, "events")).select("user_id", "t", F.col("cents").cast("double").alias("v"))
    c = codec.dct(s, "user_id", "v", 30, 24)
    own = Window.partitionBy("user_id")
    p = c.withColumn("place", F.row_number().over(own.orderBy(F.round(F.expr("c * c"), 2).desc(), "k"))).withColumn("total", F.sum(F.expr("c * c")).over(own))
    return p.where("place <= 12").select("user_id", "k", "place", _r("share", "c * c / total"))
