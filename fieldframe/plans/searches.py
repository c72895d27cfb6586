"""Registered queries of searches over coding parameters, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranks, search
from ..sources.shared import written
from .catalog import CELLS, PEAK, _leafwise, _paired, _r, query

NOW = search.Setting(eps_abs=2.0, eps_rel=0.05, gamma=0.1, cluster=4.0)
SPAN = 50.0


def _settings_sql():
    grid = f"""SELECT 2 + row_number() OVER (ORDER BY i, j, g, c) - 1 AS place, greatest({search.LEAST_ABS}, {NOW.eps_abs} * a) AS eps_abs, r AS eps_rel, gamma, greatest({search.LEAST_CLUSTER}, {NOW.cluster} * f) AS cluster
FROM (SELECT unnest({list(search.ABS_FACTORS)}) AS a, unnest(range(5)) AS i), (SELECT unnest({list(search.REL_SEEDS)}) AS r, unnest(range(3)) AS j), (SELECT unnest({list(search.GAMMA_SEEDS)}) AS gamma, unnest(range(2)) AS g), (SELECT unnest({list(search.CLUSTER_FACTORS)}) AS f, unnest(range(5)) AS c)"""
    return f"""SELECT 0 AS place, {NOW.eps_abs} AS eps_abs, {NOW.eps_rel} AS eps_rel, {NOW.gamma} AS gamma, {NOW.cluster} AS cluster UNION ALL SELECT 1, {SPAN} * 6 / 255, {NOW.eps_rel}, {NOW.gamma}, 8.0 / 6 UNION ALL {grid}"""


@query(f"""WITH {CELLS}, c AS (SELECT leaf_id, t, v, round(v - p, 9) AS r, coalesce(abs(v - lag(v) OVER (PARTITION BY leaf_id, voxel ORDER BY t)), 0) AS delta FROM paired), settings AS ({_settings_sql()}),
m AS (SELECT place, leaf_id, t, abs(r) AS a, greatest(1e-6, (eps_abs + eps_rel * abs(v)) / (1 + gamma * delta)) AS e, cluster FROM c, settings),
f AS (SELECT *, max(a / e) OVER (PARTITION BY place, leaf_id) <= cluster AS uniform FROM m), g AS (SELECT *, CASE WHEN uniform OR a <= e THEN a ELSE abs(a - floor(a / (2 * e) + 0.5) * 2 * e) END AS err, NOT uniform AND a > e AS event FROM f),
h AS (SELECT place, sum(4 + 2 * frames) AS head, count(*) FILTER (uniform) AS uniform FROM (SELECT place, leaf_id, count(DISTINCT t) AS frames, bool_and(uniform) AS uniform FROM f GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT place, count(*) FILTER (event) AS events, avg(err) AS mean, sqrt(avg(err * err)) AS rmse, max(err) AS max, count(*) AS n FROM g GROUP BY 1),
b AS (SELECT place, bin, sum(count(*)) OVER (PARTITION BY place ORDER BY bin) AS run FROM (SELECT place, least({search.BINS - 1}, floor(err / {SPAN} * {search.BINS})) AS bin FROM g) GROUP BY 1, 2),
q AS (SELECT b.place, (min(bin) + 1) * {SPAN} / {search.BINS} AS p99 FROM b JOIN o USING (place) WHERE run >= ceil(0.99 * n) GROUP BY 1),
z AS (SELECT place, CAST(head + 3 * events AS BIGINT) AS bytes, events, uniform, mean, rmse, max, p99, CASE WHEN rmse <= 0 THEN 120 ELSE 20 * log10({SPAN} / rmse) END AS psnr FROM o JOIN h USING (place) JOIN q USING (place)),
w AS (SELECT *, min(CASE WHEN psnr + 0.25 >= (SELECT max(psnr) FROM z) THEN bytes END) OVER () AS fewest, min(CASE WHEN psnr >= 28 AND p99 <= 5 THEN bytes END) OVER () AS target FROM z)
SELECT CAST(place AS INT) AS place, round(eps_abs, 6) AS eps_abs, eps_rel, gamma, round(cluster, 6) AS cluster, bytes, events, uniform, round(mean, 6) AS mean, round(rmse, 6) AS rmse, round(max, 6) AS max, round(p99, 6) AS p99, round(psnr, 6) AS psnr, CAST(row_number() OVER (ORDER BY bytes, round(psnr, 9) DESC, place) AS INT) AS rank,
place = min(CASE WHEN psnr + 0.25 >= (SELECT max(psnr) FROM z) AND bytes = fewest THEN place END) OVER () AS balanced, coalesce(place = min(CASE WHEN psnr >= 28 AND p99 <= 5 AND bytes = target THEN place END) OVER (), false) AS targeted FROM w JOIN settings USING (place)""")
def calibration_search(spark, sf_dir):
    """All 152 settings of the calibration grid over all cells: bytes, errors, rank by bytes, and which one is recommended, with targets and without."""
    before = F.lag("v").over(Window.partitionBy("leaf_id", "voxel").orderBy("t"))
    cells = _leafwise(spark, sf_dir).withColumn("delta", F.coalesce(F.abs(F.col("v") - before), F.lit(0.0)))
    found = written(search.calibrated(cells, search.calibration_grid(SPAN, NOW), SPAN), "settings")
    # as many rows as settings, whatever the data: one task may rank them
    whole = Window.partitionBy()
    top = F.col("psnr") + 0.25 >= F.max("psnr").over(whole)
    met = (F.col("psnr") >= 28) & (F.col("p99") <= 5)
    first = lambda ok: F.coalesce(F.col("place") == F.min(F.when(ok, F.struct("bytes", "place"))).over(whole)["place"], F.lit(False))
    ranked = found.withColumn("top", top).withColumns({"balanced": first(F.col("top")), "targeted": first(met)}).withColumn("rank", F.row_number().over(whole.orderBy("bytes", F.desc(F.round("psnr", 9)), "place")))
    return ranked.select("place", _r("eps_abs"), "eps_rel", "gamma", _r("cluster"), "bytes", "events", "uniform", *[_r(c) for c in ("mean", "rmse", "max", "p99", "psnr")], "rank", "balanced", "targeted")


POLICY = f"""{CELLS}, e AS (SELECT leaf_id, abs(round(v - p, 9)) AS a FROM paired), l AS (SELECT leaf_id, count(*) AS n, sum(a * a) AS sse_plain, sum(CASE WHEN a > 4 THEN (a - floor(a / 8 + 0.5) * 8) ** 2 ELSE a * a END) AS sse_coded, 4 + 3 * count(*) FILTER (a > 4) AS bytes, round(max(a), 6) AS worst FROM e GROUP BY 1),
leaves AS (SELECT *, row_number() OVER (ORDER BY worst DESC, leaf_id) AS place, count(*) OVER () AS total FROM l)"""


@query(f"""WITH RECURSIVE {POLICY}, prefix AS (SELECT 0 AS k, (SELECT sum(sse_plain) FROM leaves) AS sse, 0 AS bytes UNION ALL
SELECT place, (SELECT sum(sse_plain) FROM leaves) + sum(sse_coded - sse_plain) OVER (ORDER BY place), sum(bytes) OVER (ORDER BY place) FROM leaves),
known AS (SELECT k, CAST(bytes AS BIGINT) AS bytes, 20 * log10({PEAK} / sqrt(sse / (SELECT sum(n) FROM leaves))) AS psnr FROM prefix),
r AS (SELECT 1 AS round, total // 2 AS k, greatest(1, total // 4) AS step, total, false AS done FROM (SELECT max(total) AS total FROM leaves)
UNION ALL SELECT round + 1, best, greatest(1, step // 2), total, step = 1 AND best = k FROM (SELECT round, k, step, total, (SELECT min({{'bad': known.psnr < 30, 'cost': CASE WHEN known.psnr >= 30 THEN known.bytes ELSE -known.psnr END, 'k': known.k}}).k FROM known WHERE known.k IN (greatest(0, r.k - r.step), r.k, least(total, r.k + r.step))) AS best FROM r WHERE NOT done AND round <= 40)),
tried AS (SELECT DISTINCT round, unnest([greatest(0, k - step), k, least(total, k + step)]) AS k, step FROM r WHERE NOT done AND round <= 40)
SELECT CAST(tried.round AS INT) AS round, tried.k, tried.step, bytes, round(psnr, 6) AS psnr, tried.k = (SELECT n.k FROM r n WHERE n.round = tried.round + 1) AS chosen FROM tried JOIN known USING (k)""")
def policy_search(spark, sf_dir):
    """How many of the worst leaves get residuals: rounds of a search for 30 dB at the fewest bytes."""
    a = F.abs(F.round(F.expr("v - p"), 9))
    coded = F.expr("if(a > 4, pow(a - floor(a / 8 + 0.5) * 8, 2), a * a)")
    leaves = _paired(spark, sf_dir).select("leaf_id", a.alias("a")).groupBy("leaf_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.expr("a * a")).alias("sse_plain"), F.sum(coded).alias("sse_coded"), (4 + 3 * F.count_if(F.col("a") > 4)).alias("bytes"), F.round(F.max("a"), 6).alias("worst")
    )
    placed = written(ranks.ranked(leaves, [F.desc("worst"), F.col("leaf_id")], "place"), "policy")
    return search.policy_rounds(placed, PEAK, 30.0).withColumn("psnr", F.round("psnr", 6))
