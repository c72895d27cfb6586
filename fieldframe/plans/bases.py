"""Registered queries of patches, temporal bases and keyframe lineages, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import codec, fits, lineages
from .catalog import CELLS, RESID, SERIES, T, _leafwise, _paired, _r, _residuals, _series, query

_ENDS = "[0.7::DOUBLE, 0.4, 0.1, -0.2]"
_AXIS = {"x": "voxel % 4", "y": "voxel // 8 % 4", "z": "voxel // 64 % 4"}


def _fit_weight(c):
    """A line's ends from four points by least squares have the weights 0.7, 0.4, 0.1, -0.2."""
    return " * ".join(f"{_ENDS}[{'4 - ' if c >> i & 1 else '1 + '}{_AXIS[a]}]" for i, a in enumerate("xyz"))


def _line_weight(c):
    return " * ".join(f"({_AXIS[a]}) / 3.0::DOUBLE" if c >> i & 1 else f"(1 - ({_AXIS[a]}) / 3.0::DOUBLE)" for i, a in enumerate("xyz"))


_PATCH = "(voxel // 64 // 4 * 2 + voxel // 8 % 8 // 4) * 2 + voxel % 8 // 4"


@query(f"""WITH {CELLS}, r AS (SELECT leaf_id, t, voxel, {_PATCH} AS patch, v - p AS v FROM paired), f AS (SELECT leaf_id, t, patch, {', '.join(f'sum(v * {_fit_weight(c)}) AS c{c}' for c in range(8))} FROM r GROUP BY 1, 2, 3),
d AS (SELECT leaf_id, t, patch, v, {' + '.join(f'c{c} * {_line_weight(c)}' for c in range(8))} AS fitted, c0, c7 FROM r JOIN f USING (leaf_id, t, patch))
SELECT leaf_id, t, CAST(patch AS BIGINT) AS patch, count(*) AS n, round(max(c0), 9) AS first_control, round(max(c7), 9) AS last_control, round(sqrt(avg(v * v)), 6) AS before, round(sqrt(avg((v - fitted) * (v - fitted))), 6) AS passed_on FROM d GROUP BY 1, 2, 3""")
def patch_fits(spark, sf_dir):
    """Residuals of every leaf and frame fitted by patches of 4 x 4 x 4 voxels, and what each patch passes on."""
    rows = _paired(spark, sf_dir).select("leaf_id", "t", "voxel", F.expr("v - p").alias("v"))
    ends = fits.patch_fit(rows).select("leaf_id", "t", "patch", F.round(F.col("controls")[0], 9).alias("first_control"), F.round(F.col("controls")[7], 9).alias("last_control"))
    root = lambda c: F.round(F.sqrt(F.avg(F.col(c) * F.col(c))), 6)
    sums = fits.patch_residuals(rows).groupBy("leaf_id", "t", "patch").agg(F.count(F.lit(1)).alias("n"), root("v").alias("before"), root("passed_on").alias("passed_on"))
    return sums.join(ends, ["leaf_id", "t", "patch"]).select("leaf_id", "t", "patch", "n", "first_control", "last_control", "before", "passed_on")


KEEP, BITS = 6, 4
_B = C.dct_basis("16e0", "t", "k")


@query(f"""WITH {RESID}, c AS (SELECT leaf_id, voxel, k, sum(r * {_B}) AS c FROM resid, range({KEEP}) b(k) GROUP BY 1, 2, 3), s AS (SELECT *, max(abs(c)) OVER (PARTITION BY leaf_id, k) AS scale FROM c),
q AS (SELECT leaf_id, voxel, k, CASE WHEN scale <= 1e-12 THEN 1 / 15.0::DOUBLE * 2 - 1 ELSE floor(0.5 * (c / scale + 1) * 15 + 0.5) / 15 * 2 - 1 END * scale AS q FROM s),
d AS (SELECT leaf_id, voxel, t, r, k + 1 AS held, sum(q * {_B}) OVER (PARTITION BY leaf_id, voxel, t ORDER BY k) AS decoded FROM resid JOIN q USING (leaf_id, voxel))
SELECT leaf_id, CAST(held AS INT) AS keep, CAST(held * (2 + (512 * {BITS} + 7) // 8) AS BIGINT) AS bytes, round(sqrt(avg((r - decoded) * (r - decoded))), 6) AS rmse, round(max(abs(r - decoded)), 6) AS worst FROM d GROUP BY leaf_id, held""")
def temporal_basis_residuals(spark, sf_dir):
    """Every voxel's residual series as 1 to 6 cosine coefficients of four bits under a scale by leaf and basis: bytes and errors by how many are kept."""
    rows = codec.temporal_bases(_leafwise(spark, sf_dir).select("leaf_id", "voxel", "t", F.round(F.expr("v - p"), 9).alias("r")), T, KEEP, BITS)
    each = rows.select("leaf_id", "r", F.posexplode("decoded").alias("place", "decoded")).withColumn("e", F.abs(F.expr("r - decoded")))
    size = codec.dense_bytes(F.col("keep"), BITS, F.lit(512)).cast("long").alias("bytes")
    sums = each.groupBy("leaf_id", (F.col("place") + 1).alias("keep")).agg(F.round(F.sqrt(F.avg(F.expr("e * e"))), 6).alias("rmse"), F.round(F.max("e"), 6).alias("worst"))
    return sums.select("leaf_id", "keep", size, "rmse", "worst")


RULES = {
    "surface": lineages.Bands(iso=15000, critical=500, near=2000, band=6000, eps_critical=500, eps_near=2000, eps_far=8000, floor=10),
    "density": lineages.Relative(eps_abs=1500, eps_rel=0.05, gamma=0.00001, centred=False, cutoff=15000, band=300),
    "generic": lineages.Relative(eps_abs=1500, eps_rel=0.4, gamma=0.2, centred=True),
}
_EPS = """CASE lineage WHEN 'surface' THEN CASE WHEN least(abs(v - 15000), abs(line - 15000)) <= 500 THEN 500 WHEN least(abs(v - 15000), abs(line - 15000)) <= 2000 THEN 2000 WHEN least(abs(v - 15000), abs(line - 15000)) <= 6000 THEN 5000 ELSE 8000 END
WHEN 'density' THEN greatest(1e-4, (1500 + 0.05 * abs(v)) / (1 + 0.00001 * step)) ELSE (1500 + 0.4 * greatest(abs(v - mean), deviation)) / (1 + 0.2 * step / unit) END"""


@query(f"""WITH RECURSIVE {SERIES}, d0 AS (SELECT user_id, t, CAST(cents AS DOUBLE) AS v, 1 + t % 3 AS w, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, abs(cents - lag(cents) OVER (PARTITION BY user_id ORDER BY t)) AS step FROM series),
st AS (SELECT user_id, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS deviation, var_pop(v) AS var, greatest(1e-4, list_sort(list(step) FILTER (step IS NOT NULL))[1 + least(count(*) - 2, (count(*) - 1) * 9 // 10)]) AS unit FROM d0 GROUP BY 1),
d AS (SELECT d0.*, n, mean, deviation, unit FROM d0 JOIN st USING (user_id)), l AS (SELECT user_id, n, var, unnest(['surface', 'density', 'generic']) AS lineage FROM st), g AS (SELECT *, CASE lineage WHEN 'surface' THEN 10.0 ELSE 150.0 END AS floor, n < 2 OR var < CASE lineage WHEN 'surface' THEN 100 ELSE 22500 END AS flat FROM l),
seg AS (SELECT user_id, lineage, floor, 0 AS a, n - 1 AS b FROM g WHERE NOT flat UNION ALL
SELECT user_id, lineage, floor, unnest([a, m.i]), unnest([m.i, b]) FROM (SELECT user_id, lineage, floor, a, b, min({{'e': -err, 'i': i}}) AS m FROM
(SELECT user_id, lineage, floor, a, b, i, abs(v - line) / greatest(greatest(({_EPS}), floor) / greatest(1, w), floor * 0.25) AS err FROM
(SELECT s.user_id, s.lineage, s.floor, s.a, s.b, x.i, x.v, x.w, x.step, x.mean, x.deviation, x.unit, p.v + (x.i - s.a) / CAST(s.b - s.a AS DOUBLE) * (q.v - p.v) AS line FROM seg s JOIN d x ON x.user_id = s.user_id AND x.i > s.a AND x.i < s.b JOIN d p ON p.user_id = s.user_id AND p.i = s.a JOIN d q ON q.user_id = s.user_id AND q.i = s.b)) GROUP BY 1, 2, 3, 4, 5) WHERE m.e < -1),
k AS (SELECT DISTINCT user_id, lineage, unnest([a, b]) AS i FROM seg), split AS (SELECT user_id, lineage FROM k GROUP BY 1, 2 HAVING count(*) > 2),
z AS (SELECT user_id, i, CASE WHEN v < 14700 THEN 0 WHEN v > 15300 THEN 2 ELSE 1 END AS s FROM d), zz AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY i) AS before FROM z),
kept AS (SELECT user_id, lineage, i FROM k UNION SELECT user_id, lineage, 0 FROM g WHERE flat UNION SELECT zz.user_id, 'density', unnest([i - 1, i, i + 1]) FROM zz JOIN split ON split.user_id = zz.user_id AND split.lineage = 'density' WHERE s = 1 OR s <> before)
SELECT kept.user_id, lineage, CAST(kept.i AS INT) AS place, d.t, d.v FROM kept JOIN d ON d.user_id = kept.user_id AND d.i = kept.i""")
def keyframe_lineages(spark, sf_dir):
    """Keyframes of every series by bands around a surface, by relative tolerances with protected cutoffs, and by centred ones, side by side."""
    return lineages.lineages(_series(spark, sf_dir), "user_id", "cents", "1 + t % 3", RULES)


_DENSE = "CAST(8 + (t1 - t0 + 1) * (2 + ({values} * 3 + 7) // 8) AS BIGINT)"


@query(f"""WITH {RESID}, e AS (SELECT leaf_id, t, voxel % 8 AS x, voxel // 8 % 8 AS y, voxel // 64 AS z FROM resid WHERE abs(r) / 50 >= 0.45),
b AS (SELECT leaf_id, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, min(t) AS t0, max(t) AS t1, count(DISTINCT (x // 4, y // 4, z // 4)) AS patches, count(DISTINCT (x // 2, y // 2, z // 2)) AS tiles FROM e GROUP BY 1),
s AS (SELECT *, CASE WHEN n <= 64 THEN 64 WHEN n <= 256 THEN 256 WHEN n <= 768 THEN 768 ELSE 1024 END AS tier FROM b),
c AS (SELECT *, CAST(100 + tier * 2 + (tier + 1) // 2 AS BIGINT) AS sparse_bytes, {_DENSE.format(values='(x1 - x0 + 1) * (y1 - y0 + 1) * (z1 - z0 + 1)')} AS box_bytes, {_DENSE.format(values='patches * 64')} AS patch_bytes, {_DENSE.format(values='tiles * 8')} AS tile_bytes FROM s)
SELECT leaf_id, n, CAST((x1 - x0 + 1) * (y1 - y0 + 1) * (z1 - z0 + 1) AS INT) AS box_cells, CAST(t0 AS INT) AS t0, CAST(t1 AS INT) AS t1, CAST(patches AS INT) AS patches, CAST(tiles AS INT) AS tiles, sparse_bytes, box_bytes, patch_bytes, tile_bytes,
CASE least(sparse_bytes, box_bytes, patch_bytes, tile_bytes) WHEN sparse_bytes THEN 'sparse' WHEN box_bytes THEN 'box' WHEN patch_bytes THEN 'patch' ELSE 'tile' END AS layout FROM c""")
def byte_crossovers(spark, sf_dir):
    """For each leaf's large residuals what events, a bounding box, patches and tiles would take, and the smallest."""
    events = _residuals(spark, sf_dir).where("abs(r) / norm >= 0.45").select("leaf_id", "voxel", "t")
    c = codec.crossovers(events, 3)
    return c.select("leaf_id", "n", F.expr("(x1 - x0 + 1) * (y1 - y0 + 1) * (z1 - z0 + 1)").alias("box_cells"), "t0", "t1", *[F.col(x).cast("int").alias(x) for x in ("patches", "tiles")], "sparse_bytes", "box_bytes", "patch_bytes", "tile_bytes", "layout")
