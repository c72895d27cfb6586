"""Guarded clusters, exact tails, mesh distances and searches against plain code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldframe.operators import clusters, meshes, metrics, search


def plain_fit(a, b, keys, g):
    """Whether series a may stand behind series b, by loops."""
    frames = len(a)
    at = [(frames - 1) * s // 8 for s in range(9)]
    sa, sb = [a[t] for t in at], [b[t] for t in at]
    spread = lambda s: math.sqrt(max(0.0, sum((x - sum(s) / len(s)) ** 2 for x in s) / len(s)))
    scale = max(1e-5, spread(sa), max(sa) - min(sa))
    if max(abs(min(sa) - min(sb)), abs(max(sa) - max(sb))) / scale > 4.5:
        return False
    if abs(sa.index(min(sa)) - sb.index(min(sb))) > 2 and abs(sa.index(max(sa)) - sb.index(max(sb))) > 2:
        return False
    ma, mb = sum(sa) / 9, sum(sb) / 9
    va, vb, cov = sum((x - ma) ** 2 for x in sa), sum((x - mb) ** 2 for x in sb), sum((x - ma) * (y - mb) for x, y in zip(sa, sb, strict=True))
    if cov / math.sqrt(max(1e-12, va * vb)) < 0.60:
        return False
    way = lambda s: [(d > 1e-6) - (d < -1e-6) for d in (y - x for x, y in zip(s, s[1:]))]
    turns = [(x, y) for x, y in zip(way(sa), way(sb), strict=True) if x and y]
    if turns and sum(x != y for x, y in turns) / len(turns) > 0.45:
        return False
    state = lambda v: 1 if g.cutoff <= 0 else 0 if v < g.cutoff - g.band else 2 if v > g.cutoff + g.band else 1
    if any({state(a[t]), state(b[t])} == {0, 2} for t in keys):
        return False
    mean, deviation = sum(a) / frames, spread(a)
    error = lambda t: abs(a[t] - b[t]) / max(1e-6, g.eps_abs + g.eps_rel * max(abs(a[t] - mean), deviation))
    if max(error(t) for t in keys) > g.threshold:
        return False
    worst = max(error(t) for t in at)
    return worst <= max(0.65, 0.80 * g.threshold) and worst <= max(0.85, g.threshold)


def plain_clusters(block, keyed, g):
    n, frames = len(block), len(block[0])
    at = [(frames - 1) * s // 8 for s in range(9)]
    fits = lambda i, c: plain_fit(block[i], block[c], sorted({t for t in range(frames) if keyed[i][t] or keyed[c][t]} | {0, frames - 1}), g)
    far = lambda i, c: sum(abs(block[i][t] - block[c][t]) for t in at)
    centres, first = [], []
    for i in range(n):
        k = next((k for k, c in enumerate(centres) if fits(i, c)), None)
        first.append(len(centres) if k is None else k)
        if k is None:
            centres.append(i)
    for k in range(len(centres)):
        members = [i for i in range(n) if first[i] == k]
        centres[k] = min(members, key=lambda c: (sum(far(c, m) for m in members), c))
    last = []
    for i in range(n):
        open_to = [(far(i, c), k) for k, c in enumerate(centres) if fits(i, c)]
        last.append(min(open_to)[1] if open_to else len(centres))
        if not open_to:
            centres.append(i)
    return centres, last


@pytest.mark.parametrize("cutoff", [0.0, 12.0])
def test_guarded_clusters_against_loops(cutoff):
    draw = np.random.default_rng(3)
    waves = np.sin(np.arange(16) / draw.uniform(1, 4, (6, 1))) * 10 + 12
    block = waves[draw.integers(0, 6, 70)] * draw.uniform(0.7, 1.4, (70, 1)) + draw.normal(0, 0.7, (70, 16))
    block[5] = 4.0  # no correlation with anything
    keyed = draw.random((70, 16)) < 0.4
    g = clusters.Guards(eps_abs=2.0, eps_rel=0.4, threshold=1.6, cutoff=cutoff, band=2.0)
    centres, last, moved = clusters.guarded_clusters(block, keyed, g)
    want = plain_clusters(block.tolist(), keyed.tolist(), g)
    assert (centres, last.tolist()) == want and moved > 0 and 1 < len(set(last.tolist())) < 60
    assert (clusters.pairs_that_fit(block, keyed, g, step=7) == clusters.pairs_that_fit(block, keyed, g)).all()


def test_leaves_of_all_modes(spark):
    rows = [(0, v, t, float(10 + v + (t * t) % 7)) for v in range(3) for t in range(16)]
    noise = np.random.default_rng(5).uniform(0, 1000, (300, 16))
    rows += [(1, v, t, float(noise[v, t])) for v in range(300) for t in range(16)]
    rows += [(2, v, t, float(t)) for v in range(5) for t in (0, 7, 15)]
    g = clusters.Guards(eps_abs=3.0, eps_rel=0.1, threshold=1.5)
    got = clusters.leaf_clusters_guarded(spark.createDataFrame(rows, "leaf_id long, voxel long, t long, v double"), 16, g).collect()
    modes = {r.leaf_id: r.mode for r in got}
    assert modes == {0: "uniform", 1: "dense", 2: "uniform"} and len(got) == 308
    assert all(r.cluster is None and r.centre == r.voxel and r.worst == 0 for r in got if r.leaf_id == 1)
    assert all(r.worst <= 1.5 for r in got)


@pytest.mark.parametrize(("bins", "most"), [(262_144, 1 << 20), (7, 20), (9, 3)])
def test_order_statistics(spark, bins, most):
    draw = np.random.default_rng(1)
    values = {"a": draw.exponential(1, 900).tolist(), "b": [3.0] * 50, "c": [1.0, 1e9, 1.0, 2.0, 2.0, 1e-9] * 30, "d": [-5.0], "e": [-1.0, -2.0, None, 4.0]}
    rows = [(k, v) for k, some in values.items() for v in some]
    n = F.col("n")
    ranks = {"first": F.lit(1), "half": F.ceil(n * 0.5), "p99": F.ceil(n * F.lit(0.99)), "last": n}
    got = {r.k: r for r in metrics.order_statistics(spark.createDataFrame(rows, "k string, v double"), "k", "v", ranks, bins, most).collect()}
    for k, some in values.items():
        some = sorted(x for x in some if x is not None)
        assert (got[k].n, got[k].first, got[k].half, got[k].p99, got[k].last) == (len(some), some[0], some[math.ceil(len(some) * 0.5) - 1], some[math.ceil(len(some) * 0.99) - 1], some[-1]), k
    lines = {r.k: r for r in metrics.linear_percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p25": 0.25, "p95": 0.95}).collect()}
    for k, some in values.items():
        some = [x for x in some if x is not None]
        assert (lines[k].p25, lines[k].p95) == pytest.approx(tuple(np.percentile(some, [25, 95]))), k


def plain_distance(p, a, b, c):
    """To a triangle, by the plane where its foot lies inside, else by the three edges."""
    n = np.cross(b - a, c - a)
    h = np.dot(p - a, n) / np.dot(n, n)
    foot = p - h * n
    if all(np.dot(np.cross(q - o, foot - o), n) >= 0 for o, q in ((a, b), (b, c), (c, a))):
        return float(np.dot(p - foot, p - foot))
    out = []
    for o, q in ((a, b), (b, c), (c, a)):
        t = min(1.0, max(0.0, np.dot(p - o, q - o) / np.dot(q - o, q - o)))
        out.append(float(((p - o - t * (q - o)) ** 2).sum()))
    return min(out)


def test_nearest_triangle_of_scattered_and_lonely_points(spark):
    draw = np.random.default_rng(7)
    centre = np.vstack([draw.normal(0, 2, (60, 3)), draw.normal(40, 1, (40, 3))])
    corners = centre[:, None] + draw.normal(0, 1.5, (100, 3, 3))
    corners[0, 1] += 30  # one triangle spans many blocks
    points = np.vstack([draw.normal(0, 6, (40, 3)), draw.uniform(-200, 200, (10, 3)), corners[:5].mean(axis=1), corners[5:8, 0]])
    flat = [(1, 900, *[0.0] * 6, *[1.0] * 3), (2, 0, *range(9))]
    triangles = spark.createDataFrame([(1, i, *map(float, c.ravel())) for i, c in enumerate(corners)] + [(k, t, *map(float, c)) for k, t, *c in flat], "k int, tri long, " + ", ".join(f"{c} double" for c in meshes.CORNERS))
    asked = spark.createDataFrame([(1, i, *map(float, p), 0.0, 0.0, 1.0) for i, p in enumerate(points)] + [(3, 0, *[0.0] * 6)], "k int, id long, px double, py double, pz double, nx double, ny double, nz double")
    got = {r.id: r for r in meshes.nearest_triangle(asked, meshes.with_normals(triangles), "k", 2.0, 7).collect()}
    assert len(got) == len(points)
    for i, p in enumerate(points):
        want = [plain_distance(p, *c) for c in corners]
        assert got[i].d2 == pytest.approx(min(want), abs=1e-9) and want[got[i].tri] == pytest.approx(min(want), abs=1e-8), i
    m = meshes.direction_metrics(meshes.nearest_triangle(asked, meshes.with_normals(triangles), "k", 2.0, 7), "k").first()
    d = np.sqrt([min(plain_distance(p, *c) for c in corners) for p in points])
    assert (m.n, m["mean"], m.largest, m.p95, m.p99) == pytest.approx((len(d), d.mean(), d.max(), *np.percentile(d, [95, 99])))


def test_meshes_of_squares_and_samples(spark):
    grid = spark.createDataFrame([(0, x, y, float(x)) for x in range(3) for y in range(2)] + [(1, 0, 0, 1.0)], "k long, x long, y long, h double")
    mesh = meshes.with_normals(meshes.height_mesh(grid, "k"))
    rows = mesh.collect()
    assert len(rows) == 4 and all(r.area == pytest.approx(math.sqrt(2) / 2) and abs(r.nx) == pytest.approx(math.sqrt(0.5)) for r in rows)
    samples = meshes.surface_samples(mesh, "k", 10.0).collect()
    assert len(samples) == 4 * 7 and all(s.px == pytest.approx(s.pz) and 0 <= s.py <= 1 for s in samples)
    same = meshes.mesh_distances(meshes.height_mesh(grid, "k"), meshes.height_mesh(grid, "k"), "k", 4.0, 1.0, 3).collect()
    assert len(same) == 1 and same[0].hausdorff == pytest.approx(0, abs=1e-7) and same[0].unoriented_angle == pytest.approx(0, abs=1e-3)


def test_calibration_grid_without_repeats():
    assert len(search.calibration_grid(50.0, search.Setting(2.0, 0.05, 0.1, 4.0))) == 152
    # the present setting lies on the grid, the older one near another of its points
    near = search.calibration_grid(255.0, search.Setting(6.0, 0.01, 0.2, 8.0 / 6))
    assert len(near) == 150 and near[0] == search.Setting(6.0, 0.01, 0.2, 8.0 / 6)


def test_policy_rounds_reach_the_target(spark):
    leaves = spark.createDataFrame([(i, 10, 1000.0 / i, 1.0, 7) for i in range(1, 65)], "place int, n long, sse_plain double, sse_coded double, bytes long")
    rows = search.policy_rounds(leaves, 10.0, 19.0).collect()
    picked = [r for r in rows if r.chosen][-1]
    psnr = lambda k: 20 * math.log10(10 / math.sqrt((k + sum(1000.0 / i for i in range(k + 1, 65))) / 640))
    assert picked.psnr == pytest.approx(psnr(picked.k)) and picked.psnr >= 19 > psnr(picked.k - 1) and picked.bytes == 7 * picked.k
    assert [r.chosen for r in search.policy_rounds(leaves.limit(0), 10.0, 19.0).collect()] == [True]


def test_meshes_held_by_a_task_and_spread_over_tasks(spark, monkeypatch):
    draw = np.random.default_rng(3)
    grid = spark.createDataFrame([(k, x, y, float(a), float(b)) for k in range(3) for x in range(9) for y in range(7 + k) for a, b in [draw.normal(0, 2, 2)]], "k long, x long, y long, a double, b double")
    only = spark.createDataFrame([(7, x, y, 0.0) for x in range(3) for y in range(3)], "k long, x long, y long, h double")
    mesh = lambda c: meshes.height_mesh(grid.select("k", "x", "y", F.col(c).alias("h")).unionByName(only if c == "a" else only.limit(0)), "k")
    real, steps = meshes.nearest_triangle, []
    monkeypatch.setattr(meshes, "nearest_triangle", lambda *a: steps.append(a) or real(*a))
    compared = lambda: {r.k: r.asDict() for r in meshes.mesh_distances(mesh("a"), mesh("b"), "k", 2.5, 1.0, 4).collect()}
    held = compared()
    # meshes of this size are one task's work: no pairs of points and blocks are shuffled
    assert not steps and sorted(held) == [0, 1, 2]
    monkeypatch.setattr(meshes, "_PAIRS", 50)
    assert compared() == held
    for most in (0, 900):
        monkeypatch.setattr(meshes, "HELD", most)
        spread = compared()
        assert steps and sorted(spread) == [0, 1, 2]
        for k, row in held.items():
            assert row == pytest.approx(spread[k], abs=1e-9), (k, most)


def test_calibration_shuffles_cells_once(spark, monkeypatch):
    from fieldframe.plans import searches

    plans = []
    monkeypatch.setattr(searches, "written", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    searches.calibration_search(spark, "/root/testdata/sf0.001")
    # the rows by leaf, then settings' bins and settings: all but the first hold some rows a setting
    assert plans[0].count("Exchange hashpartitioning(") == 3 and plans[0].count("Scan parquet") == 1
