"""Audits of decoded volumes against plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldframe.operators import audits, projections, routes

CELL = "leaf_id long, voxel long, x long, y long, z long, t long, v double, coarse double, decoded double, is_event boolean"


def _volume(n, seed):
    r = random.Random(seed)
    spots = r.sample([(x, y, z, t) for x in range(16) for y in range(8) for z in range(8) for t in range(4)], n)
    out = []
    for x, y, z, t in spots:
        v = r.choice([0.0, 0.2, 0.5, 0.75, 1.0])
        out.append((x // 8, (z * 8 + y) * 8 + x % 8, x, y, z, t, v, v + r.choice([-0.5, 0.0, 0.25]), v + r.choice([-0.25, 0.0, 0.125]), r.random() < 0.3))
    return out


def test_leaf_diagnosis_and_summary(spark):
    cells = _volume(900, 1)
    leaves = audits.leaf_diagnosis(spark.createDataFrame(cells, CELL), 0.5, 0.25, 1.0)
    got = {r.leaf_id: r for r in leaves.collect()}
    for leaf in (0, 1):
        mine = [c for c in cells if c[0] == leaf]
        band = [c for c in mine if abs(c[6] - 0.5) <= 0.25]
        r = got[leaf]
        assert (r.voxels, r.band, r.active) == (len(mine), len(band), sum(c[6] > 1e-6 for c in mine))
        assert r.flips == sum((c[6] >= 0.5) != (c[8] >= 0.5) for c in band) and r.coarse_flips == sum((c[6] >= 0.5) != (c[7] >= 0.5) for c in band)
        assert r.shell_active == len({c[1] for c in mine if c[9]}) and r.fine_keys == sum(c[9] for c in mine)
        assert (r.negative, r.over) == (sum(c[8] < 0 for c in mine), sum(c[8] > 1 for c in mine))
        assert r.band_sse == pytest.approx(sum((c[8] - c[6]) ** 2 for c in band)) and r.coarse_sse == pytest.approx(sum((c[7] - c[6]) ** 2 for c in mine))
        worst = min(mine, key=lambda c: (-abs(c[8] - c[6]), c[5], c[4], c[3], c[2]))
        assert (r.worst.x, r.worst.y, r.worst.z, r.worst.t) == (worst[2], worst[3], worst[4], worst[5])
    rows = {r["mode"]: r for r in audits.mode_summary(leaves.withColumn("mode", F.when(F.col("leaf_id") == 0, "a").otherwise("b"))).collect()}
    assert set(rows) == {"a", "b", "TOTAL"} and rows["TOTAL"].leaves == 2
    assert rows["TOTAL"].flip_rate == pytest.approx((got[0].flips + got[1].flips) / (got[0].band + got[1].band))


def test_leaves_without_band_come_last_and_have_no_rates(spark):
    cells = [(k, 0, 0, 0, 0, 0, v, p, p, False) for k, v, p in ((3, 9.0, 9.5), (2, 9.0, 9.5), (1, 0.5, 0.4), (0, 0.5, 0.6))]
    leaves = audits.measures(audits.leaf_diagnosis(spark.createDataFrame(cells, CELL), 0.5, 0.25, 10.0))
    assert [r.leaf_id for r in leaves.orderBy(*audits.instability()).collect()] == [1, 0, 2, 3]
    assert all(r.flip_rate == r.band_rmse == r.keys_per_active == 0 for r in leaves.where("leaf_id > 1").collect())
    none = spark.createDataFrame([], CELL)
    assert audits.leaf_diagnosis(none, 0.5, 0.25, 1.0).count() == 0


def test_frames_and_points_decode_alike(spark):
    r = random.Random(2)
    coefficients = spark.createDataFrame([(leaf, k, r.gauss(0, 1)) for leaf in range(3) for k in range(4)], "leaf_id long, k int, c double")
    events = [(leaf, voxel, t, r.randint(-7, 7), 0.3) for leaf in range(2) for voxel in range(0, 512, 7) for t in (0, 3, 5)]
    points = [(leaf, voxel, t) for leaf in range(5) for voxel in (0, 7, 8, 511) for t in (0, 1, 5)]
    both = audits.decoded_both_ways(spark.createDataFrame(points, "leaf_id long, voxel long, t long"), coefficients, spark.createDataFrame(events, "leaf_id long, voxel long, t long, q int, scale double"), 8).collect()
    assert len(both) == len(points) and all(b.equal for b in both)
    assert all(b.by_frame == 0 for b in both if b.leaf_id > 2)
    c = {(x.leaf_id, x.k): x.c for x in coefficients.collect()}
    found = {e[:3]: e[3] * e[4] for e in events}
    for b in both:
        if b.leaf_id < 3:
            want = sum(c[b.leaf_id, k] * (math.sqrt(1 / 8) if k == 0 else math.sqrt(2 / 8) * math.cos(math.pi / 8 * (b.t + 0.5) * k)) for k in range(4))
            assert b.by_point == pytest.approx(want + found.get((b.leaf_id, b.voxel, b.t), 0.0))


@pytest.mark.parametrize("stretches", [(8, 8192), (2, 8), (4, 8, 32), (64,)])
def test_projection_against_a_loop(spark, stretches):
    r = random.Random(3)
    rows = [(ray, z, v) for ray in range(12) for z in r.sample(range(200), 90) for v in [r.choice([0.0, 1.0, 2.5, 6.0]) * (ray % 4)]]
    d = spark.createDataFrame(rows, "ray long, z long, v double").withColumn("optical", projections.optical_depth(F.col("v"), 2.0))
    got = {x.ray: x for x in projections.projected(d.select("ray", "z", "optical"), ["ray"], stretches).collect()}
    for ray in range(12):
        image, light, seen = 0.0, 1.0, 0
        for _, _, v in sorted(x for x in rows if x[0] == ray):
            alpha = 1 - math.exp(-2 * max(0.0, v - 2) / 2)
            image, light, seen = image + light * alpha, light * (1 - alpha), seen + 1
            if light < 1e-3:
                break
        assert got[ray].samples == seen and got[ray].image == pytest.approx(image)


def test_projection_of_nothing_and_likeness(spark):
    none = spark.createDataFrame([], "ray long, z long, optical double")
    assert projections.projected(none, ["ray"]).count() == 0
    pairs = spark.createDataFrame([(0, 0.5, 0.25), (0, 1.0, 1.0), (1, 0.0, 0.0)], "t long, truth double, image double")
    got = {x.t: x for x in projections.likeness(pairs, "t", 4).collect()}
    assert got[0].rmse == pytest.approx(0.125) and got[0].psnr == pytest.approx(20 * math.log10(8)) and got[1].psnr == 120


def test_route_limits_bands_and_overflow(spark):
    assert routes.limits_for("liquid").fine_gain == 1 and routes.limits_for("liquid").shell_gain == routes.DEFAULTS.shell_gain
    assert routes.limits_for("density").shell_rmse == 1 and routes.limits_for("density").visible == routes.DEFAULTS.visible
    with pytest.raises(ValueError):
        routes.limits_for("smoke")
    assert routes.level_set_bands(0.1) == pytest.approx({"surface": 0.15, "guard": 0.075, "temporal": 0.01})
    assert routes.level_set_bands(0.1, 4)["guard"] == pytest.approx(0.2)
    rows = [("shell", 10, 5), ("shell", 11, 5), ("shell", 11, 0), ("coarse", 11, 20), ("empty", 11, 5)]
    m = spark.createDataFrame(rows, "mode string, s long, f long")
    assert [r[0] for r in m.select(routes.within_streams(F.col("mode"), F.col("s"), F.col("f"), 10)).collect()] == ["shell", "fine", "coarse", "coarse", "empty"]


def test_route_metrics_on_a_lattice(spark):
    cells = [(0, x, 0, 0, t, float(10 * x + t), 10.0 * x, 10.0 * x + t, 10.0 * x + t - 1) for x in range(8) for t in range(4)] + [(1, 9, 0, 0, 0, 0.5, 0.0, 0.0, 0.0)]
    d = spark.createDataFrame(cells, "leaf_id long, x long, y long, z long, t long, v double, coarse double, fine double, shell double")
    got = {r.leaf_id: r for r in routes.route_metrics(d, 2, 100.0, 40.0, 5.0, F.lit(73.0), 1.0).collect()}
    sampled = [c for c in cells[:-1] if c[1] % 2 == 0 and c[4] % 2 == 0]
    shell = [c for c in sampled if c[5] >= 0.35 * 73]
    r = got[0]
    assert r.samples == len(sampled) and not r.is_empty
    assert r.visible_share == sum(c[5] >= 35 for c in sampled) / len(sampled) and r.band_share == sum(35 <= c[5] <= 45 for c in sampled) / len(sampled)
    assert r.coarse_rmse == pytest.approx(math.sqrt(sum((c[5] - c[6]) ** 2 for c in sampled) / len(sampled)) / 100) and r.fine_rmse == 0 and r.coarse_peak == 0.02
    assert r.shell_share == len(shell) / len(sampled) and r.shell_voxel_rmse == pytest.approx(0.01)
    assert got[1].is_empty and got[1].samples == 0 and got[1].coarse_rmse == 0
    signed = spark.createDataFrame([(0, 0, 3.0, 3.0), (0, 1, 1.0, 9.0), (0, 2, 9.0, 0.4), (0, 3, 9.0, -9.0), (0, 0, 1.5, 2.0)], "leaf_id long, voxel long, v double, coarse double")
    assert sorted(r.voxel for r in routes.surface_voxels(signed, 1.5, 0.75).collect()) == [0, 1, 2, 3]


def test_decoded_cells_are_shuffled_once(spark):
    from fieldframe.plans import audits as plans

    data = "/root/testdata/sf0.001"
    made = plans._decoded(spark, data)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1
    places = lambda rows: {(r.x, r.y, r.z, r.t): (r.v, round(r.decoded, 8)) for r in rows.collect()}
    got = places(made)
    assert got == places(plans._judged(spark, data)) and len(got) > 1000
