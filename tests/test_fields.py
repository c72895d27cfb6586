"""Operators of fields against plain code: ranks, keyframes, fits, half floats, files, and errors."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldframe.functions import bits
from fieldframe.operators import codec, fits, keep, lattice, ranks, tails
from fieldframe.sources import packed, raw, shared, texts


def test_ranks_and_running_sums(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = sorted((r.v, r.place) for r in ranks.ranked(rows, [F.desc("v")], "place").collect())
    assert got == [(v, 1000 - v) for v in range(1000)]
    sums = sorted((r.k, r.a, r.b) for r in ranks.running(rows, [F.col("k")], F.col("k") + 1, "a", "b").collect())
    assert sums == [(k, k * (k + 1) // 2, (k + 1) * (k + 2) // 2) for k in range(1000)]
    assert ranks.ranked(rows.limit(0), [F.col("v")], "place").count() == 0


def test_budget_places_are_the_best():
    rng = np.random.default_rng(5)
    for n, k in ((7, 3), (8, 4), (6, 6), (5, 9), (9, 2)):
        t, v = np.cumsum(rng.integers(1, 4, n)).astype(float), rng.normal(size=n)
        places, sse = fits.budget_places(t, v, k)
        error = lambda p: float(((np.interp(t, t[list(p)], v[list(p)]) - v) ** 2).sum())  # noqa: E731, B023
        best = min((error((0, *inner, n - 1)) for inner in itertools.combinations(range(1, n - 1), min(k, n) - 2)), default=0.0)
        assert abs(sse - best) < 1e-9 and abs(error(places) - best) < 1e-9 and len(places) == min(k, n)


def test_polynomials_against_least_squares(spark):
    rng = np.random.default_rng(6)
    cells = [(leaf, voxel, float(rng.normal())) for leaf in (1, 2) for voxel in rng.choice(512, 200, replace=False).tolist()]
    got = {(r.leaf_id, r.term): r.c for r in fits.polynomial_fit(spark.createDataFrame(cells, "leaf_id long, voxel long, v double"), ["leaf_id"], fits.POLY11).collect()}
    for leaf in (1, 2):
        voxel = np.array([c[1] for c in cells if c[0] == leaf])
        x, y, z = ((voxel // d % 8) / 3.5 - 1 for d in (1, 8, 64))
        a = np.stack([eval(e, {"px": x, "py": y, "pz": z}) * np.ones(len(x)) for e in fits.POLY11], axis=1)
        want = np.linalg.lstsq(a, np.array([c[2] for c in cells if c[0] == leaf]), rcond=None)[0]
        assert np.allclose([got[leaf, i] for i in range(11)], want)


def test_half_floats_against_numpy(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-9, 7, 300), [0.0, -0.0, 1.0, 2.0**-14, 2.0**-24, 2.0**-25 * 1.01, 65504.0, 65519.9, 65520.0, 1e9, -3.5]])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double").withColumn("b", bits.half_bits(F.col("v")))
    for r in df.withColumn("w", bits.half_value(F.col("b"))).collect():
        want = np.float64(r.v).astype(np.float16)
        tie = abs(abs(float(want)) - abs(r.v)) == abs(float(np.nextafter(want, np.float16(np.sign(r.v) * np.inf))) - r.v)
        assert tie or r.w == float(want), r
        assert r.b == int(np.float16(r.w).view(np.uint16)) or r.v == 0


def test_bits(spark):
    c = F.lit
    row = spark.range(1).select(bits.packed([(c(5), 0, 2), (c(9), 2, 3)]).alias("word"), bits.unpacked(c(0b110101), 2, 3).alias("part"), bits.triple(c(" 1, -2,3 ")).alias("t"), bits.triple(c("1,2")).alias("none"), bits.stepped(c(0), c(-1), 10, True).alias("round"), bits.stepped(c(9), c(5), 10, False).alias("end")).first()
    assert (row.word, row.part, tuple(row.t), row.none, row.round, row.end) == (0b101, 0b101, (1, -2, 3), None, 9, 9)


def test_ladders_patterns_and_parts(spark):
    assert codec.keep_ladder(12) == [4, 6, 8, 10, 12] and codec.keep_ladder(13) == [4, 6, 8, 10, 12, 14] and codec.keep_ladder(1) == [4] and codec.keep_ladder(99)[-1] == 16
    assert [lattice.sub_start(32, 12), lattice.sub_start(32, 20, 30), lattice.sub_start(8, 9), lattice.sub_start(16, 6, 4)] == [10, 12, 0, 4]
    assert lattice.phases(16) == (0, 4) and lattice.phases(12) == lattice.phases(4) == (0,)
    ids = spark.range(600).withColumnRenamed("id", "qid")
    with pytest.raises(ValueError, match="unknown pattern"):
        lattice.query_pattern(ids, "spiral", 8, 8, 8, 8)
    tiles = lattice.query_pattern(ids, "coherent", 12, 20, 9, 5).toPandas()
    assert tiles[["x", "y", "z", "t"]].max().tolist() <= [11, 19, 8, 4] and tiles["t"].nunique() == 1 and tiles[["x", "y", "z"]].min().min() >= 0
    assert lattice.query_pattern(ids, "same_xyz", 12, 20, 9, 5).select("x", "y", "z").distinct().count() == 1


def test_targets_and_balance(spark):
    c = spark.createDataFrame([(1, 0, 100, 30.0, 0.5), (1, 1, 80, 29.9, 0.7), (1, 2, 60, 20.0, 0.9), (2, 0, 9, 10.0, 5.0)], "k long, place int, bytes long, psnr double, p99 double")
    assert {(r.k, r.place) for r in tails.balanced(c, ["k"]).collect()} == {(1, 1), (2, 0)}
    assert {(r.k, r.place) for r in tails.least_bytes(c, ["k"], tails.meets(p99=0.95)).collect()} == {(1, 2)}
    assert tails.least_bytes(c, ["k"], tails.meets()).count() == 2 and tails.least_bytes(c, ["k"], tails.meets(psnr=99)).count() == 0


def test_compaction_default(spark):
    kinds = [(1, 0, "air"), (1, 1, "inside"), (1, 2, "leaf"), (2, 0, "inside"), (2, 1, "inside"), (2, 2, "air")]
    got = {(r.p, r.child): (r.default, r.place) for r in keep.compacted(spark.createDataFrame(kinds, "p long, child long, value string"), "p").collect()}
    assert got == {(1, 1): ("air", 0), (1, 2): ("air", 1), (2, 2): ("inside", 0)}


def test_stacked_volumes_and_pushed_conditions(spark, tmp_path):
    cells = [(x, y, z, t, float(1000 * t + 100 * z + 10 * y + x + 1)) for x in range(3) for y in range(2) for z in (0, 1, 4, 5) for t in range(4)]
    df = spark.createDataFrame(cells, "x long, y long, z long, t long, v double")
    for fastest in (False, True):
        folder = str(tmp_path / str(fastest))
        made = raw.write_volumes(df, folder, 3, 2, 2, 4, fastest).orderBy("slab").collect()
        assert [r.slab for r in made] == [0, 2] and all(r.n_bytes == 4 * 3 * 2 * 2 * 4 for r in made)
        got = raw.read_raw(spark, *[r.path for r in made], stacked="true", part_bytes=32)
        # the second file follows on the first one's planes
        assert {tuple(r) for r in got.collect()} == {(x, y, z if z < 2 else z - 2, t, v) for x, y, z, t, v in cells}
        assert {r.z for r in got.where("z >= 3 and t = 1").collect()} == {3} and got.where("z = 2 and t = 1").count() == 6 and got.where("z > 9").count() == 0
    with pytest.raises(Exception, match="twice"):
        raw.write_slices(df.unionByName(df.limit(1)), str(tmp_path / "twice"), 3, 2).collect()
    raw.write_slices(df.withColumn("v", F.lit(0.0)), str(tmp_path / "zeros"), 3, 2).collect()
    assert raw.read_slices(spark, str(tmp_path / "zeros"), 3, 2).count() == len(cells)


def test_assets_round_trip(spark, tmp_path):
    leaves = spark.createDataFrame([(7, 1, b"abcdefgh"), (7, 0, b"\x01\x00\x00\x00")], "asset long, leaf_id long, payload binary")
    told = {"width": 16, "height": 8, "depth": 8, "frames": 4, "coarse_resolution": 4, "max_coarse_keep": 1, "profile_type": 0, "ac_scales": [0.25]}
    path = packed.write_assets(leaves, str(tmp_path), b"12345678", told).first()["path"]
    assert [(r.leaf_id, bytes(r.payload)) for r in packed.read_leaves(spark, path).orderBy("leaf_id").collect()] == [(0, b"\x01\x00\x00\x00"), (1, b"abcdefgh")]
    with pytest.raises(Exception, match="without gaps"):
        packed.write_assets(leaves.where("leaf_id = 1"), str(tmp_path / "b"), b"12345678", told).collect()


def test_paths_name_their_file_system(spark):
    assert shared.resolved(spark, "/a/b") == "file:///a/b" and shared.resolved(spark, "viewfs://x/y") == "viewfs://x/y"
    with pytest.raises(ValueError, match="no file system"):
        shared.located("/a/b")


def test_meshes_tables_and_reports(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.obj").write_text("# cube\nv 0 0 0\nv 1 0 0\n\nv 1 1 0\nv 0 1 0\nvn 0 0 1\nf 1/1/1 2//1 3 4\nf -1 -2 -3\n")
    got = {(r.face, r.part): (r.ax, r.ay, r.bx, r.by, r.cx, r.cy) for r in texts.read_obj(spark, f"file://{tmp_path}/m").collect()}
    assert got == {(7, 1): (0, 0, 1, 0, 1, 1), (7, 2): (0, 0, 1, 1, 0, 1), (8, 1): (0, 1, 1, 1, 1, 0)}
    (tmp_path / "m" / "b.obj").write_text("v 0 0 0\nf 1 1 2\n")
    with pytest.raises(Exception, match="without a vertex"):
        texts.read_obj(spark, f"file://{tmp_path}/m").collect()
    (tmp_path / "t.csv").write_bytes("﻿dataset,rmse,other\nb,2.5,x\na,9,y\n".encode())
    table = texts.read_table(spark, f"file://{tmp_path}/t.csv", "dataset string, rmse double, other string")
    assert [tuple(r) for r in texts.top_rows(table, [F.desc("rmse")], 1).collect()] == [("a", 9.0, "y")]
    lines = spark.createDataFrame([(1, "RMSE: 0.5 (all)"), (1, "nothing"), (2, "none")], "report long, text string")
    assert {(r.report, r.rmse) for r in texts.report_fields(lines, {"rmse": r"RMSE: ([0-9.]+)"}).collect()} == {(1, 0.5), (2, None)}
