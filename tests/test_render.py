"""Payload bytes against struct, and what is sampled from them against loops."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldframe.operators import payload, render

HEADS = "leaf_id long, mode int, coarse_codec int, fine_codec int, coarse_resolution int, fine_resolution int"
KEYS = "leaf_id long, stream string, control int, t long, v double"


def up(n):
    return (n + 3) // 4 * 4


def stream_bytes(series, n_bins, single, frames):
    """Descriptors, bin hints and keys of a list of [(t, v)], each part padded to words."""
    told, hints, keys, start = b"", b"", b"", 0
    for one in series:
        told += struct.pack("<HBB", start, len(one), 0)
        hints += bytes(max(0, sum(t <= -(-b * frames // n_bins) for t, _ in one) - 1) for b in range(n_bins))
        for t, v in one:
            keys += struct.pack("<HHf", t, 0, v) if single else struct.pack("<Be", t, v)
        start += len(one)
    return told + hints.ljust(up(len(hints)), b"\0") + keys.ljust(up(len(keys)), b"\0"), start


def leaf_bytes(mode, coarse, fine, frames, resolutions=(2, 3)):
    head = mode | 1 << 2 | 0 << 4 | resolutions[0] << 6 | (resolutions[1] if mode > 1 else 0) << 9
    if mode == 0:
        return struct.pack("<I", head)
    body, n_coarse = stream_bytes([coarse.get(c, []) for c in range(8)], 8, True, frames)
    n_fine = 0
    if mode == 3:
        more, n_fine = stream_bytes([fine.get(c, []) for c in range(27)], 8, False, frames)
        body += more
    if mode == 2:
        mask = sum(1 << v for v in fine).to_bytes(64, "little")
        before = [sum(v < 64 * g for v in fine) for g in range(8)]
        more, n_fine = stream_bytes([fine[v] for v in sorted(fine)], 4, False, frames)
        body += mask + struct.pack("<8H", *before) + more
    return struct.pack("<IHH", head, n_coarse, n_fine) + body


@pytest.fixture(scope="module")
def asset(spark):
    draw = np.random.default_rng(8)
    series = lambda: [(int(t), float(draw.integers(-300, 300)) / 8) for t in np.flatnonzero(draw.random(16) < 0.3)]
    leaves = {}
    for leaf, mode in enumerate([0, 1, 2, 3, 2, 3]):
        coarse = {c: s for c in range(8) if (s := series())}
        fine = {int(c): s for c in draw.choice(512 if mode == 2 else 27, 20, replace=False) if (s := series())} if mode > 1 else {}
        leaves[leaf] = (mode, coarse, fine)
    heads = spark.createDataFrame([(k, m, payload.SINGLE, payload.HALF, 2, 3 if m > 1 else 0) for k, (m, _, _) in leaves.items()], HEADS)
    keys = [(k, "coarse" if i == 0 else "shell" if m == 2 else "fine", c, t, v) for k, (m, *both) in leaves.items() if m for i, some in enumerate(both) for c, s in some.items() for t, v in s]
    built = payload.built(heads, spark.createDataFrame(keys, KEYS), 16)
    return leaves, spark.createDataFrame(built.collect(), built.schema), keys


def test_bytes_and_keys(spark, asset):
    leaves, built, keys = asset
    for r in built.collect():
        assert bytes(r.payload) == leaf_bytes(*leaves[r.leaf_id], 16), r.leaf_id
    laid = payload.laid_out(built)
    assert laid.where("error is not null or not prefix_fits").count() == 0
    assert {r.leaf_id: r.active for r in laid.where("mode = 2").collect()} == {k: len(f) for k, (m, _, f) in leaves.items() if m == 2}
    assert all(r.total == r.n_bytes for r in laid.where("mode in (0, 1, 3)").collect()) and all(r.shell_end == r.n_bytes for r in laid.where("mode = 2").collect())
    read = payload.series_of(laid).select("leaf_id", "stream", "control", F.explode("keys").alias("k")).collect()
    assert sorted((r.leaf_id, r.stream, r.control, r.k.t, r.k.v) for r in read) == sorted(keys)


def test_harmed_bytes_are_named(spark):
    whole = leaf_bytes(2, {0: [(0, 1.0)]}, {3: [(1, 2.0)], 70: [(2, 3.0)]}, 16)
    fine_at = len(leaf_bytes(1, {0: [(0, 1.0)]}, {}, 16))
    zeroed = whole[:fine_at] + bytes(80) + whole[fine_at + 80 :]
    prefix = whole[: fine_at + 66] + b"\0\0" + whole[fine_at + 68 :]
    beyond = whole[:8] + struct.pack("<HBB", 1, 1, 0) + whole[12:]
    cases = [(whole, None), (prefix, payload.ERRORS[3]), (whole[:-4], payload.ERRORS[5]), (whole + bytes(4), payload.ERRORS[6]), (zeroed, payload.ERRORS[4]), (b"", payload.ERRORS[0]), (None, None), (whole[:6], payload.ERRORS[1]), (whole[:20], payload.ERRORS[2])]
    frame = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, (b, _) in enumerate(cases)], "leaf_id long, payload binary")
    assert {r.leaf_id: r.error for r in payload.laid_out(frame).collect()} == {i: e for i, (_, e) in enumerate(cases)}
    broken = payload.series_of(payload.laid_out(spark.createDataFrame([(0, bytearray(beyond))], "leaf_id long, payload binary")))
    assert [(r.stream, r.control) for r in broken.where("broken").collect()] == [("coarse", 0)]
    with pytest.raises(Exception, match=payload.ERRORS[6]):
        render.sampled(spark.createDataFrame([(0.0, 0.0, 0.0, 0)], "x double, y double, z double, t long"), frame.where("leaf_id = 3").withColumn("leaf_id", F.lit(0).cast("long")), render.Frame((0.0, 0.0, 0.0), 1.0, (8, 8, 8))).count()


def plain_value(leaves, p, t, size, background, interior):
    if any(c < 0 or c > n - 1 for c, n in zip(p, size, strict=True)):
        return background, background
    block = [int(c // 8) for c in p]
    leaf = block[0] + block[1] * -(-size[0] // 8)
    mode, coarse, fine = leaves.get(leaf, (0, {}, {}))
    if mode == 0:
        return background, background
    local = [c - 8 * b for c, b in zip(p, block, strict=True)]

    def series(keys):
        return float(np.interp(t, *zip(*keys, strict=True))) if keys else 0.0

    def grid(some, r):
        total = 0.0
        at = [min(c, min(8, n - 8 * b) - 1) * (r - 1) / 7 for c, b, n in zip(local, block, size, strict=True)]
        low = [max(0, min(r - 2, int(np.ceil(a)) - 1)) for a in at]
        for k in range(8):
            step = (k & 1, k >> 1 & 1, k >> 2)
            w = np.prod([a - i if s else 1 - (a - i) for a, i, s in zip(at, low, step, strict=True)])
            x, y, z = (i + s for i, s in zip(low, step, strict=True))
            total += w * series(some.get((z * r + y) * r + x))
        return total

    plain = grid(coarse, 2) + (grid(fine, 3) if mode == 3 else 0.0)
    value = plain
    if mode == 2:
        x, y, z = (min(7, int(np.floor(c + 0.5))) for c in local)
        held = fine.get((z * 8 + y) * 8 + x)
        value = plain + series(held) if held is not None else background if value < 0 and not interior else value
    return plain, value


@pytest.mark.parametrize("interior", [False, True])
def test_sampled_points(spark, asset, interior):
    leaves, built, _ = asset
    size, draw = (21, 16, 8), np.random.default_rng(3)
    inner = np.vstack([draw.uniform(-1, [22, 17, 8.5], (150, 3)), draw.integers(0, [21, 16, 8], (50, 3)), [[20, 15, 7], [0, 0, 0], [20.5, 0, 0]]])
    frame = render.Frame((10.0, -4.0, 2.0), 0.25, size, background=-9.0)
    rows = [(i, *(o + 0.25 * c for o, c in zip(frame.origin, p, strict=True)), int(t)) for i, (p, t) in enumerate(zip(inner.tolist(), draw.integers(0, 16, len(inner)), strict=True))]
    points = spark.createDataFrame(rows, "qid int, x double, y double, z double, t long")
    for r in render.sampled(points, built, frame, interior).collect():
        p = [(c - o) / 0.25 for c, o in zip((r.x, r.y, r.z), frame.origin, strict=True)]
        assert (r.plain, r.value) == pytest.approx(plain_value(leaves, p, r.t, size, -9.0, interior)), r
    assert render.sampled(points.limit(0), built, frame).count() == 0 and {r.value for r in render.sampled(points, built.limit(0), frame).collect()} == {-9.0}


def test_whole_leaves(spark, asset):
    leaves, built, _ = asset
    frames = spark.createDataFrame([(k, 5) for k in leaves], "leaf_id long, t long")
    got = render.decoded_leaves(built, frames, (21, 16, 8)).collect()
    assert len(got) == 21 * 16 * 8
    for r in got[::7]:
        assert r.value == pytest.approx(plain_value(leaves, (r.x, r.y, r.z), 5, (21, 16, 8), 0.0, False)[1])
