"""Patches, temporal bases and keyframe lineages against plain code."""

import math

import numpy as np
import pytest

from fieldframe.operators import codec, fits, lineages


def test_patches_by_dense_least_squares(spark):
    draw = np.random.default_rng(6)
    block = draw.normal(0, 5, 512)
    rows = [(3, 1, v, float(block[v])) for v in range(512) if v % 5]
    cells = spark.createDataFrame(rows, "leaf_id long, t long, voxel long, v double")
    at = np.arange(4) / 3
    basis = np.stack([np.kron(np.kron(a, b), c) for a in (1 - at, at) for b in (1 - at, at) for c in (1 - at, at)], axis=1)
    held = np.zeros(512)
    held[[r[2] for r in rows]] = [r[3] for r in rows]
    cube = held.reshape(8, 8, 8)
    want, left = {}, np.zeros((8, 8, 8))
    for p in range(8):
        z, y, x = p >> 2 & 1, p >> 1 & 1, p & 1
        part = (slice(4 * z, 4 * z + 4), slice(4 * y, 4 * y + 4), slice(4 * x, 4 * x + 4))
        want[p], *_ = np.linalg.lstsq(basis, cube[part].ravel(), rcond=None)
        left[part] = cube[part] - (basis @ want[p]).reshape(4, 4, 4)
    for r in fits.patch_fit(cells).collect():
        assert r.controls == pytest.approx(want[r.patch])
    for r in fits.patch_residuals(cells).collect():
        assert r.passed_on == pytest.approx(left.ravel()[r.voxel], abs=1e-9)


def test_temporal_bases_by_loops(spark):
    draw = np.random.default_rng(2)
    rows = [(leaf, v, t, float(draw.normal(0, 3))) for leaf in (0, 5) for v in range(9) for t in range(8) if draw.random() < 0.8]
    got = codec.temporal_bases(spark.createDataFrame(rows, "leaf_id long, voxel long, t long, r double"), 8, 3, 4).collect()
    basis = [[math.sqrt((1 if k == 0 else 2) / 8) * math.cos(math.pi / 8 * (t + 0.5) * k) for t in range(8)] for k in range(3)]
    c = {}
    for leaf, v, t, r in rows:
        for k in range(3):
            c[leaf, v, k] = c.get((leaf, v, k), 0.0) + r * basis[k][t]
    scale = {(leaf, k): max(abs(x) for (a, _, b), x in c.items() if (a, b) == (leaf, k)) for leaf in (0, 5) for k in range(3)}
    value = lambda leaf, v, k: (math.floor(0.5 * (c[leaf, v, k] / scale[leaf, k] + 1) * 15 + 0.5) / 15 * 2 - 1) * scale[leaf, k]
    assert len(got) == len(rows)
    for r in got:
        assert r.decoded == pytest.approx([sum(value(r.leaf_id, r.voxel, k) * basis[k][r.t] for k in range(n)) for n in (1, 2, 3)])


def plain_keys(v, rule, weight, deepest):
    """By recursion over single frames."""
    n = len(v)
    mean = sum(v) / n
    deviation = math.sqrt(sum((x - mean) ** 2 for x in v) / n)
    if n < 2 or deviation**2 < rule.floor**2:
        return [0]
    steps = sorted(abs(b - a) for a, b in zip(v, v[1:]))
    unit = max(1e-4, steps[min(len(steps) - 1, len(steps) * 9 // 10)])

    def eps(t, line):
        if isinstance(rule, lineages.Bands):
            near = min(abs(v[t] - rule.iso), abs(line - rule.iso))
            e = rule.eps_critical if near <= rule.critical else rule.eps_near if near <= rule.near else 0.5 * (rule.eps_near + rule.eps_far) if near <= rule.band else rule.eps_far
        else:
            size = max(abs(v[t] - mean), deviation) if rule.centred else abs(v[t])
            e = (rule.eps_abs + rule.eps_rel * size) / (1 + rule.gamma * abs(v[t] - v[t - 1]) / (unit if rule.centred else 1))
        return max(max(e, rule.floor) / max(1.0, weight[t]), rule.floor * 0.25)

    def split(a, b, depth):
        if b - a <= 1 or depth >= deepest:
            return set()
        lines = {t: v[a] + (t - a) / (b - a) * (v[b] - v[a]) for t in range(a + 1, b)}
        errors = {t: abs(v[t] - line) / eps(t, line) for t, line in lines.items()}
        worst = max(errors, key=lambda t: (errors[t], -t))
        return {worst} | split(a, worst, depth + 1) | split(worst, b, depth + 1) if errors[worst] > 1 else set()

    inner = split(0, n - 1, 0)
    keys = {0, n - 1} | inner
    if inner and isinstance(rule, lineages.Relative) and rule.cutoff > 0:
        state = [0 if x < rule.cutoff - rule.band else 2 if x > rule.cutoff + rule.band else 1 for x in v]
        for t in range(n):
            if state[t] == 1 or (t and state[t] != state[t - 1]):
                keys |= {s for s in (t - 1, t, t + 1) if 0 <= s < n}
    return sorted(keys)


RULES = [
    lineages.Bands(10, 1, 3, 8, 0.5, 1.5, 4),
    lineages.Relative(1.0, 0.05, 0.2, False, cutoff=12, band=1),
    lineages.Relative(0.5, 0.3, 0.2, True),
]


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("deepest", [300, 2])
def test_lineages_by_recursion(rule, deepest):
    draw = np.random.default_rng(11)
    for n in (1, 2, 3, 9, 40):
        for scale in (0.01, 1.0, 9.0):
            v = 10 + np.cumsum(draw.normal(0, scale, n))
            w = draw.uniform(0.5, 3, n)
            assert lineages.key_frames(v, rule, w, deepest) == plain_keys(v.tolist(), rule, w.tolist(), deepest)
    line = np.linspace(0, 30, 12)
    assert lineages.key_frames(line, rule, np.ones(12)) == [0, 11] and lineages.key_frames(np.full(5, 3.0), rule, np.ones(5)) == [0]
    assert lineages.key_frames(np.zeros(0), rule, np.zeros(0)) == []


def test_regions_cover_all_events(spark):
    draw = np.random.default_rng(4)
    spots = {1: [(3, 2)], 2: [(int(v), int(t)) for v, t in zip(draw.integers(0, 512, 90), draw.integers(4, 9, 90), strict=True)], 3: [(x + 8 * y + 64 * z, t) for x in (2, 3) for y in (4, 5, 6) for z in (0, 1) for t in range(16)], 4: [(v, t) for v in (0, 511) for t in range(16)] * 9}
    spots[5] = [(int(v), int(t)) for v, t in zip(draw.integers(0, 512, 60), draw.integers(0, 16, 60), strict=True)]
    rows = [(leaf, v, t) for leaf, some in spots.items() for v, t in some]
    got = {r.leaf_id: r for r in codec.crossovers(spark.createDataFrame(rows, "leaf_id long, voxel long, t long"), 3).collect()}
    for leaf, some in spots.items():
        r = got[leaf]
        x, y, z, t = ([f(v, t) for v, t in some] for f in (lambda v, t: v % 8, lambda v, t: v // 8 % 8, lambda v, t: v // 64, lambda v, t: t))
        assert [(r[f"{a}0"], r[f"{a}1"]) for a in "xyzt"] == [(min(c), max(c)) for c in (x, y, z, t)] and r.n == len(some)
        patches = {(c // 4 * 2 + b // 4) * 2 + a // 4 for a, b, c in zip(x, y, z, strict=True)}
        tiles = {(c // 2 * 4 + b // 2) * 4 + a // 2 for a, b, c in zip(x, y, z, strict=True)}
        assert r.patch_mask == sum(1 << p for p in patches) and r.tiles_low + (r.tiles_high << 32) == sum(1 << p for p in tiles)
        dense = lambda values: 8 + (max(t) - min(t) + 1) * (2 + (values * 3 + 7) // 8)  # noqa: B023, E731
        box = (max(x) - min(x) + 1) * (max(y) - min(y) + 1) * (max(z) - min(z) + 1)
        sizes = {"sparse": r.sparse_bytes, "box": dense(box), "patch": dense(64 * len(patches)), "tile": dense(8 * len(tiles))}
        assert (r.box_bytes, r.patch_bytes, r.tile_bytes) == (sizes["box"], sizes["patch"], sizes["tile"])
        assert r.layout == min(sizes, key=sizes.get) and r.bytes == min(sizes.values())
    assert {r.layout for r in got.values()} == {"box", "sparse", "tile"}


def test_temporal_bases_shuffle_cells_once(spark):
    from fieldframe.plans import catalog

    plan = catalog.queries()["temporal_basis_residuals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # the rows by leaf; the sums by leaf and keep lie there already
    assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1
