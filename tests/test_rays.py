"""Oblique rays against a march one ray at a time."""

import math

import numpy as np
import pytest

from fieldframe.operators import rays


def plain(values, m, o, d, end, light=False):
    """hit, normal, facing, thickness of one ray by single steps; with light whether anything is in the way."""

    def phi(p):
        low, total = [math.floor(c) for c in p], 0.0
        for k in range(8):
            step = (k & 1, k >> 1 & 1, k >> 2)
            w = math.prod(c - i if s else 1 - (c - i) for c, i, s in zip(p, low, step, strict=True))
            total += w * values.get(tuple(i + s for i, s in zip(low, step, strict=True)), 0.0)
        return m.level - total

    at = lambda s: phi([a + s * b for a, b in zip(o, d, strict=True)])
    factor, least, most = m.shadow if light else (*m.hit, m.longest_step)
    t, before, hit = 0.0, at(0.0), None
    for _ in range(m.steps):
        now = min(t + min(max(abs(before) * factor, least), most), end)
        value = at(now)
        if (before < 0) != (value < 0):
            inside = value < 0
            support = at(min(now + 0.35, end) if inside else max(t - 0.35, 0.0))
            if (value if inside else before) <= -m.surface * 0.5 or support <= -m.surface * 0.25:
                low, high, low_phi = t, now, before
                for _ in range(5):
                    middle = (low + high) / 2
                    p = at(middle)
                    if (low_phi < 0) != (p < 0):
                        high = middle
                    else:
                        low, low_phi = middle, p
                hit = (low + high) / 2
                break
            value = max(value, m.surface)
        if now >= end:
            break
        t, before = now, value
    if light:
        return hit is not None
    if hit is None:
        return None
    point, h = [a + hit * b for a, b in zip(o, d, strict=True)], m.normal_step
    moved = lambda k, s: [c + (s if i == k else 0) for i, c in enumerate(point)]
    g = [phi(moved(k, h)) - phi(moved(k, -h)) for k in range(3)]
    size = math.sqrt(sum(x * x for x in g))
    normal = [x / size for x in g] if size > 1e-6 else [-x for x in d]
    t = min(hit + 0.35, end)
    before, thickness = at(t), 6.0
    entered = before < -0.25 * m.surface
    for _ in range(160):
        now = min(t + min(max(abs(before) * 0.7, 0.3), 3.0), end)
        value = at(now)
        entered = entered or value < -0.25 * m.surface
        if entered and before < 0 <= value:
            thickness = max(now - hit, 0.25)
            break
        if now >= end:
            break
        t, before = now, value
    return [hit, *normal, abs(sum(a * b for a, b in zip(normal, d, strict=True))), thickness]


@pytest.fixture(scope="module")
def scene(spark):
    draw = np.random.default_rng(12)
    cells = []
    for t in (0, 3):
        for x in range(20):
            for y in range(18):
                for z in range(12):
                    v = 10 - 1.5 * math.dist((x, y, z), (10, 9, 6)) + draw.normal(0, 0.4)
                    if v > 0:
                        cells.append((x, y, z, t, float(v)))
    cells += [(2, 2, 2, 0, 9.0)]
    cast = []
    for i in range(80):
        d = draw.normal(0, 1, 3)
        d /= np.linalg.norm(d)
        o = np.array([10, 9, 6]) - d * draw.uniform(2, 14) + draw.normal(0, 2, 3)
        cast.append((i, int(draw.choice([0, 3, 5])), *map(float, o), *map(float, d), float(draw.choice([0.0, 5.0, 30.0]))))
    columns = "ray long, t long, ox double, oy double, oz double, dx double, dy double, dz double, length double"
    return cells, cast, spark.createDataFrame(cells, "x long, y long, z long, t long, v double"), spark.createDataFrame(cast, columns)


def test_hits_normals_and_thickness(scene):
    cells, cast, field, given = scene
    m = rays.March(level=4.0, longest_step=2.0)
    by_frame = {t: {(x, y, z): v for x, y, z, f, v in cells if f == t} for t in (0, 3, 5)}
    got = {r.ray: r for r in rays.surface_hits(given, field, m).collect()}
    hits = 0
    for i, t, *od, end in cast:
        want = plain(by_frame[t], m, od[:3], od[3:], end) if end > 0 else None
        r = got[i]
        if want is None:
            assert r.hit is None and r.nx is None and r.thickness is None
        else:
            hits += 1
            assert [r.hit, r.nx, r.ny, r.nz, r.facing, r.thickness] == pytest.approx(want, abs=1e-9), i
    assert len(got) == len(cast) and hits > 20
    assert rays.surface_hits(given.limit(0), field, m).count() == 0 and rays.surface_hits(given, field.limit(0), m).where("hit is not null").count() == 0


def test_shadows(scene):
    cells, cast, field, given = scene
    m = rays.March(level=4.0)
    by_frame = {t: {(x, y, z): v for x, y, z, f, v in cells if f == t} for t in (0, 3, 5)}
    got = {r.ray: r.shadow for r in rays.shadowed(given, field, m).collect()}
    assert got == {i: end > 0 and plain(by_frame[t], m, od[:3], od[3:], end, True) for i, t, *od, end in cast} and 10 < sum(got.values()) < 70


def test_rays_of_a_tile_share_their_cells(scene, monkeypatch):
    import pandas as pd

    cells, cast, field, given = scene
    m = rays.March(level=4.0, longest_step=2.0)
    sent = lambda: rays._with_cells(given, field, 4.0, lambda some, f: pd.DataFrame({"rays": [len(some)], "cells": [len(f.address)]}), "rays long, cells long").collect()
    groups = sent()
    # 80 rays start in a few tiles; each tile's group has the scene's cells once
    assert sum(r.rays for r in groups) == len(cast) and sum(r.cells for r in groups) <= len(groups) * len(cells) and len(groups) < 25
    whole = {r.ray: r for r in rays.surface_hits(given, field, m).collect()}
    monkeypatch.setattr(rays, "_PLACES", 8)
    parts = sent()
    assert len(parts) > len(groups) and sum(r.rays for r in parts) == len(cast)
    assert {r.ray: r for r in rays.surface_hits(given, field, m).collect()} == whole
