"""Rays through a volume at any angle: surface hits with normals and thickness, and shadows, by adaptive steps through sampled values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 8
_AXIS = 1 << 20  # cells an axis, at most
#: Side of the tiles whose rays share their cells, and how many places along rays (one every four cells) a group of them has, about.
_TILE, _PLACES = 64, 4096


@dataclass(frozen=True)
class March:
    """How rays step. What is brighter than level is inside: phi = level - value is negative there."""

    level: float
    steps: int = 160
    longest_step: float = 4.0
    normal_step: float = 0.5
    surface: float = 0.05
    # fixed values: shares of phi and bounds of a step, for hits, thickness and shadows; where support is looked for; how deep a surface must be
    hit: tuple[float, float] = (0.8, 0.2)
    inner: tuple[float, float, float] = (0.7, 0.3, 3.0)
    shadow: tuple[float, float, float] = (0.8, 0.35, 5.0)
    support: float = 0.35
    deep: tuple[float, float, float] = (0.5, 0.25, 0.25)
    halvings: int = 5
    unknown_thickness: float = 6.0
    least_thickness: float = 0.25


class _Field:
    """The cells that a group of rays can meet: trilinear values at any of their points, absent cells 0."""

    def __init__(self, address: np.ndarray, value: np.ndarray, level: float):
        self.address, first = np.unique(address, return_index=True)
        self.value = value[first]
        self.level = level

    def _at(self, cell: np.ndarray) -> np.ndarray:
        inside = ((cell >= 0) & (cell < _AXIS)).all(axis=1)
        address = (cell[:, 2] * _AXIS + cell[:, 1]) * _AXIS + cell[:, 0]
        rank = np.searchsorted(self.address, address)
        known = inside & (rank < len(self.address))
        known[known] = self.address[rank[known]] == address[known]
        out = np.zeros(len(cell))
        out[known] = self.value[rank[known]]
        return out

    def phi(self, points: np.ndarray) -> np.ndarray:
        low = np.floor(points)
        part, low = points - low, low.astype(np.int64)
        total = np.zeros(len(points))
        for k in range(8):
            step = np.array([k & 1, k >> 1 & 1, k >> 2])
            total += np.where(step, part, 1 - part).prod(axis=1) * self._at(low + step)
        return self.level - total


def _crossings(field: _Field, m: March, origin, way, length, rule) -> tuple[np.ndarray, ...]:
    """For each ray the last step before its first supported change of sign: (found, from, to, phi at from)."""
    factor, least, most = rule
    n = len(origin)
    t, end, start, stop = np.zeros(n), length, np.full(n, np.nan), np.full(n, np.nan)
    before, first = field.phi(origin), np.zeros(n)
    live = np.flatnonzero(end > 0)
    for _ in range(m.steps):
        if not len(live):
            break
        o, w = origin[live], way[live]
        now = np.minimum(t[live] + np.clip(np.abs(before[live]) * factor, least, max(most, least)), end[live])
        phi = field.phi(o + w * now[:, None])
        crossed = (before[live] < 0) != (phi < 0)
        inside = phi < 0
        beyond = np.where(inside, np.minimum(now + m.support, end[live]), np.maximum(t[live] - m.support, 0.0))
        held = field.phi(o + w * beyond[:, None])
        sound = crossed & ((np.where(inside, phi, before[live]) <= -m.surface * m.deep[0]) | (held <= -m.surface * m.deep[1]))
        hit = live[sound]
        start[hit], stop[hit], first[hit] = t[hit], now[sound], before[hit]
        open_ = ~sound & (now < end[live])
        go = live[open_]
        t[go], before[go] = now[open_], np.where(crossed[open_], np.maximum(phi[open_], m.surface), phi[open_])
        live = go
    return ~np.isnan(start), start, stop, first


def march(field: _Field, m: March, origin: np.ndarray, way: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
    """hit (nan without one), the normal there, facing (how much it looks at the ray's origin) and thickness of each ray."""
    n = len(origin)
    found, low, high, before = _crossings(field, m, origin, way, length, (*m.hit, m.longest_step))
    at = np.flatnonzero(found)
    o, w, lo, hi, lo_phi = origin[at], way[at], low[at], high[at], before[at]
    for _ in range(m.halvings):
        middle = 0.5 * (lo + hi)
        phi = field.phi(o + w * middle[:, None])
        crossed = (lo_phi < 0) != (phi < 0)
        hi, lo, lo_phi = np.where(crossed, middle, hi), np.where(crossed, lo, middle), np.where(crossed, lo_phi, phi)
    hit = 0.5 * (lo + hi)
    point, h = o + w * hit[:, None], max(m.normal_step, 0.25)
    gradient = np.stack([field.phi(point + h * e) - field.phi(point - h * e) for e in np.eye(3)], axis=1)
    size = np.linalg.norm(gradient, axis=1)
    normal = np.where(size[:, None] > 1e-6, gradient / np.maximum(size, 1e-300)[:, None], -w)
    out = {c: np.full(n, np.nan) for c in ("hit", "nx", "ny", "nz", "facing", "thickness")}
    out["hit"][at], out["facing"][at], out["thickness"][at] = hit, np.abs((normal * w).sum(axis=1)), _thickness(field, m, o, w, hit, length[at])
    for k, c in enumerate(("nx", "ny", "nz")):
        out[c][at] = normal[:, k]
    return out


def _thickness(field: _Field, m: March, o, w, hit, end) -> np.ndarray:
    """From the hit to where the ray leaves the inside again; a fixed value if it doesn't."""
    out = np.full(len(o), m.unknown_thickness)
    t = np.minimum(hit + m.support, end)
    before = field.phi(o + w * t[:, None])
    entered, live = before < -m.deep[2] * m.surface, np.arange(len(o))
    for _ in range(min(m.steps, 160)):
        if not len(live):
            break
        now = np.minimum(t[live] + np.clip(np.abs(before[live]) * m.inner[0], *m.inner[1:]), end[live])
        phi = field.phi(o[live] + w[live] * now[:, None])
        entered[live] |= phi < -m.deep[2] * m.surface
        left = entered[live] & (before[live] < 0) & (phi >= 0)
        out[live[left]] = np.maximum(now[left] - hit[live[left]], m.least_thickness)
        open_ = ~left & (now < end[live])
        go = live[open_]
        t[go], before[go] = now[open_], phi[open_]
        live = go
    return out


_GROUP = ["t", "tx", "ty", "tz", "part"]
_RAY = ["ray", "ox", "oy", "oz", "dx", "dy", "dz", "length"]


def _grouped(rays: DataFrame) -> DataFrame:
    """rays with the group they are marched in: their frame, the tile of their origins, and a part of its rays if there are many."""
    tiles = rays.withColumns({f"t{a}": F.floor(F.col(f"o{a}") / float(_TILE)).cast("long") for a in "xyz"})
    places = F.sum(F.ceil(F.col("length") / (LEAF / 2)) + 1)
    many = tiles.groupBy("t", "tx", "ty", "tz").agg(F.greatest(F.lit(1), F.ceil(places / _PLACES)).cast("long").alias("parts")).where("parts > 1")
    out = tiles.join(many, ["t", "tx", "ty", "tz"], "left")
    return out.select(*_RAY, "t", "tx", "ty", "tz", F.expr("if(parts is null, 0L, pmod(xxhash64(ray), parts))").alias("part"))


def _with_cells(rays: DataFrame, cells: DataFrame, level: float, run, schema: str) -> DataFrame:
    """run(rays, field) over groups of rays that start in one tile, with the blocks of cells (x, y, z, t, v) that they pass or that lie beside: the reach of samples and normals is within a block.

    A block goes once to each group that meets it, not to each ray, so what is shuffled follows the cells; what comes together
    in a task is bounded by a tile, the length of its rays and their number in a group, not by the volume.
    """
    block = lambda c: F.floor(c / float(LEAF)).cast("long")
    address = ((F.col("z") * _AXIS + F.col("y")) * _AXIS + F.col("x")).cast("long")
    held = cells.groupBy("t", *[block(F.col(a)).alias(f"b{a}") for a in "xyz"]).agg(F.collect_list(F.struct(address.alias("a"), F.col("v").cast("double").alias("v"))).alias("cells"))
    held = held.select("t", "bx", "by", "bz", F.col("cells.a").alias("cell_address"), F.col("cells.v").alias("cell_value"))
    grouped = _grouped(rays)
    spots = grouped.withColumn("s", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / (LEAF / 2)).cast("int"))))
    spots = spots.select(*_GROUP, *[block(F.col(f"o{a}") + F.col("s") * (LEAF / 2) * F.col(f"d{a}")).alias(f"b{a}") for a in "xyz"]).distinct()
    near = F.sequence(F.lit(-1), F.lit(1))
    for a in "xyz":
        spots = spots.withColumn("near", F.explode(near)).withColumn(f"b{a}", F.col(f"b{a}") + F.col("near")).drop("near").distinct()
    # places times 27 blocks are far more than Spark takes them for: not to be broadcast
    met = spots.hint("merge").join(held, ["t", "bx", "by", "bz"]).select(*[F.col(c).alias(f"of_{c}") for c in _GROUP], "cell_address", "cell_value")

    def group(some: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        address, value = np.concatenate([np.zeros(0, dtype=np.int64), *blocks["cell_address"]]), np.concatenate([np.zeros(0), *blocks["cell_value"]])
        return run(some, _Field(address, value, level))

    return grouped.groupBy(*_GROUP).cogroup(met.groupBy(*[f"of_{c}" for c in _GROUP])).applyInPandas(group, schema)


def _paths(pdf: pd.DataFrame):
    """(origin, way, length) of rays."""
    return pdf[["ox", "oy", "oz"]].to_numpy(float), pdf[["dx", "dy", "dz"]].to_numpy(float), pdf["length"].to_numpy(float)


def surface_hits(rays: DataFrame, cells: DataFrame, m: March) -> DataFrame:
    """(ray, hit, nx, ny, nz, facing, thickness) of rays (ray long, t, origin o*, unit direction d*, length): where each first enters or leaves what is inside; nulls without a hit.

    Steps follow the sampled value, a change of sign counts only with inside behind it, and is
    halved; normals are central differences. Values between cells are trilinear, absent cells 0.
    """

    def run(some: pd.DataFrame, field: _Field) -> pd.DataFrame:
        return pd.DataFrame({"ray": some["ray"].to_numpy()} | march(field, m, *_paths(some)))

    out = _with_cells(rays, cells, m.level, run, "ray long, hit double, nx double, ny double, nz double, facing double, thickness double")
    return out.select("ray", *[F.nanvl(c, F.lit(None)).alias(c) for c in out.columns[1:]])


def shadowed(rays: DataFrame, cells: DataFrame, m: March) -> DataFrame:
    """(ray, shadow) of rays towards a light: whether a supported surface lies on the way."""

    def run(some: pd.DataFrame, field: _Field) -> pd.DataFrame:
        found, *_ = _crossings(field, m, *_paths(some), m.shadow)
        return pd.DataFrame({"ray": some["ray"].to_numpy(), "shadow": found})

    return _with_cells(rays, cells, m.level, run, "ray long, shadow boolean")
