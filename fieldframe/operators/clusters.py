"""Guarded clusters of the series of a leaf: gates on sketches before distances, medoids as centres, and a second assignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SAMPLES = 9


@dataclass(frozen=True)
class Guards:
    """What two series must share. Fixed values of the format, beside the tolerance of a profile."""

    eps_abs: float = 1.0
    eps_rel: float = 0.05
    threshold: float = 1.5
    cutoff: float = 0.0
    band: float = 0.0
    # fixed values
    envelope_gap: float = 4.5
    extrema_slack: int = 2
    correlation: float = 0.60
    slope_mismatch: float = 0.45
    flat_slope: float = 1e-6
    quality_p95: tuple[float, float] = (0.65, 0.80)
    quality_max: tuple[float, float] = (0.85, 1.00)
    most_clusters: int = 256


def _states(values: np.ndarray, g: Guards) -> np.ndarray:
    if g.cutoff <= 0:
        return np.ones(values.shape, dtype=np.int8)
    return np.where(values < g.cutoff - g.band, 0, np.where(values > g.cutoff + g.band, 2, 1)).astype(np.int8)


def pairs_that_fit(block: np.ndarray, keyed: np.ndarray, g: Guards, step: int = 64) -> np.ndarray:
    """fits[i, c]: whether series i may stand behind series c. block has a row a series and a column a frame, keyed marks the frames that a series has of its own.

    Rows are compared with all centres some at a time, so that memory is bounded by the leaf.
    """
    n, frames = block.shape
    at = (frames - 1) * np.arange(SAMPLES) // (SAMPLES - 1)
    s = block[:, at]
    low, high, first_low, first_high = s.min(axis=1), s.max(axis=1), s.argmin(axis=1), s.argmax(axis=1)
    scale = np.maximum(1e-5, np.maximum(s.std(axis=1), high - low))
    centred = s - s.mean(axis=1, keepdims=True)
    power = (centred * centred).sum(axis=1)
    slope = np.diff(s, axis=1)
    way = (slope > g.flat_slope).astype(np.int8) - (slope < -g.flat_slope).astype(np.int8)
    tolerance = g.eps_abs + g.eps_rel * np.maximum(np.abs(block - block.mean(axis=1, keepdims=True)), block.std(axis=1, keepdims=True))
    tolerance = np.maximum(tolerance, 1e-6)
    state = _states(block, g)
    ends = np.zeros(frames, dtype=bool)
    ends[[0, -1]] = True
    quality = min(max(a, b * g.threshold) for a, b in (g.quality_p95, g.quality_max))  # of nine errors the 95th percentile is the largest
    fits = np.zeros((n, n), dtype=bool)
    for i in range(0, n, step):
        r = slice(i, i + step)
        gap = np.maximum(np.abs(low[r, None] - low), np.abs(high[r, None] - high)) / scale[r, None]
        apart = (np.abs(first_low[r, None] - first_low) > g.extrema_slack) & (np.abs(first_high[r, None] - first_high) > g.extrema_slack)
        alike = centred[r] @ centred.T / np.sqrt(np.maximum(1e-12, power[r, None] * power))
        both = (way[r, None] != 0) & (way != 0)
        turns, against = both.sum(axis=2), (both & (way[r, None] != way)).sum(axis=2)
        ok = (gap <= g.envelope_gap) & ~apart & (alike >= g.correlation) & (against <= g.slope_mismatch * np.maximum(turns, 1))
        seen = keyed[r, None] | keyed | ends
        clash = (state[r, None] + state == 2) & (state[r, None] != state) & seen
        error = np.abs(block[r, None] - block) / tolerance[r, None]
        ok &= ~clash.any(axis=2) & (np.where(seen, error, 0.0).max(axis=2) <= g.threshold) & (error[:, :, at].max(axis=2) <= quality)
        fits[r] = ok
    return fits


def guarded_clusters(block: np.ndarray, keyed: np.ndarray, g: Guards) -> tuple[list[int], np.ndarray, int]:
    """(centres, the cluster of each series, changed medoids): first fit, centres moved to medoids by summed distance of samples, then the nearest centre that fits.

    A series that fits no centre, not even itself (a constant one has no correlation), becomes a centre of its own.
    """
    n, frames = block.shape
    s = block[:, (frames - 1) * np.arange(SAMPLES) // (SAMPLES - 1)]
    fits = pairs_that_fit(block, keyed, g)
    centres: list[int] = []
    first = np.empty(n, dtype=np.int64)
    for i in range(n):
        open_to = np.flatnonzero(fits[i, centres]) if centres else []
        first[i] = open_to[0] if len(open_to) else len(centres)
        if not len(open_to):
            centres.append(i)
    moved = 0
    for c in range(len(centres)):
        members = np.flatnonzero(first == c)
        cost = np.abs(s[members, None] - s[members]).sum(axis=(1, 2))
        best = int(members[np.argmin(cost)])
        moved += best != centres[c]
        centres[c] = best
    last = np.empty(n, dtype=np.int64)
    for i in range(n):
        open_to = np.flatnonzero(fits[i, centres])
        if len(open_to):
            last[i] = open_to[np.argmin(np.abs(s[i] - s[np.array(centres)[open_to]]).sum(axis=1))]
        else:
            last[i] = len(centres)
            centres.append(i)
    return centres, last, moved


def leaf_clusters_guarded(cells: DataFrame, frames: int, g: Guards) -> DataFrame:
    """(leaf_id, voxel, mode, clusters, cluster, centre, worst): guarded clusters of the series of each leaf.

    Rows are (leaf_id, voxel, t, v); between a voxel's own frames its series is a line,
    outside them constant. mode is uniform with one centre, dense from 256 on (each voxel
    keeps its series: no cluster, its own centre), else clustered; worst is the largest
    error of a frame against the centre, by the voxel's own tolerance. A leaf has 512 series at most, whatever the
    data, and is one task's work.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["voxel", "t"])
        voxels, begin = np.unique(pdf["voxel"].to_numpy(), return_index=True)
        block, keyed = np.empty((len(voxels), frames)), np.zeros((len(voxels), frames), dtype=bool)
        for k, (t, v) in enumerate(zip(np.split(pdf["t"].to_numpy(), begin[1:]), np.split(pdf["v"].to_numpy(), begin[1:]), strict=True)):
            block[k], keyed[k, t] = np.interp(np.arange(frames), t, v), True
        centres, cluster, _ = guarded_clusters(block, keyed, g)
        dense = len(centres) >= g.most_clusters
        centre = np.arange(len(voxels)) if dense else np.array(centres)[cluster]
        tolerance = np.maximum(g.eps_abs + g.eps_rel * np.maximum(np.abs(block - block.mean(axis=1, keepdims=True)), block.std(axis=1, keepdims=True)), 1e-6)
        return pd.DataFrame(
            {
                "leaf_id": pdf["leaf_id"].iloc[0],
                "voxel": voxels,
                "mode": "dense" if dense else "uniform" if len(centres) == 1 else "clustered",
                "clusters": len(centres),
                "cluster": pd.array([None] * len(voxels) if dense else cluster, dtype="Int64"),
                "centre": voxels[centre],
                "worst": (np.abs(block - block[centre]) / tolerance).max(axis=1),
            }
        )

    return cells.select("leaf_id", "voxel", "t", "v").groupBy("leaf_id").applyInPandas(run, "leaf_id long, voxel long, mode string, clusters long, cluster long, centre long, worst double")
