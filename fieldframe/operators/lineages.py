"""Keyframes of whole series by three tolerance rules, with their shortcuts, frame weights, a depth bound and protected frames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: how deep segments are split, and the least tolerances
DEEPEST, LEAST_SCALE, LEAST_EPS, FLOOR_SHARE, WEIGHTED_SHARE = 300, 1e-4, 1e-4, 0.1, 0.25


@dataclass(frozen=True)
class Bands:
    """Tolerances by the distance of truth and line, whichever is nearer, from a surface's level."""

    iso: float
    critical: float
    near: float
    band: float
    eps_critical: float
    eps_near: float
    eps_far: float
    floor: float = 1e-4


@dataclass(frozen=True)
class Relative:
    """eps_abs + eps_rel times the value's size, tightened by gamma where the series changes.

    centred: the size is the distance from the mean (the deviation at least) and changes count in
    units of their 90th percentile. With a cutoff, frames whose state is between or changes are kept with their neighbours.
    """

    eps_abs: float
    eps_rel: float
    gamma: float
    centred: bool
    cutoff: float = 0.0
    band: float = 0.0

    @property
    def floor(self) -> float:
        return max(LEAST_EPS, FLOOR_SHARE * self.eps_abs)


def _tolerance(rule: Bands | Relative, v: np.ndarray, line: np.ndarray, at: slice, weight: np.ndarray) -> np.ndarray:
    x = v[at]
    if isinstance(rule, Bands):
        near = np.minimum(np.abs(x - rule.iso), np.abs(line - rule.iso))
        eps = np.select([near <= rule.critical, near <= rule.near, near <= rule.band], [rule.eps_critical, rule.eps_near, 0.5 * (rule.eps_near + rule.eps_far)], rule.eps_far)
    else:
        steps = np.abs(np.diff(v))
        size = np.maximum(np.abs(x - v.mean()), v.std()) if rule.centred else np.abs(x)
        unit = max(LEAST_SCALE, float(np.sort(steps)[min(len(steps) - 1, len(steps) * 9 // 10)])) if rule.centred else 1.0
        eps = (rule.eps_abs + rule.eps_rel * size) / (1 + rule.gamma * steps[at.start - 1 : at.stop - 1] / unit)
        eps = eps if rule.centred else np.maximum(eps, LEAST_EPS)
    return np.maximum(np.maximum(eps, rule.floor) / np.maximum(1.0, weight[at]), rule.floor * WEIGHTED_SHARE)


def key_frames(v: np.ndarray, rule: Bands | Relative, weight: np.ndarray, deepest: int = DEEPEST) -> list[int]:
    """Places kept of a series: the first one if it varies less than the floor; the ends if one line is within tolerance everywhere; else splits at the first of the worst places, and protected frames."""
    n = len(v)
    if n < 2 or v.var() < rule.floor**2:
        return [0] if n else []
    keys, stack = {0, n - 1}, [(0, n - 1, 0)]
    while stack:
        a, b, depth = stack.pop()
        if b - a <= 1 or depth >= deepest:
            continue
        inner = slice(a + 1, b)
        line = v[a] + (np.arange(a + 1, b) - a) / (b - a) * (v[b] - v[a])
        error = np.abs(v[inner] - line) / _tolerance(rule, v, line, inner, weight)
        worst = int(np.argmax(error))
        if error[worst] > 1:
            keys.add(a + 1 + worst)
            stack += [(a, a + 1 + worst, depth + 1), (a + 1 + worst, b, depth + 1)]
    if len(keys) > 2 and isinstance(rule, Relative) and rule.cutoff > 0:
        state = np.where(v < rule.cutoff - rule.band, 0, np.where(v > rule.cutoff + rule.band, 2, 1))
        for t in range(n):
            changed = t > 0 and state[t] != state[t - 1]
            if state[t] == 1 or changed:
                keys |= {s for s in (t - 1, t, t + 1) if 0 <= s < n}
    return sorted(keys)


def lineages(series: DataFrame, key: str, value: str, weight: str, rules: dict[str, Bands | Relative]) -> DataFrame:
    """(key, lineage, place, t, v): the keyframes of each series by each rule; its frames are its rows (key, t, value) in the order of t.

    A series is one row of its key's frames.
    """
    rows = series.select(key, "t", F.col(value).cast("double").alias("v"), F.expr(weight).cast("double").alias("w"))
    arrays = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "v", "w"))).alias("s")).select(key, "s.t", "s.v", "s.w")

    def run(batches):
        for pdf in batches:
            for name, t, v, w in zip(pdf[key], pdf["t"], pdf["v"], pdf["w"], strict=True):
                for lineage, rule in rules.items():
                    kept = key_frames(v, rule, w)
                    yield pd.DataFrame({key: name, "lineage": lineage, "place": kept, "t": t[kept], "v": v[kept]})

    return arrays.mapInPandas(run, f"{key} {series.schema[key].dataType.simpleString()}, lineage string, place int, t long, v double")
