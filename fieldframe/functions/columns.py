"""Scalar formulas, as Spark columns or as text of plain SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trilinear(control: str, r: int, x: str, y: str, z: str) -> str:
    """A control grid of r**3 values in the array `control`, sampled at local coordinates 0..7."""
    at = {a: f"({c} / 7e0 * {r - 1})" for a, c in zip("xyz", (x, y, z), strict=True)}
    low = {a: f"least(cast(floor({e}) as int), {r - 2})" for a, e in at.items()}
    part = {a: f"({at[a]} - {low[a]})" for a in "xyz"}
    terms = []
    for dz in (0, 1):
        for dy in (0, 1):
            for dx in (0, 1):
                w = " * ".join(part[a] if d else f"(1 - {part[a]})" for a, d in zip("xyz", (dx, dy, dz), strict=True))
                index = f"(({low['z']} + {dz}) * {r} + {low['y']} + {dy}) * {r} + {low['x']} + {dx} + 1"
                terms.append(f"{w} * cast(element_at({control}, cast({index} as int)) as double)")
    return "(" + " + ".join(terms) + ")"


def dct_basis(n: str, i: str, k: str) -> str:
    """Orthonormal DCT-II basis."""
    return f"(case when {k} = 0 then sqrt(1e0 / {n}) else sqrt(2e0 / {n}) end * cos(pi() / {n} * ({i} + 5e-1) * {k}))"


def quantised(value: str, scale: str, top: int) -> str:
    """Nearest whole multiple of scale, half away from zero, clamped to -top..top; 0 without a scale."""
    return f"(case when {scale} <= 1e-12 then 0 else cast(greatest(-{top}, least({top}, sign({value}) * floor(abs({value}) / {scale} + 0.5))) as int) end)"


def tier(n: str) -> str:
    return f"(case when {n} <= 64 then 64 when {n} <= 256 then 256 when {n} <= 768 then 768 else 1024 end)"


def smoothstep(x: str, low: str, high: str) -> str:
    u = f"greatest(0.0, least(1.0, ({x} - {low}) / ({high} - {low})))"
    return f"({u} * {u} * (3.0 - 2.0 * {u}))"


def opacity(v: str, k: str, cutoff: str, span: str) -> str:
    return f"(1.0 - exp(-{k} * greatest(0.0, {v} - {cutoff}) / {span}))"


def timeline(n: str, frames: int, mode: str) -> str:
    """Frame shown after n advances from frame 0: loop, once or pingpong."""
    if mode == "loop":
        return f"({n} % {frames})"
    if mode == "once":
        return f"least({n}, {frames - 1})"
    period = max(1, 2 * (frames - 1))
    return f"({frames - 1} - abs({frames - 1} - {n} % {period}))"


def filmic(c: Column) -> Column:
    """A filmic tone curve."""
    return c * (2.51 * c + 0.03) / (c * (2.43 * c + 0.59) + 0.14)


def reinhard(c: Column) -> Column:
    return c / (1 + c)


def phase(cosine: Column, g: float) -> Column:
    """Henyey-Greenstein phase function."""
    return (1 - g * g) / (4 * F.pi() * F.pow(1 + g * g - 2 * g * cosine, F.lit(1.5)))


def fresnel(cosine: Column, r0: float) -> Column:
    """Schlick's approximation."""
    return r0 + (1 - r0) * F.pow(1 - cosine, F.lit(5.0))


def band_weight(v: Column, bands: list[tuple[float, float]], other: float) -> Column:
    """The weight of the first band whose upper end is at least v."""
    out = None
    for top, weight in bands:
        out = F.when(v <= top, weight) if out is None else out.when(v <= top, weight)
    return out.otherwise(other)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), v))
