"""Render routes from sampled cells: metrics on a lattice, limits by kind of source, surface voxels, and streams that overflow."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codec import RouteLimits

# The default limits of the render route, and the limit of what a kind of source is never routed to.
DEFAULTS = RouteLimits(rmse=0.008, peak=0.03, visible=0.005, band=0.005, fine_gain=0.05, shell_share=0.002, shell_rmse=0.008, shell_peak=0.03, shell_gain=0.02)
CLOSED = 1.0
#: The share of the volume's largest value from which on a cell belongs to the shell.
SHELL_SHARE = 0.35
#: Keyframes that a leaf's stream can count.
MOST_KEYS = 65_535


def limits_for(kind: str, base: RouteLimits = DEFAULTS) -> RouteLimits:
    """The limits of a kind of source: liquid (no fine grids) or density (no shells)."""
    if kind == "liquid":
        return replace(base, visible=CLOSED, band=CLOSED, fine_gain=CLOSED)
    if kind == "density":
        return replace(base, shell_share=CLOSED, shell_rmse=CLOSED, shell_peak=CLOSED, shell_gain=CLOSED)
    raise ValueError(f"no limits for {kind}")


def level_set_bands(voxel: float, shell_voxels: float = 0.0) -> dict[str, float]:
    """Distances around a level set: surface (what is seen), guard (for the coarse values) and temporal (a key's tolerance); 1.5 voxels wide if the source names no width."""
    surface = (shell_voxels if shell_voxels > 0 else 1.5) * voxel
    return {"surface": surface, "guard": max(voxel, surface) / 2, "temporal": voxel / 10}


def route_metrics(cells: DataFrame, step: int, peak: float, cutoff: float, band: float, top: Column, background: float) -> DataFrame:
    """Per leaf of cells (leaf_id, x, y, z, t, v, coarse, fine, shell) what its route needs, of the cells on a lattice of step in space and time.

    coarse, fine and shell are three predictions of v; top is the volume's largest value.
    is_empty looks at all cells: none reaches the background. Shares are of the sampled
    cells and errors relative to peak; a leaf without sampled cells has zeros.
    """
    sampled = F.lit(True)
    for axis in "xyzt":
        sampled = sampled & (F.col(axis) % step == 0)
    rows = cells.select("leaf_id", "v", sampled.alias("sampled"), (sampled & (F.col("v") >= SHELL_SHARE * top)).alias("in_shell"), *[(F.col("v") - F.col(c)).alias(c) for c in ("coarse", "fine", "shell")])
    n = F.greatest(F.lit(1), F.count_if("sampled"))
    share = lambda c: F.count_if(F.col("sampled") & c) / n
    rmse = lambda c, where: F.coalesce(F.sqrt(F.avg(F.when(F.col(where), F.col(c) * F.col(c)))), F.lit(0.0)) / peak
    largest = lambda c, where: F.coalesce(F.max(F.when(F.col(where), F.abs(c))), F.lit(0.0)) / peak
    low = cutoff - band
    return rows.groupBy("leaf_id").agg(
        (F.max("v") < background).alias("is_empty"),
        F.count_if("sampled").alias("samples"),
        share(F.col("v") >= low).alias("visible_share"),
        share(F.col("v").between(low, cutoff + band)).alias("band_share"),
        share(F.col("in_shell")).alias("shell_share"),
        *[f(c, where).alias(name) for name, f, c, where in (
            ("coarse_rmse", rmse, "coarse", "sampled"), ("fine_rmse", rmse, "fine", "sampled"), ("coarse_peak", largest, "coarse", "sampled"), ("fine_peak", largest, "fine", "sampled"),
            ("coarse_shell_rmse", rmse, "coarse", "in_shell"), ("shell_voxel_rmse", rmse, "shell", "in_shell"), ("coarse_shell_peak", largest, "coarse", "in_shell"), ("shell_voxel_peak", largest, "shell", "in_shell"),
        )],
    )


def surface_voxels(cells: DataFrame, surface: float, guard: float) -> DataFrame:
    """(leaf_id, voxel) of the cells (leaf_id, voxel, v, coarse: signed distances) that are on the surface in any frame: near it themselves, or with a coarse value near it or on its other side."""
    v, coarse = F.col("v"), F.col("coarse")
    met = (F.abs(v) <= surface) | (F.abs(coarse) <= guard) | ((v >= 0) != (coarse >= 0))
    return cells.where(met).select("leaf_id", "voxel").distinct()


def level_set_mode(is_empty: Column, surface_cells: Column) -> Column:
    """A level set's leaf has a shell if any of its voxels is on the surface."""
    return F.when(is_empty, "empty").when(surface_cells > 0, "shell").otherwise("coarse")


def within_streams(mode: Column, shell_keys: Column, fine_keys: Column, most: int = MOST_KEYS) -> Column:
    """The mode after streams that overflow: without a shell that can be counted, fine if that has a countable stream, else coarse."""
    over = (shell_keys > most) & (mode != "empty")
    return F.when(~over, mode).when(fine_keys.between(1, most), "fine").otherwise("coarse")
