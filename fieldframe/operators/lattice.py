"""Where a volume is sampled: query patterns, lattices, clamped leaves, dense samples between cells, rays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = 8
#: Names of the query patterns.
PATTERNS = ("random", "same_t", "same_xyz", "coherent")


def drawn(key: Column, salt: int, n: int) -> Column:
    """A whole number under n for each key, by a multiplicative hash that any SQL engine can compute."""
    key = key.cast("long")
    return F.pmod((F.pmod(key, F.lit(1_000_003)) + 7919 * salt) * 48271 + F.pmod(key * 69621, F.lit(65537)), F.lit(2**31 - 1)) % n


def query_pattern(ids: DataFrame, pattern: str, width: int, height: int, depth: int, frames: int) -> DataFrame:
    """Queries (qid, x, y, z, t), one for each row of ids (qid).

    random draws all four, same_t and same_xyz hold a frame or a place fixed, coherent fills
    tiles of 8 x 8 x 8 at drawn blocks in one frame, clamped to the volume.
    """
    if pattern not in PATTERNS:
        raise ValueError(f"unknown pattern {pattern}; known are {', '.join(PATTERNS)}")
    q, sizes = F.col("qid"), (width, height, depth, frames)
    free = [drawn(q, i + 1, n) for i, n in enumerate(sizes)]
    fixed = [drawn(F.lit(0), i + 11, n) for i, n in enumerate(sizes)]
    if pattern == "coherent":
        inside = [q % LEAF, F.floor(q / float(LEAF)) % LEAF, F.floor(q / float(LEAF * LEAF)) % LEAF]
        free = [F.least(F.lit(n - 1), F.floor(free[i] / float(LEAF)) * LEAF + inside[i]) for i, n in enumerate(sizes[:3])] + [fixed[3]]
    held = {"random": (), "same_t": (3,), "same_xyz": (0, 1, 2), "coherent": ()}[pattern]
    return ids.select("qid", *[(fixed if i in held else free)[i].cast("long").alias(a) for i, a in enumerate("xyzt")])


def phases(step: int) -> tuple[int, ...]:
    """Where a lattice of this step starts on an axis: at both 0 and half a leaf if it would else meet each leaf at one place only."""
    return (0, LEAF // 2) if step >= LEAF and step % LEAF == 0 else (0,)


def on_lattice(axis: str, step: int) -> Column:
    hit = F.lit(False)
    for phase in phases(step):
        hit = hit | ((F.col(axis) >= phase) & (F.pmod(F.col(axis) - phase, F.lit(step)) == 0))
    return hit


def sub_start(total: int, size: int, wanted: int = -1) -> int:
    """Where a part of an axis starts: as wanted, moved inside; in the middle if nothing is wanted."""
    if size >= total:
        return 0
    return min(wanted, total - size) if wanted >= 0 else (total - size) // 2


def padded_leaves(cells: DataFrame, leaves: DataFrame, width: int, height: int, depth: int) -> DataFrame:
    """(bx, by, bz, t, voxel, v): all 512 values of each leaf and frame of leaves (bx, by, bz, t), places outside the volume taking the nearest cell's value, absent cells 0."""
    spots = leaves.withColumn("voxel", F.explode(F.sequence(F.lit(0), F.lit(LEAF**3 - 1))))
    local = {"x": F.col("voxel") % LEAF, "y": F.expr(f"voxel div {LEAF} % {LEAF}"), "z": F.expr(f"voxel div {LEAF * LEAF}")}
    aimed = spots.select("bx", "by", "bz", "t", "voxel", *[F.least(F.lit(n - 1), F.col(f"b{a}") * LEAF + local[a]).cast("long").alias(a) for a, n in zip("xyz", (width, height, depth), strict=True)])
    return aimed.join(cells, ["x", "y", "z", "t"], "left").select("bx", "by", "bz", "t", "voxel", F.coalesce("v", F.lit(0.0)).alias("v"))


def between_cells(points: DataFrame, cells: DataFrame, width: int, height: int, depth: int) -> DataFrame:
    """points (pid, px, py, pz, t) with v: trilinear between the eight cells around each, coordinates clamped to the volume, absent cells 0.

    Eight rows a point meet the cells in one join; weights of 0 are left out.
    """
    out = points
    for a, n in zip("xyz", (width, height, depth), strict=True):
        at = F.least(F.lit(float(n - 1)), F.greatest(F.lit(0.0), F.col(f"p{a}")))
        out = out.withColumn(f"at_{a}", at).withColumn(f"lo_{a}", F.least(F.floor(at), F.lit(max(0, n - 2)).cast("long")))
    corner = lambda d: F.struct(*[(F.col(f"lo_{a}") + b).alias(a) for a, b in zip("xyz", d, strict=True)], _weight(d).alias("w"))
    corners = [corner((i & 1, i >> 1 & 1, i >> 2)) for i in range(8)]
    spread = out.select("pid", "t", F.explode(F.array(*corners)).alias("c")).select("pid", "t", "c.*").where("w > 0")
    sums = spread.join(cells, ["x", "y", "z", "t"], "left").groupBy("pid").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("v"))
    return points.join(sums, "pid")


def _weight(d: tuple[int, int, int]) -> Column:
    w = F.lit(1.0)
    for a, b in zip("xyz", d, strict=True):
        part = F.col(f"at_{a}") - F.col(f"lo_{a}")
        w = w * (part if b else 1 - part)
    return w


def orbit_rays(pixels: DataFrame, width: int, height: int, size: tuple[float, float, float], yaw: Column, pitch: Column, distance: Column, view: float) -> DataFrame:
    """pixels (px, py and whatever yaw, pitch and distance need) with a perspective ray: direction dx, dy, dz, near and far of the volume's box, hit.

    The camera circles the box's middle, with y up, at distance times its largest extent.
    """
    import math

    extent, middle = max(size), [s / 2 for s in size]
    orbit = {"x": F.cos(pitch) * F.sin(yaw), "y": F.sin(pitch), "z": F.cos(pitch) * F.cos(yaw)}
    rows = pixels.withColumns({f"o{a}": orbit[a] for a in "xyz"} | {"reach": distance * extent})
    # forward is the orbit reversed; right and up follow from the world's y
    flat = F.sqrt(F.col("ox") * F.col("ox") + F.col("oz") * F.col("oz"))
    rows = rows.withColumns({"rx": F.col("oz") / flat, "rz": -F.col("ox") / flat})
    rows = rows.withColumns({"ux": F.col("rz") * F.col("oy") * -1, "uy": F.col("rz") * F.col("ox") * -1 + F.col("rx") * F.col("oz"), "uz": F.col("rx") * F.col("oy") * -1})
    tangent = math.tan(math.radians(view) / 2)
    sx = (2 * (F.col("px") + 0.5) / width - 1) * (width / height) * tangent
    sy = (1 - 2 * (F.col("py") + 0.5) / height) * tangent
    rows = rows.withColumns({"sx": sx, "sy": sy})
    raw = {"x": -F.col("ox") + F.col("rx") * F.col("sx") + F.col("ux") * F.col("sy"), "y": -F.col("oy") + F.col("uy") * F.col("sy"), "z": -F.col("oz") + F.col("rz") * F.col("sx") + F.col("uz") * F.col("sy")}
    rows = rows.withColumns({f"q{a}": raw[a] for a in "xyz"})
    length = F.sqrt(sum(F.col(f"q{a}") * F.col(f"q{a}") for a in "xyz"))
    rows = rows.withColumns({f"d{a}": F.col(f"q{a}") / length for a in "xyz"} | {f"c{a}": middle["xyz".index(a)] + F.col(f"o{a}") * F.col("reach") for a in "xyz"})
    return slab_clipped(rows, size).drop("rx", "rz", "ux", "uy", "uz", "sx", "sy", "qx", "qy", "qz", "ox", "oy", "oz", "reach")


def slab_clipped(rays: DataFrame, size: tuple[float, float, float]) -> DataFrame:
    """rays (origin cx, cy, cz, direction dx, dy, dz) with near, far and hit of the box from the origin to size."""
    ends = {a: [(side - F.col(f"c{a}")) / F.col(f"d{a}") for side in (0.0, size["xyz".index(a)])] for a in "xyz"}
    near = F.greatest(F.lit(0.0), *[F.least(*ends[a]) for a in "xyz"])
    far = F.least(*[F.greatest(*ends[a]) for a in "xyz"])
    return rays.withColumn("near", near).withColumn("far", far).withColumn("hit", F.col("far") > F.col("near"))


def control_sample(control: Column, points: tuple[int, ...], x: Column, y: Column, z: Column) -> Column:
    """A control grid in the array control, its points on each axis at the given coordinates, sampled between them."""
    n, low, part = len(points), {}, {}
    for a, p in zip("xyz", (x, y, z), strict=True):
        i, f = None, None
        for k in range(n - 1):
            inside, share = p < points[k + 1], (p - points[k]) / float(points[k + 1] - points[k])
            i, f = (F.when(inside, k), F.when(inside, share)) if i is None else (i.when(inside, k), f.when(inside, share))
        last = (p - points[-2]) / float(points[-1] - points[-2])
        low[a], part[a] = i.otherwise(n - 2), f.otherwise(F.least(F.lit(1.0), last))
    out = F.lit(0.0)
    for d in range(8):
        step = {a: d >> k & 1 for k, a in enumerate("xyz")}
        w = F.lit(1.0)
        for a in "xyz":
            w = w * (part[a] if step[a] else 1 - part[a])
        index = ((low["z"] + step["z"]) * n + low["y"] + step["y"]) * n + low["x"] + step["x"]
        out = out + w * F.get(control, index.cast("int")).cast("double")
    return out
