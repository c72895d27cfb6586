"""Triangle meshes as tables: (key, tri, ax..cz). Height fields, samples, and exact distances of points to the nearest triangle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import metrics

#: Steps of a two-dimensional sequence of low discrepancy: powers of the plastic number's inverse.
STEP_U, STEP_V = 0.7548776662466927, 0.5698402909980532
CORNERS = [f"{c}{a}" for c in "abc" for a in "xyz"]
#: Triangles and samples of a mesh that one task holds; a key with a larger mesh is spread over tasks. Pairs that are looked at together.
HELD, _PAIRS = 1 << 16, 1 << 18


def height_mesh(points: DataFrame, key: str) -> DataFrame:
    """Two triangles for each square of a height field (key, x, y, h; x and y whole) whose four corners are there.

    Each point is sent to the four squares it is a corner of, so one shuffle finds all squares.
    """
    sent = F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(dx + 2 * dy).alias("corner")) for dx in (0, 1) for dy in (0, 1)])
    met = points.select(key, "h", F.explode(sent).alias("s")).groupBy(key, F.col("s.x").alias("x"), F.col("s.y").alias("y"))
    squares = met.agg(*[F.max(F.when(F.col("s.corner") == c, F.col("h"))).alias(f"h{c}") for c in range(4)]).where("h0 is not null and h1 is not null and h2 is not null and h3 is not null")
    at = lambda c: [f"cast(x + {c & 1} as double)", f"cast(y + {c >> 1} as double)", f"cast(h{c} as double)"]
    half = lambda n, corners: "named_struct(" + ", ".join(f"'{name}', {e}" for name, e in [("half", f"{n}L"), *zip(CORNERS, sum(map(at, corners), []), strict=True)]) + ")"
    two = squares.select(key, "x", "y", F.explode(F.expr(f"array({half(0, (0, 1, 2))}, {half(1, (1, 3, 2))})")).alias("s"))
    return two.select(key, F.expr("(x * 1048576 + y) * 2 + s.half").alias("tri"), *[f"s.{c}" for c in CORNERS])


def with_normals(triangles: DataFrame) -> DataFrame:
    """Triangles with area and unit normal (nx, ny, nz); those without area go."""
    u, v = ([f"({c}{a} - a{a})" for a in "xyz"] for c in "bc")
    cross = [f"{u[i]} * {v[j]} - {u[j]} * {v[i]}" for i, j in ((1, 2), (2, 0), (0, 1))]
    out = triangles.withColumns({f"m{a}": F.expr(e) for a, e in zip("xyz", cross, strict=True)}).withColumn("double_area", F.expr("sqrt(mx * mx + my * my + mz * mz)"))
    out = out.where("double_area > 2.220446049250313e-16")
    return out.withColumns({f"n{a}": F.col(f"m{a}") / F.col("double_area") for a in "xyz"}).withColumn("area", F.col("double_area") / 2).drop("mx", "my", "mz", "double_area")


def surface_samples(triangles: DataFrame, key: str, density: float) -> DataFrame:
    """(key, id, px, py, pz, nx, ny, nz): floor(area * density) points of each triangle with normals, one at least, spread by a fixed sequence."""
    j = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("area") * density).cast("int")))).alias("j")
    spread = triangles.select("*", j).withColumns({"u": F.expr(f"(0.5D + j * {STEP_U}D) - floor(0.5D + j * {STEP_U}D)"), "w": F.expr(f"(0.5D + j * {STEP_V}D) - floor(0.5D + j * {STEP_V}D)")})
    spread = spread.withColumn("out", F.expr("u + w > 1")).withColumns({"u": F.expr("if(out, 1 - u, u)"), "w": F.expr("if(out, 1 - w, w)")})
    return spread.select(key, F.struct("tri", "j").alias("id"), *[F.expr(f"a{a} + u * (b{a} - a{a}) + w * (c{a} - a{a})").alias(f"p{a}") for a in "xyz"], "nx", "ny", "nz")


def _dot(p: str, q: str) -> str:
    return "(" + " + ".join(f"({p.replace('?', a)}) * ({q.replace('?', a)})" for a in "xyz") + ")"


def point_to_triangle(pairs: DataFrame) -> DataFrame:
    """pairs (px, py, pz, ax..cz) with d2, the squared distance to the triangle, by the cell of corners, edges and face that the point lies in."""
    d = {f"e{n}": F.expr(_dot(f"{c}? - a?", f"p? - {o}?")) for n, c, o in ((1, "b", "a"), (2, "c", "a"), (3, "b", "b"), (4, "c", "b"), (5, "b", "c"), (6, "c", "c"))}
    out = pairs.withColumns(d).withColumns({"va": F.expr("e3 * e6 - e5 * e4"), "vb": F.expr("e5 * e2 - e1 * e6"), "vc": F.expr("e1 * e4 - e3 * e2")})
    cells = [
        ("e1 <= 0 and e2 <= 0", "0D", "0D"),
        ("e3 >= 0 and e4 <= e3", "1D", "0D"),
        ("e6 >= 0 and e5 <= e6", "0D", "1D"),
        ("vc <= 0 and e1 >= 0 and e3 <= 0", "e1 / (e1 - e3)", "0D"),
        ("vb <= 0 and e2 >= 0 and e6 <= 0", "0D", "e2 / (e2 - e6)"),
        ("va <= 0 and e4 - e3 >= 0 and e5 - e6 >= 0", "1 - (e4 - e3) / ((e4 - e3) + (e5 - e6))", "(e4 - e3) / ((e4 - e3) + (e5 - e6))"),
        ("true", "vb / (va + vb + vc)", "vc / (va + vb + vc)"),
    ]
    share = lambda k: F.expr("case " + " ".join(f"when {c[0]} then {c[k]}" for c in cells) + " end")
    out = out.withColumns({"s": share(1), "t": share(2)})
    gap = [f"px - ax - s * (bx - ax) - t * (cx - ax)".replace("x", a) for a in "xyz"]
    return out.withColumn("d2", F.expr(" + ".join(f"({g}) * ({g})" for g in gap))).drop(*d, "va", "vb", "vc", "s", "t")


def _nodes(triangles: DataFrame, key: str, size: float) -> DataFrame:
    """Blocks of a level by the triangles' centres: what box their triangles fill, and one of their corners."""
    block = [F.floor((F.col(f"a{a}") + F.col(f"b{a}") + F.col(f"c{a}")) / (3 * size)).cast("long").alias(f"b_{a}") for a in "xyz"]
    ends = [f(F.expr(f"{g}(a{a}, b{a}, c{a})")).alias(f"{n}_{a}") for n, f, g in (("lo", F.min, "least"), ("hi", F.max, "greatest")) for a in "xyz"]
    return triangles.groupBy(key, *block).agg(*ends, F.min(F.struct("ax", "ay", "az")).alias("corner"))


def nearest_triangle(points: DataFrame, triangles: DataFrame, key: str, size: float, levels: int) -> DataFrame:
    """Each point (key, id, px, py, pz, ...) with d2 and the number and normal of the nearest triangle of its key (of equals, to nine places, the lowest number).

    Blocks of side size, 2 size, ... form levels; a block keeps the box that its triangles fill and one of their corners. From
    the top down a point keeps the blocks whose box is no farther than the nearest corner it has seen, so it ends with the few
    blocks that can hold its nearest triangle, however lonely it is or however dense they are. Each level is a join and a window
    by point. Points whose key has no triangle are left out.
    """
    own = points.select(key, "id", "px", "py", "pz")
    outside = " + ".join(f"pow(greatest(lo_{a} - p{a}, 0D, p{a} - hi_{a}), 2)" for a in "xyz")
    corner = " + ".join(f"pow(p{a} - corner.a{a}, 2)" for a in "xyz")
    open_ = None
    for level in range(levels - 1, -1, -1):
        nodes = _nodes(triangles, key, size * 2**level)
        if open_ is None:
            met = own.join(nodes, key)
        else:
            up = [F.floor(F.col(f"b_{a}") / 2.0).cast("long").alias(f"u_{a}") for a in "xyz"]
            met = open_.join(nodes.select("*", *up), [key, "u_x", "u_y", "u_z"])
        met = met.withColumns({"low": F.expr(outside), "high": F.expr(corner)})
        met = met.withColumn("bound", F.min("high").over(Window.partitionBy(key, "id"))).where("low <= bound * (1 + 1e-12D)")
        open_ = met.select(key, "id", "px", "py", "pz", *[F.col(f"b_{a}").alias(f"u_{a}") for a in "xyz"])
    block = [F.floor((F.col(f"a{a}") + F.col(f"b{a}") + F.col(f"c{a}")) / (3 * size)).cast("long").alias(f"u_{a}") for a in "xyz"]
    faces = triangles.select(key, "tri", *CORNERS, *[F.col(f"n{a}").alias(f"to_n{a}") for a in "xyz"], *block)
    exact = point_to_triangle(open_.join(faces, [key, "u_x", "u_y", "u_z"]))
    best = F.min(F.struct(F.round("d2", 9).alias("near"), "tri", "d2", "to_nx", "to_ny", "to_nz")).alias("m")
    found = exact.groupBy(key, "id").agg(best).select(key, "id", "m.tri", "m.d2", "m.to_nx", "m.to_ny", "m.to_nz")
    return points.join(found, [key, "id"])


def direction_metrics(met: DataFrame, key: str) -> DataFrame:
    """By key of points with d2, own normals and those of their nearest triangles: n, mean, mean2, largest, p95 and p99 of distances, angle and p95_angle between normals, plain_angle and p95_plain_angle without orientation."""
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.expr("nx * to_nx + ny * to_ny + nz * to_nz")))
    each = met.select(key, F.sqrt("d2").alias("d"), "d2", F.degrees(F.acos(cosine)).alias("angle"), F.degrees(F.acos(F.abs(cosine))).alias("plain"))
    sums = each.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.avg("d2").alias("mean2"), F.max("d").alias("largest"), F.avg("angle").alias("angle"), F.avg("plain").alias("plain_angle"))
    three = F.array(*[F.struct(F.lit(i).alias("of"), F.col(c).alias("v")) for i, c in enumerate(("d", "angle", "plain"))])
    stacked = each.select(key, F.explode(three).alias("m")).select(F.struct(key, "m.of").alias("k"), "m.v")
    places = metrics.linear_percentiles(stacked, "k", "v", {"p95": 0.95, "p99": 0.99})
    named = [F.max(F.when(F.col("k.of") == i, F.col(c))).alias(name) for i, c, name in ((0, "p95", "p95"), (0, "p99", "p99"), (1, "p95", "p95_angle"), (2, "p95", "p95_plain_angle"))]
    return sums.join(places.groupBy(F.col(f"k.{key}").alias(key)).agg(*named), key)


def _gaps(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """point_to_triangle's d2 of pairs of points (n, 3) and corners (n, 3, 3)."""
    dot = lambda u, v: (u * v).sum(axis=1)
    a, u, v = c[:, 0], c[:, 1] - c[:, 0], c[:, 2] - c[:, 0]
    e1, e2, e3, e4, e5, e6 = (dot(w, p - c[:, o]) for o in range(3) for w in (u, v))
    va, vb, vc = e3 * e6 - e5 * e4, e5 * e2 - e1 * e6, e1 * e4 - e3 * e2
    cells = [(e1 <= 0) & (e2 <= 0), (e3 >= 0) & (e4 <= e3), (e6 >= 0) & (e5 <= e6), (vc <= 0) & (e1 >= 0) & (e3 <= 0), (vb <= 0) & (e2 >= 0) & (e6 <= 0), (va <= 0) & (e4 - e3 >= 0) & (e5 - e6 >= 0)]
    zero, one = np.zeros(len(p)), np.ones(len(p))
    with np.errstate(all="ignore"):
        edge = (e4 - e3) / ((e4 - e3) + (e5 - e6))
        s = np.select(cells, [zero, one, zero, e1 / (e1 - e3), zero, 1 - edge], vb / (va + vb + vc))
        t = np.select(cells, [zero, zero, one, zero, e2 / (e2 - e6), edge], vc / (va + vb + vc))
    gap = p - a - s[:, None] * u - t[:, None] * v
    return dot(gap, gap)


def _nearest_held(p: np.ndarray, c: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, d2) of each point's nearest triangle, of equals to nine places the lowest number. Blocks of triangles whose box is farther than a corner seen are left out."""
    centre = c.mean(axis=1)
    side = max(float(np.ptp(centre, axis=0).max()) / len(c) ** 0.25, 1e-9)
    _, block = np.unique(np.floor((centre - centre.min(axis=0)) / side).astype(np.int64), axis=0, return_inverse=True)
    order = np.lexsort((tri, block.ravel()))
    c, tri, held = c[order], tri[order], np.bincount(block.ravel())
    first = np.cumsum(held) - held
    low, high, seen = np.minimum.reduceat(c.min(axis=1), first), np.maximum.reduceat(c.max(axis=1), first), c[first, 0]
    place, d2 = np.zeros(len(p), dtype=np.int64), np.zeros(len(p))
    some = max(1, _PAIRS // len(held))
    for at in range(0, len(p), some):
        q = p[at : at + some]
        out = np.maximum(np.maximum(low - q[:, None], q[:, None] - high), 0.0)
        bound = ((q[:, None] - seen) ** 2).sum(axis=2).min(axis=1)
        of, met = np.nonzero((out**2).sum(axis=2) <= bound[:, None] * (1 + 1e-12))
        pairs = np.bincount(of, weights=held[met], minlength=len(q))
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(pairs), np.arange(0, pairs.sum() + 1, _PAIRS), side="left"), [0, len(q)]))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            mine = slice(*np.searchsorted(of, [i, j]))
            n = held[met[mine]]
            point = np.repeat(of[mine], n)
            face = np.repeat(first[met[mine]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            gap = _gaps(q[point], c[face])
            best = np.lexsort((tri[face], np.floor(gap * 1e9 + 0.5), point))
            best = best[np.searchsorted(point[best], np.arange(i, j))]
            place[at + i : at + j], d2[at + i : at + j] = order[face[best]], gap[best]
    return place, d2


def _held_way(mine: tuple, other: tuple, density: float) -> list[float]:
    """direction_metrics' numbers, in the order of _MEASURES, of samples of one mesh (corners, numbers, areas, normals) to another's triangles."""
    c, _, area, normal = mine
    n = np.maximum(1, np.floor(area * density)).astype(np.int64)
    face = np.repeat(np.arange(len(c)), n)
    j = np.arange(len(face)) - np.repeat(np.cumsum(n) - n, n) + 1
    u, w = 0.5 + j * STEP_U, 0.5 + j * STEP_V
    u, w = u - np.floor(u), w - np.floor(w)
    out = u + w > 1
    u, w = np.where(out, 1 - u, u)[:, None], np.where(out, 1 - w, w)[:, None]
    a = c[face, 0]
    place, d2 = _nearest_held(a + u * (c[face, 1] - a) + w * (c[face, 2] - a), other[0], other[1])
    d, cosine = np.sqrt(d2), np.clip((normal[face] * other[3][place]).sum(axis=1), -1, 1)
    angle, plain = np.degrees(np.arccos(cosine)), np.degrees(np.arccos(np.abs(cosine)))
    return [len(d), d.mean(), d2.mean(), d.max(), angle.mean(), plain.mean(), *np.percentile(d, [95, 99]), np.percentile(angle, 95), np.percentile(plain, 95)]


_MEASURES = ("n", "mean", "mean2", "largest", "angle", "plain_angle", "p95", "p99", "p95_angle", "p95_plain_angle")


def _held_distances(left: DataFrame, right: DataFrame, key: str, density: float) -> DataFrame:
    """Both directions' _MEASURES by key of triangles with normals; a key's two meshes meet in one task and nothing but them is shuffled."""
    names = [f"{c}_{way}" for c in _MEASURES for way in ("there", "back")]
    kind = {"n": "long"}
    schema = ", ".join([f"`{key}` {left.schema[key].dataType.simpleString()}", *[f"{n} {kind.get(n.partition('_')[0], 'double')}" for n in names]])

    def run(there: pa.Table, back: pa.Table) -> pa.Table:
        if not len(there) or not len(back):
            return there.select([key]).slice(0, 0)
        column = lambda t, cs: np.stack([t[c].to_numpy() for c in cs], axis=1)
        two = [(column(t, CORNERS).reshape(-1, 3, 3), t["tri"].to_numpy(), t["area"].to_numpy(), column(t, ["nx", "ny", "nz"])) for t in (there, back)]
        ways = [_held_way(two[0], two[1], density), _held_way(two[1], two[0], density)]
        values = [pa.array([ways[i][k]], pa.int64() if c == "n" else pa.float64()) for k, c in enumerate(_MEASURES) for i in (0, 1)]
        return pa.table([there[key].slice(0, 1).combine_chunks(), *values], names=[key, *names])

    def rows(there: pa.Table, back: pa.Table) -> pa.Table:
        out = run(there, back)
        return out if out.num_columns > 1 else pa.table({key: out[key]} | {n: pa.array([], pa.int64() if n.startswith("n_") else pa.float64()) for n in names})

    # under a name of its own, as both meshes may come from one table
    return left.groupBy(key).cogroup(right.withColumn("__key", F.col(key)).drop(key).groupBy("__key")).applyInArrow(rows, schema)


def mesh_distances(left: DataFrame, right: DataFrame, key: str, density: float, size: float, levels: int) -> DataFrame:
    """direction_metrics of samples of two meshes' triangles to each other's by key, and both directions' means: chamfer_l1, chamfer_l2, hausdorff (of the samples), unoriented_angle.

    Keys whose meshes have up to HELD triangles and samples are one task's work each; only larger
    ones are spread over tasks, block by block, both directions as one with the direction as part of the key.
    """
    left, right = with_normals(left), with_normals(right)
    points = F.sum(F.greatest(F.lit(1), F.floor(F.col("area") * density)))
    sizes = left.unionByName(right).groupBy(key).agg((points + F.count(F.lit(1))).alias("size"))
    large = written(sizes.where(f"size > {HELD}").select(key), "large")
    found = _held_distances(left.join(large, key, "left_anti"), right.join(large, key, "left_anti"), key, density)
    if not large.isEmpty():
        found = found.unionByName(_spread_distances(left.join(large, key, "left_semi"), right.join(large, key, "left_semi"), key, density, size, levels))
    half = lambda c: (F.col(f"{c}_there") + F.col(f"{c}_back")) / 2
    return found.withColumns({"chamfer_l1": half("mean"), "chamfer_l2": half("mean2"), "hausdorff": F.greatest("largest_there", "largest_back"), "unoriented_angle": half("plain_angle")})


def _spread_distances(left: DataFrame, right: DataFrame, key: str, density: float, size: float, levels: int) -> DataFrame:
    """_held_distances of meshes of any size."""
    way = lambda mesh, side: mesh.withColumn("way", F.struct(F.col(key).alias("k"), F.lit(side).alias("side"))).drop(key)
    points = surface_samples(way(left, 0).unionByName(way(right, 1)), "way", density)
    met = written(nearest_triangle(points, way(right, 0).unionByName(way(left, 1)), "way", size, levels), "nearest")
    found = direction_metrics(met, "way")
    sides = [F.max(F.when(F.col("way.side") == i, F.col(c))).alias(f"{c}_{name}") for c in _MEASURES for i, name in enumerate(("there", "back"))]
    return found.groupBy(F.col("way.k").alias(key)).agg(*sides).where("n_there is not null and n_back is not null")
