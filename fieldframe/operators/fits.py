"""Fits of leaves and series: keyframes, control grids, cosine energies, weighted cosine series, greedy clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 8


def key_places(t: np.ndarray, v: np.ndarray, eps: np.ndarray) -> list[int]:
    """Places kept of one series so that straight lines between them stay within eps of every value.

    The ends are kept; the worst place (the first of equals) splits a segment while its error
    exceeds eps. Segments wait on a stack, so long series do not recurse.
    """
    if len(t) < 2:
        return list(range(len(t)))
    keys, stack = {0, len(t) - 1}, [(0, len(t) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a > 1:
            part = (t[a + 1 : b] - t[a]) / (t[b] - t[a])
            error = np.abs(v[a + 1 : b] - (v[a] + part * (v[b] - v[a]))) / eps[a + 1 : b]
            worst = int(np.argmax(error))
            if error[worst] > 1:
                split = a + 1 + worst
                keys.add(split)
                stack += [(a, split), (split, b)]
    return sorted(keys)


def adaptive_keys(series: DataFrame, key: str, value: str, eps: str) -> DataFrame:
    """Keyframes (key, t, value) of each series; eps is an expression of a row's tolerance."""
    rows = series.select(key, "t", F.col(value).cast("double").alias("v"), F.expr(eps).cast("double").alias("eps"))
    arrays = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "v", "eps"))).alias("s")).select(key, "s.t", "s.v", "s.eps")

    def run(batches):
        for pdf in batches:
            kept = [key_places(t.astype(float), v, e) for t, v, e in zip(pdf["t"], pdf["v"], pdf["eps"], strict=True)]
            n = [len(k) for k in kept]
            yield pd.DataFrame(
                {
                    key: np.repeat(pdf[key].to_numpy(), n),
                    "t": np.concatenate([t[k] for t, k in zip(pdf["t"], kept, strict=True)]) if n else [],
                    "v": np.concatenate([v[k] for v, k in zip(pdf["v"], kept, strict=True)]) if n else [],
                }
            )

    return arrays.mapInPandas(run, f"{key} {series.schema[key].dataType.simpleString()}, t long, v double")


def control_weights(r: int) -> np.ndarray:
    """(r**3, 512) weights that fit a control grid to a full leaf by least squares.

    The trilinear basis is a product over the axes, and so is its pseudo-inverse.
    """
    if not 2 <= r <= 8:
        raise ValueError("control grids have 2 to 8 points an axis")
    at = np.arange(LEAF) / (LEAF - 1) * (r - 1)
    basis = np.maximum(0, 1 - np.abs(at[:, None] - np.arange(r)))
    one = np.linalg.pinv(basis)
    return np.kron(np.kron(one, one), one)


def control_fit(cells: DataFrame, r: int) -> DataFrame:
    """Least-squares control grids (leaf_id, t, control, c) of cells (leaf_id, t, voxel, v), absent cells counting as 0.

    The weights are a table of r**3 * 512 rows at most, broadcast whatever the data; the
    sums are partial before the shuffle.
    """
    w = control_weights(r)
    spark = cells.sparkSession
    rows = spark.createDataFrame(pd.DataFrame({"voxel": np.arange(w.shape[1]), "weights": w.T.tolist()}), "voxel long, weights array<double>")
    sums = [F.sum(F.col("v") * F.get("weights", i)).alias(f"c{i}") for i in range(r**3)]
    fits = cells.join(F.broadcast(rows), "voxel").groupBy("leaf_id", "t").agg(*sums)
    return fits.select("leaf_id", "t", F.posexplode(F.array(*[f"c{i}" for i in range(r**3)])).alias("control", "c"))


PATCH = 4


def patch_weights() -> np.ndarray:
    """(8, 64) weights that fit two controls an axis to a patch of 4 x 4 x 4 voxels by least squares; a product over the axes."""
    at = np.arange(PATCH) / (PATCH - 1)
    one = np.linalg.pinv(np.stack([1 - at, at], axis=1))
    return np.kron(np.kron(one, one), one)


def with_patches(cells: DataFrame) -> DataFrame:
    """cells (leaf_id, voxel, ...) with the patch of 4 x 4 x 4 voxels that each lies in, of eight, and its place inside."""
    e = F.expr
    out = cells.withColumns({"ax": e("voxel % 8"), "ay": e("voxel div 8 % 8"), "az": e("voxel div 64")})
    out = out.withColumns({"patch": e("(az div 4 * 2 + ay div 4) * 2 + ax div 4"), "inside": e("(az % 4 * 4 + ay % 4) * 4 + ax % 4")})
    return out.drop("ax", "ay", "az")


def patch_fit(cells: DataFrame) -> DataFrame:
    """(leaf_id, t, patch, controls): least-squares grids of 2 x 2 x 2 controls for each patch of cells (leaf_id, t, voxel, v), absent cells counting as 0.

    The weights are 64 rows, broadcast; the sums are partial before the shuffle.
    """
    w = patch_weights()
    rows = cells.sparkSession.createDataFrame([(i, [float(x) for x in w[:, i]]) for i in range(PATCH**3)], "inside long, weights array<double>")
    sums = F.array(*[F.sum(F.col("v") * F.get("weights", F.lit(c))) for c in range(8)]).alias("controls")
    return with_patches(cells).join(F.broadcast(rows), "inside").groupBy("leaf_id", "t", "patch").agg(sums)


def patch_residuals(cells: DataFrame) -> DataFrame:
    """cells (leaf_id, t, voxel, v) with patch, fitted, the value of its patch's controls there, and passed_on, what is left for the next stage."""
    at = {a: F.expr(f"inside div {d} % 4 / 3D") for a, d in (("px", 1), ("py", 4), ("pz", 16))}
    weight = lambda c: " * ".join(f"p{a}" if c >> i & 1 else f"(1 - p{a})" for i, a in enumerate("xyz"))
    met = with_patches(cells).join(patch_fit(cells), ["leaf_id", "t", "patch"]).withColumns(at)
    fitted = F.expr(" + ".join(f"get(controls, {c}) * {weight(c)}" for c in range(8)))
    return met.withColumn("fitted", fitted).withColumn("passed_on", F.col("v") - F.col("fitted")).drop("px", "py", "pz", "controls", "inside")


def cosine_energies(cells: DataFrame) -> DataFrame:
    """Energy of each leaf's frame by 3-D cosine coefficient: (leaf_id, t, total, dc, low, high).

    low has all indices under 2, high has one of 4 or more. Absent cells count as 0. One
    shuffle brings the at most 512 cells of a leaf's frame together.
    """
    i = np.arange(LEAF)
    basis = np.cos(np.pi / LEAF * (i[None, :] + 0.5) * i[:, None]) * np.where(i == 0, np.sqrt(1 / LEAF), np.sqrt(2 / LEAF))[:, None]
    top = np.maximum(np.maximum(i[:, None, None], i[None, :, None]), i[None, None, :])

    def run(batches):
        for pdf in batches:
            block = np.zeros((len(pdf), LEAF**3))
            for n, (voxel, v) in enumerate(zip(pdf["voxel"], pdf["v"], strict=True)):
                block[n, voxel] = v
            c = block.reshape(-1, LEAF, LEAF, LEAF)
            for axis in ("nzyx,kx->nzyk", "nzyx,ky->nzkx", "nzyx,kz->nkyx"):
                c = np.einsum(axis, c, basis)
            e = c * c
            parts = {"total": e.sum(axis=(1, 2, 3)), "dc": e[:, 0, 0, 0], "low": e[:, top < 2].sum(axis=1), "high": e[:, top >= 4].sum(axis=1)}
            yield pdf[["leaf_id", "t"]].assign(**parts)

    held = cells.groupBy("leaf_id", "t").agg(F.collect_list(F.struct("voxel", "v")).alias("s")).select("leaf_id", "t", "s.voxel", "s.v")
    return held.mapInPandas(run, "leaf_id long, t long, total double, dc double, low double, high double")


def weighted_cosines(series: DataFrame, key: str, value: str, weight: str, n: int, keep: int) -> DataFrame:
    """The first `keep` cosine coefficients (key, k, c) of each series by weighted least squares over the frames it has.

    Weights are at least 1e-6. The normal equations are sums by key, partial before the
    shuffle; only their solution, keep x keep numbers a key, happens in Python. A singular
    system falls back on plain sums of value times basis.
    """
    basis = [F.expr(f"(case when {k} = 0 then sqrt(1e0 / {n}) else sqrt(2e0 / {n}) end) * cos(pi() / {n} * (t + 0.5e0) * {k})") for k in range(keep)]
    rows = series.select(key, F.col(value).cast("double").alias("v"), F.greatest(F.expr(weight).cast("double"), F.lit(1e-6)).alias("w"), *[b.alias(f"b{k}") for k, b in enumerate(basis)])
    grams = [F.sum(F.col("w") * F.col(f"b{i}") * F.col(f"b{j}")) for i in range(keep) for j in range(keep)]
    right = [F.sum(F.col("w") * F.col("v") * F.col(f"b{i}")) for i in range(keep)]
    plain = [F.sum(F.col("v") * F.col(f"b{i}")) for i in range(keep)]
    sums = rows.groupBy(key).agg(F.array(*grams).alias("g"), F.array(*right).alias("r"), F.array(*plain).alias("p"))

    def run(batches):
        for pdf in batches:
            c = np.stack(pdf["p"].to_list()) if len(pdf) else np.zeros((0, keep))
            for i, (g, r) in enumerate(zip(pdf["g"], pdf["r"], strict=True)):
                g = np.reshape(g, (keep, keep))
                if np.linalg.cond(g) < 1e12:
                    c[i] = np.linalg.solve(g, r)
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), keep), "k": np.tile(np.arange(keep), len(pdf)), "c": c.ravel()})

    return sums.mapInPandas(run, f"{key} {series.schema[key].dataType.simpleString()}, k long, c double")


def first_fit(block: np.ndarray, tolerance: np.ndarray, limit: float) -> np.ndarray:
    """The row number of each row's centre: the centre with the smallest largest error relative to the row's tolerance if that is within the limit (the earliest of equals), else the row itself."""
    centres: list[int] = []
    out = np.empty(len(block), dtype=np.int64)
    for i, row in enumerate(block):
        out[i] = i
        if centres:
            error = np.abs(block[centres] - row).max(axis=1) / tolerance[i]
            best = int(np.argmin(error))
            if error[best] <= limit:
                out[i] = centres[best]
        if out[i] == i:
            centres.append(i)
    return out


def leaf_clusters(cells: DataFrame, frames: int, eps: float, relative: float, limit: float) -> DataFrame:
    """Greedy clusters of the series of each leaf's voxels, in voxel order: (leaf_id, voxel, centre).

    Rows are (leaf_id, voxel, t, v), absent frames count as 0. The tolerance of a series is
    eps + relative times its deviation. A leaf has 512 series at most, whatever the data.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        voxels, place = np.unique(pdf["voxel"].to_numpy(), return_inverse=True)
        block = np.zeros((len(voxels), frames))
        block[place, pdf["t"].to_numpy()] = pdf["v"].to_numpy()
        centre = first_fit(block, eps + relative * block.std(axis=1), limit)
        return pd.DataFrame({"leaf_id": pdf["leaf_id"].iloc[0], "voxel": voxels, "centre": voxels[centre]})

    return cells.select("leaf_id", "voxel", "t", "v").groupBy("leaf_id").applyInPandas(run, "leaf_id long, voxel long, centre long")


def guarded_keys(series: DataFrame, key: str, value: str, eps: str, floor: float, protected: DataFrame) -> DataFrame:
    """Keyframes (key, t) of series that vary by less than floor (one key, the first), of others by splitting, with protected keys (key, t) added where the series has them."""
    flat = series.groupBy(key).agg((F.stddev_pop(value) < floor).alias("flat"), F.min("t").alias("first"))
    split = adaptive_keys(series, key, value, eps).select(key, "t")
    held = protected.join(series.select(key, "t"), [key, "t"], "left_semi")
    kept = split.unionByName(held).join(flat.where("not flat"), key).select(key, "t")
    return kept.unionByName(flat.where("flat").select(key, F.col("first").alias("t"))).distinct()


def budget_places(t: np.ndarray, v: np.ndarray, k: int) -> tuple[list[int], float]:
    """The k places of a series, both ends among them, whose straight lines leave the least squared error, and that error.

    Errors of all segments come from sums over ranges, then the best ways to reach each
    place with one more line are found from those with one fewer.
    """
    n = len(t)
    if n <= k or n < 2:
        return list(range(n)), 0.0
    error = np.full((n, n), np.inf)
    for a in range(n - 1):
        for b in range(a + 1, n):
            line = v[a] + (t[a : b + 1] - t[a]) / (t[b] - t[a]) * (v[b] - v[a])
            error[a, b] = ((v[a : b + 1] - line) ** 2).sum()
    best, back = error[0].copy(), [np.zeros(n, dtype=int)]
    best[0] = np.inf
    for _ in range(k - 2):
        through = best[:, None] + error
        back.append(through.argmin(axis=0))
        best = through.min(axis=0)
    places = [n - 1]
    for step in back[::-1]:
        places.append(int(step[places[-1]]))
    return places[::-1], float(best[n - 1])


def budget_keys(series: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, t, v, sse): the k best keyframes of each series. A series is one row of its key's frames; n * n numbers of it are held at a time."""
    rows = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).cast("double").alias("v")))).alias("s")).select(key, "s.t", "s.v")

    def run(batches):
        for pdf in batches:
            for name, t, v in zip(pdf[key], pdf["t"], pdf["v"], strict=True):
                places, sse = budget_places(t.astype(float), v, k)
                yield pd.DataFrame({key: name, "t": t[places], "v": v[places], "sse": sse})

    return rows.mapInPandas(run, f"{key} {series.schema[key].dataType.simpleString()}, t long, v double, sse double")


#: Terms of the polynomial bases, in coordinates from -1 to 1.
POLY8 = ("1", "px", "py", "pz", "px * py", "px * pz", "py * pz", "px * py * pz")
POLY11 = (*POLY8, "px * px", "py * py", "pz * pz")


def polynomial_fit(cells: DataFrame, keys: list[str], basis: tuple[str, ...] = POLY8) -> DataFrame:
    """(keys, term, c): least-squares polynomials of cells (keys, voxel, v) over a leaf's coordinates.

    The normal equations are sums by key, partial before the shuffle; only their solution
    happens in Python, by the least-norm one where they are singular.
    """
    at = lambda d: f"(voxel div {d} % 8) / 3.5e0 - 1"
    rows = cells.select(*keys, F.col("v").cast("double").alias("v"), F.expr(at(1)).alias("px"), F.expr(at(8)).alias("py"), F.expr(at(64)).alias("pz"))
    n, b = len(basis), [F.expr(e).cast("double") for e in basis]
    sums = rows.groupBy(*keys).agg(F.array(*[F.sum(b[i] * b[j]) for i in range(n) for j in range(n)]).alias("g"), F.array(*[F.sum(F.col("v") * x) for x in b]).alias("r"))

    def run(batches):
        for pdf in batches:
            c = [np.linalg.lstsq(np.reshape(g, (n, n)), np.asarray(r), rcond=1e-12)[0] for g, r in zip(pdf["g"], pdf["r"], strict=True)]
            yield pd.DataFrame({k: np.repeat(pdf[k].to_numpy(), n) for k in keys} | {"term": np.tile(np.arange(n), len(pdf)), "c": np.concatenate(c) if c else []})

    types = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(run, f"{types}, term long, c double")
