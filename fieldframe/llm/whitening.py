"""Operator 11, embedding whitening with a weighted multiplicity covariance.

Vectors become integers and equal ones are grouped, so every distinct vector is weighed,
multiplied and whitened once: by one, or by how many rows have it. Sums are exact
integers; the covariance is a weighted product of centred matrices, one for each task, and only
dimension x dimension numbers reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A vector with more than a thousandth of all rows is joined back by broadcast: there are fewer than a thousand of them.
HOT = 1000
LONG = 2**63 - 1


@dataclass(frozen=True)
class Space:
    """The fit over the distinct vectors of one dimension: the total of their weights, the weighted sums and the leading components."""

    n: int
    sums: tuple[int, ...]
    basis: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def entries(frame: DataFrame, vector: str, scale: int) -> DataFrame:
    """frame with vector replaced by x, its entries times scale rounded down (values beyond a long saturate); rows whose vector is null or holds null or non-finite entries go."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | F.abs(c.cast("double")).isin(float("inf")))
    fine = frame.where(F.col(vector).isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    return fine.withColumn(vector, F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)).cast("long"))).withColumnRenamed(vector, "x")


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a batch by dimension: dimension, their places, and a matrix of them."""
    offsets = np.asarray(column.offsets)
    size, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        yield dim, at, flat[offsets[at][:, None] + np.arange(dim)]


def _centred(x: np.ndarray, n: int, sums) -> np.ndarray:
    """n * x - sums, exact: as 64-bit integers where these can hold it, else as Python's."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    if n * most < 2**62 and max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _squares(d: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; None where a long can't hold it."""
    if d.dtype != object and d.shape[1] * max(int(np.abs(d).max(initial=0)), 1) ** 2 <= LONG:
        return (d * d).sum(axis=1).tolist()
    return [s if (s := sum(int(v) ** 2 for v in row)) <= LONG else None for row in d]


def _weights(batch: pa.RecordBatch, at: np.ndarray, multiplicity: bool) -> np.ndarray:
    return batch.column("copies").to_numpy()[at] if multiplicity else np.ones(len(at), dtype=np.int64)


def _sums(vectors: DataFrame, multiplicity: bool) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Per dimension the total of the weights and the weighted sums of x over the distinct vectors."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for dim, at, x in _matrices(batch.column("x")):
                w = _weights(batch, at, multiplicity)
                one = [int(w.sum()), w @ (x >> 32), w @ (x & 0xFFFFFFFF)]
                held[dim] = [a + b for a, b in zip(held[dim], one, strict=True)] if dim in held else one
        for dim, (n, high, low) in held.items():
            yield pa.RecordBatch.from_pydict({"dim": [dim] * dim, "place": list(range(dim)), "n": [n] * dim, "high": high, "low": low}, schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("place", pa.int32()), *((c, pa.int64()) for c in ("n", "high", "low"))])
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = vectors.mapInArrow(run, "dim int, place int, n long, high long, low long")
    rows = parts.groupBy("dim", "place").agg(F.sum("n").alias("n"), wide("high"), wide("low")).collect()
    out: dict[int, tuple] = {}
    for r in sorted(rows, key=lambda r: r.place):
        out[r.dim] = (r.n, (*out.get(r.dim, (0, ()))[1], int(r.high) * 2**32 + int(r.low)))
    return out


def _covariances(vectors: DataFrame, known: dict, multiplicity: bool) -> dict[int, np.ndarray]:
    """Per dimension the weighted covariance of x over the distinct vectors, centred before it is multiplied.

    Tasks emit a matrix row at a time, which are added up in a stream: no task holds more than one matrix.
    """

    def multiply(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, at, x in _matrices(batch.column("x")):
                if dim not in known:
                    continue
                n, sums = known[dim]
                c = (_centred(x, n, sums) / n).astype(np.float64)
                held[dim] = held.get(dim, 0.0) + c.T @ (_weights(batch, at, multiplicity)[:, None] * c)
        for dim, m in held.items():
            yield pa.RecordBatch.from_pydict({"dim": [dim] * len(m), "place": list(range(len(m))), "row": [r.tobytes() for r in m]}, schema=schema)

    def add(batches):
        key, held = None, None
        for batch in batches:
            for dim, place, row in zip(*(batch.column(c).to_pylist() for c in ("dim", "place", "row")), strict=True):
                if key == (dim, place):
                    held = held + np.frombuffer(row)
                else:
                    if key:
                        yield pa.RecordBatch.from_pydict({"dim": [key[0]], "place": [key[1]], "row": [held.tobytes()]}, schema=schema)
                    key, held = (dim, place), np.frombuffer(row)
        if key:
            yield pa.RecordBatch.from_pydict({"dim": [key[0]], "place": [key[1]], "row": [held.tobytes()]}, schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("place", pa.int32()), ("row", pa.binary())])
    parts = vectors.mapInArrow(multiply, "dim int, place int, row binary")
    rows = parts.repartition("dim", "place").sortWithinPartitions("dim", "place").mapInArrow(add, "dim int, place int, row binary").collect()
    held = lambda dim: sorted((r for r in rows if r.dim == dim), key=lambda r: r.place)
    return {dim: np.stack([np.frombuffer(r.row) for r in held(dim)]) / n for dim, (n, _) in known.items()}


def _fit(vectors: DataFrame, components: int, multiplicity: bool) -> dict[int, Space]:
    known = {d: k for d, k in _sums(vectors, multiplicity).items() if d}
    out = {}
    for dim, v in (_covariances(vectors, known, multiplicity) if known else {}).items():
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        n, sums = known[dim]
        trace = float(np.trace(v))
        out[dim] = Space(n, sums, np.ascontiguousarray(u[:, :components]), e[:components], e[:components] / trace if trace > 0 else np.zeros(min(dim, components)))
    return out


def _projected(vectors: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """x, copies, dim, n, deviation and the arrays whitened and explained of each distinct vector."""

    def run(batches):
        for batch in batches:
            for dim, at, x in _matrices(batch.column("x")):
                if dim not in spaces:
                    continue
                s = spaces[dim]
                d = _centred(x, s.n, s.sums)
                with np.errstate(all="ignore"):
                    out = ((d / s.n).astype(np.float64) @ s.basis) / np.sqrt(s.values)
                # a component without variance has no scale
                flat = s.values <= 1e-12 * max(s.values[0], 1e-300)
                white = [[None if f else v for f, v in zip(flat, row, strict=True)] for row in out.tolist()] if flat.any() else out.tolist()
                picked = batch.select(["x", "copies"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns, pa.array([dim] * len(at), pa.int32()), pa.array([s.n] * len(at), pa.int64()), pa.array(_squares(d), pa.int64()), pa.array(white, pa.list_(pa.float64())), pa.array([s.explained.tolist()] * len(at), pa.list_(pa.float64()))],
                    names=["x", "copies", "dim", "n", "deviation", "whitened", "explained"],
                )

    return vectors.mapInArrow(run, "x array<long>, copies long, dim int, n long, deviation long, whitened array<double>, explained array<double>")


def _identity_error(done: DataFrame, components: int, multiplicity: bool) -> float:
    """The largest distance of the whitened vectors' covariance from the identity, over components with variance; 0 without any."""
    w = F.col("copies") if multiplicity else F.lit(1)
    cell = lambda i: F.get("whitened", F.lit(i))
    mean = done.groupBy("dim").agg(*(F.sum(w * cell(i)) / F.sum(w) for i in range(components)), F.sum(w)).collect()
    worst = 0.0
    for dim, *means, total in mean:
        held = [i for i in range(components) if means[i] is not None]
        pairs = [(i, j) for i in held for j in held if i <= j]
        sums = [F.sum(w * (cell(i) - F.lit(means[i])) * (cell(j) - F.lit(means[j]))).alias(f"c{i}_{j}") for i, j in pairs]
        for (i, j), v in zip(pairs, done.where(F.col("dim") == dim).agg(*sums).first() if pairs else [], strict=True):
            worst = max(worst, abs(v / total - (i == j)))
    return worst


def whitened(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256, multiplicity: bool = False) -> DataFrame:
    """Rows per row of frame and leading component: key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry go; all others stay,
    rows of one key and null keys included. x is scale times each entry, rounded down. The
    fit list holds each distinct x once; n counts it, deviation is the sum over
    dimensions of (n * x - sums)^2, exact (null where a long can't hold it), explained a
    component's share of the variance. With multiplicity a vector weighs as
    often as rows have it, in n, the sums and the covariance. A component without variance (fewer distinct vectors
    than dimensions, constant dimensions) has null in whitened; identity_error, one value, leaves it
    out. Vectors of different lengths are spaces of their own, each with its fit; a vector without entries has no
    component. There are no more components than dimensions. Other columns are ignored; no rows give none.
    """
    rows = entries(frame.select(F.col(key), F.col(vector)), vector, scale)
    vectors = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    spaces = _fit(vectors, components, multiplicity)
    done = written(_projected(vectors, spaces), "whitened")
    error = _identity_error(done, components, multiplicity)
    total = vectors.agg(F.sum("copies")).first()[0] or 0
    # a vector of few rows is met by shuffling, one of many is broadcast
    often = F.col("copies") * HOT > total
    hot = done.where(often)
    met = rows.join(F.broadcast(hot), "x").unionByName(rows.join(F.broadcast(hot.select("x")), "x", "left_anti").join(done.where(~often), "x"))
    each = met.select(F.col(key), "n", "deviation", "explained", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(key, (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
