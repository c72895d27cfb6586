"""Volumes as tables: cells (x, y, z, t, v), addresses, leaves, crops and dense expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = 8


#: Orders of one slab of eight z-planes: the volume's depth, and with it its leaves, grow with the orders.
SLAB = 8192
#: What the depth stays below.
DEEPEST = 8 << 20


def slab_z(order_key: str) -> Column:
    """The z of an order: its place in a slab of eight planes, slabs following each other with the keys."""
    return F.expr(f"{order_key} % 8 + 8 * ({order_key} div {SLAB})").cast("long")


def field_cells(lineitem: DataFrame) -> DataFrame:
    """A sparse volume of 32 x 32 cells a plane and 16 frames: mean quantity by part, supplier, order and month, part, supplier and month modulo their axes."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")) % 16
    return lineitem.groupBy((F.col("l_partkey") % 32).alias("x"), (F.col("l_suppkey") % 32).alias("y"), slab_z("l_orderkey").alias("z"), month.cast("long").alias("t")).agg(F.avg("l_quantity").alias("v"))


def leaf_cells(lineitem: DataFrame, leaf: Column) -> DataFrame:
    """field_cells with leaf_id and voxel, laid out by leaf in one shuffle of the rows: what is grouped by leaf and more afterwards stays where it is."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")) % 16
    rows = lineitem.select((F.col("l_partkey") % 32).alias("x"), (F.col("l_suppkey") % 32).alias("y"), slab_z("l_orderkey").alias("z"), month.cast("long").alias("t"), F.col("l_quantity").alias("v"))
    return rows.withColumn("leaf_id", leaf).repartition("leaf_id").groupBy("leaf_id", "x", "y", "z", "t").agg(F.avg("v").alias("v")).withColumn("voxel", local_voxel())


def event_series(events: DataFrame) -> DataFrame:
    """Per user and day of month (from 0) the sum of values in whole cents."""
    return events.groupBy("user_id", (F.day("ts") - 1).cast("long").alias("t")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def block(axis: str) -> Column:
    return F.expr(f"cast(floor({axis} / {LEAF}.0) as bigint)")


def leaf_id(width: int, height: int, depth: int) -> Column:
    """Leaf index of a cell, block coordinates clamped to the grid."""
    lx, ly, lz = (-(-n // LEAF) for n in (width, height, depth))
    bx, by, bz = (F.greatest(F.lit(0), F.least(F.lit(n - 1), block(a))) for a, n in (("x", lx), ("y", ly), ("z", lz)))
    return ((bz * ly + by) * lx + bx).cast("long")


def local_voxel() -> Column:
    """Index inside a leaf; its stride is 8 on cropped edge leaves too."""
    return ((F.col("z") % LEAF * LEAF + F.col("y") % LEAF) * LEAF + F.col("x") % LEAF).cast("long")


def cropped(cells: DataFrame, low: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """The cells of a box, moved so that its corner is the origin."""
    if min(size) <= 0 or min(low) < 0:
        raise ValueError("crop is out of bounds")
    inside = cells
    for axis, a, n in zip("xyz", low, size, strict=True):
        inside = inside.where(F.col(axis).between(a, a + n - 1))
    return inside.withColumns({axis: F.col(axis) - a for axis, a in zip("xyz", low, strict=True)})


def leaf_range(cells: DataFrame, x: tuple[int, int], y: tuple[int, int], z: tuple[int, int], width: int, height: int) -> DataFrame:
    """Cells (with leaf_id) of a coordinate range; the leaf ids it touches are filtered first, so a table partitioned by leaf is pruned."""
    lx, ly = -(-width // LEAF), -(-height // LEAF)
    touched = [(c * ly + b) * lx + a for c in range(z[0] // LEAF, z[1] // LEAF + 1) for b in range(y[0] // LEAF, y[1] // LEAF + 1) for a in range(x[0] // LEAF, x[1] // LEAF + 1)]
    return cells.where(F.col("leaf_id").isin(touched) & F.col("x").between(*x) & F.col("y").between(*y) & F.col("z").between(*z))


def dense_frames(cells: DataFrame, frames: int) -> DataFrame:
    """Per voxel (x, y, z) that has cells its whole series as an array; missing frames are 0."""
    held = cells.groupBy("x", "y", "z").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))
    times = F.sequence(F.lit(0), F.lit(frames - 1))
    return held.select("x", "y", "z", F.transform(times, lambda t: F.coalesce(F.element_at("m", t.cast("long")), F.lit(0.0))).alias("series"))


def filled(cells: DataFrame, frames: int) -> DataFrame:
    """dense_frames as rows (x, y, z, t, v)."""
    return dense_frames(cells, frames).select("x", "y", "z", F.posexplode("series").alias("t", "v")).withColumn("t", F.col("t").cast("long"))


def aligned(layers: dict[str, DataFrame], first: str) -> DataFrame:
    """Fields (x, y, z, t and a column of their name) side by side at the first one's cells, with aligned: whether all have as many frames as it."""
    frames = None
    for name, cells in layers.items():
        n = cells.agg(F.countDistinct("t").alias(f"frames_{name}")).withColumn("one", F.lit(1))
        frames = n if frames is None else frames.join(n, "one")
    out = layers[first]
    for name, cells in layers.items():
        if name != first:
            out = out.join(cells, ["x", "y", "z", "t"], "left")
    # one row is broadcast
    out = out.withColumn("one", F.lit(1)).join(F.broadcast(frames), "one")
    same = F.lit(True)
    for name in layers:
        same = same & (F.col(f"frames_{name}") == F.col(f"frames_{first}"))
    return out.withColumn("aligned", same).drop("one", *[f"frames_{n}" for n in layers])
