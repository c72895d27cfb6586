"""Surfaces and shapes inside volumes: connected parts, ray hits, nearest points, image likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): component is the smallest node that can be reached.

    Alternating star rounds: every node's larger neighbours, then its smaller ones, are
    hung on its smallest neighbour, until nothing changes. Neighbour lists are never
    collected; each round is an aggregate and a join, written to cut lineage.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while (state := _state(now)) != seen:
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def visible_parts(cells: DataFrame, width: int, height: int, depth: int) -> DataFrame:
    """(address, component) of cells (x, y, z, t) that touch by faces inside a frame; component is the smallest address.

    Each cell is sent to its own address and to the next one on each axis, so one shuffle
    of four rows a cell finds all touching pairs.
    """
    here = ((F.col("t") * depth + F.col("z")) * height + F.col("y")) * width + F.col("x")
    own = cells.select("x", "y", "z", here.cast("long").alias("node"))
    steps = [("x", width, 1), ("y", height, width), ("z", depth, width * height)]
    sent = F.array(F.struct(F.col("node").alias("at"), F.lit(True).alias("own")), *[F.when(F.col(a) < n - 1, F.struct((F.col("node") + s).alias("at"), F.lit(False).alias("own"))) for a, n, s in steps])
    met = own.select("node", F.explode(F.filter(sent, lambda s: s.isNotNull())).alias("s")).select("node", "s.at", "s.own")
    met = met.groupBy("at").agg(F.bool_or("own").alias("held"), F.collect_list(F.when(~F.col("own"), F.col("node"))).alias("from")).where("held")
    parts = connected(met.select(F.col("at").alias("a"), F.explode("from").alias("b")))
    return own.select("node").join(parts, "node", "left").select(F.col("node").alias("address"), F.coalesce("component", "node").alias("component"))


def first_hits(samples: DataFrame, keys: list[str], step: str, phi: str, halvings: int) -> DataFrame:
    """Where each ray first enters a level set: (keys, hit), samples being rows (keys, step, phi) along the rays.

    The first pair of neighbouring samples with phi > 0 and then phi <= 0 is halved so many times.
    """
    along = Window.partitionBy(*keys).orderBy(step)
    pairs = samples.select(*keys, F.col(step).alias("__s1"), F.col(phi).alias("__p1"), F.lag(step).over(along).alias("__s0"), F.lag(phi).over(along).alias("__p0"))
    crossing = pairs.where("__p0 > 0 and __p1 <= 0").groupBy(*keys).agg(F.min(F.struct("__s1", "__s0", "__p0", "__p1")).alias("c")).select(*keys, "c.*")
    middle = "(s.lo + s.hi) / 2"
    inside = f"__p0 + (__p1 - __p0) * ({middle}) > 0"
    halved = f"aggregate(sequence(1, {halvings}), named_struct('lo', 0e0, 'hi', 1e0), (s, i) -> named_struct('lo', if({inside}, {middle}, s.lo), 'hi', if({inside}, s.hi, {middle})), s -> {middle})"
    return crossing.select(*keys, F.expr(f"__s0 + (__s1 - __s0) * {halved}").alias("hit"))


def nearest(points: DataFrame, targets: DataFrame, key: str, extent: int) -> DataFrame:
    """The squared distance d2 of each point (key, id, x, y, z) to its nearest target (key, x, y, z) of the same key.

    Points look into the 27 blocks around them, of size 2, then 4, and so on; one whose
    best distance is within the block size is done, as all other targets are farther off. So near
    points cost little, and only lonely ones look into wide, sparse blocks. Points
    without any target of their key are left out. Spark takes points times 27 blocks for as few as the points
    themselves, so it is told not to broadcast them.
    """
    open_, done, size = points.join(targets.select(key).distinct(), key, "left_semi"), None, 2
    while True:
        block = lambda a: F.floor(F.col(a) / float(size)).cast("long")  # noqa: E731, B023
        around = F.sequence(F.lit(-1), F.lit(1))
        spread = open_.select(key, "id", "x", "y", "z", *[block(a).alias(f"b{a}") for a in "xyz"])
        for a in "xyz":
            spread = spread.withColumn("d", F.explode(around)).withColumn(f"b{a}", F.col(f"b{a}") + F.col("d")).drop("d")
        aims = targets.select(F.col(key), *[F.col(a).alias(f"{a}_") for a in "xyz"], *[block(a).alias(f"b{a}") for a in "xyz"])
        gap = sum((F.col(a) - F.col(f"{a}_")) * (F.col(a) - F.col(f"{a}_")) for a in "xyz")
        best = spread.hint("merge").join(aims, [key, "bx", "by", "bz"]).groupBy(key, "id").agg(F.min(gap).alias("d2"))
        found = written(open_.join(best, [key, "id"], "left"), "nearest")
        last = size >= extent
        settled = found.where(F.col("d2").isNotNull() if last else F.col("d2") <= size * size).select(key, "id", "d2")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        open_, size = found.where(f"d2 is null or d2 > {size * size}").drop("d2"), size * 2
        if open_.isEmpty():
            return done


def image_likeness(pixels: DataFrame, key: str, block: int, peak: float) -> DataFrame:
    """Mean structural similarity over blocks of pixels (key, px, py, a, b), by key, with MSE and errors.

    The constants are the usual (0.01 peak)**2 and (0.03 peak)**2.
    """
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    blocks = pixels.groupBy(key, F.floor(F.col("px") / float(block)).alias("bx"), F.floor(F.col("py") / float(block)).alias("by")).agg(
        F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.covar_pop("a", "b").alias("cov"),
        F.count(F.lit(1)).alias("n"), F.sum(F.expr("(a - b) * (a - b)")).alias("sse"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("sae"), F.max(F.abs(F.col("a") - F.col("b"))).alias("top"),
    )
    ssim = F.expr(f"(2 * ma * mb + {c1}D) * (2 * cov + {c2}D) / ((ma * ma + mb * mb + {c1}D) * (va + vb + {c2}D))")
    n = F.sum("n")
    return blocks.groupBy(key).agg(n.alias("n"), (F.sum("sse") / n).alias("mse"), (F.sum("sae") / n).alias("mae"), F.max("top").alias("max_ae"), F.avg(ssim).alias("ssim"))
