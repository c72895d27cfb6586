"""Error metrics between truth v and prediction p, percentile variants and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def psnr(rmse: Column, peak: Column) -> Column:
    """20 log10(peak / rmse); 120 where there is no error."""
    return F.when(rmse <= 0, 120.0).otherwise(20 * F.log10(F.greatest(peak, F.lit(1e-12)) / F.greatest(rmse, F.lit(1e-300))))


def psnr_or_infinite(rmse: Column, peak: Column) -> Column:
    """The older rule: infinite at 1e-10 or less."""
    return F.when(rmse <= 1e-10, float("inf")).otherwise(20 * F.log10(peak / rmse))


def error_stats(pairs: DataFrame, *keys: str) -> DataFrame:
    """n, mean, rmse, max, sse and PSNR of v against p, by keys: one partial and one final aggregate."""
    e = F.abs(F.col("v") - F.col("p"))
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_abs"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(e).alias("max_abs"), F.sum(e * e).alias("sse"), F.max("v").alias("peak")
    )
    return out.withColumn("psnr", psnr(F.col("rmse"), F.col("peak")))


def floor_percentile(values: DataFrame, key: str, value: str, numerator: int, denominator: int, last: bool = False) -> DataFrame:
    """The value at sorted place floor(n * a / b), at most n - 1; with last, at floor((n - 1) * a / b). By key; ties are equal values."""
    place, held = Window.partitionBy(key).orderBy(value), Window.partitionBy(key)
    ranked = values.select(key, value, (F.row_number().over(place) - 1).alias("rank_at"), F.count(F.lit(1)).over(held).alias("rank_of"))
    top = F.col("rank_of") - 1
    want = F.floor(top * numerator / F.lit(float(denominator))) if last else F.least(top, F.floor(F.col("rank_of") * numerator / F.lit(float(denominator))))
    return ranked.where(F.col("rank_at") == want).select(key, F.col(value).alias("percentile"))


#: Bins of a first histogram, and values that one bin's task may sort.
BINS, SORTED = 262_144, 1 << 20


def order_statistics(values: DataFrame, key: str, value: str, ranks: dict[str, Column], bins: int = BINS, most: int = SORTED) -> DataFrame:
    """key, n and for each name the value at that rank (from 1, an expression of n) among its key's: exact for any number of rows, and no key's rows meet in one task.

    A histogram between a key's least and largest value, merged from partial counts, tells
    the bin that holds each rank; only the rows of these bins are looked at again. A bin with more
    than `most` rows of different values is cut by a histogram of its own. Null values don't count; keys must not be null.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    sizes = stats.select("k", "n")
    open_ = stats.select("k", "lo", "hi", F.lit(0).cast("long").alias("base"), F.col("n").alias("held"), wanted.alias("wanted"))
    found = None
    while True:
        inside = rows.join(open_.select("k", "lo", "hi"), "k").where("v between lo and hi")
        place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (bins - 1))).otherwise(0).cast("long")
        counts = inside.groupBy("k", "lo", place.alias("bin")).agg(F.count(F.lit(1)).alias("held"), F.min("v").alias("least"), F.max("v").alias("largest"))
        up_to = F.sum("held").over(Window.partitionBy("k", "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        bounds = counts.withColumn("up_to", up_to).join(open_.select("k", "lo", "base", "wanted"), ["k", "lo"]).withColumn("before", F.expr("base + up_to - held"))
        mine = F.expr("filter(wanted, w -> w.rank > before and w.rank <= before + held)")
        hit = written(bounds.select("k", F.col("least").alias("lo"), F.col("largest").alias("hi"), F.col("before").alias("base"), "held", mine.alias("wanted")).where("size(wanted) > 0"), "bins")
        flat = hit.where("lo = hi").select("k", F.explode("wanted").alias("w"), F.col("lo").alias("v"))
        few = hit.where(f"lo < hi and held <= {most}")
        each = rows.join(few.select("k", "lo", "hi"), "k").where("v between lo and hi").groupBy("k", "lo", "v").agg(F.count(F.lit(1)).alias("same"))
        run = F.sum("same").over(Window.partitionBy("k", "lo").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        sorted_ = each.withColumn("run", run).join(few.select("k", "lo", "base", "wanted"), ["k", "lo"])
        picked = sorted_.select("k", F.explode(F.expr("filter(wanted, w -> w.rank > base + run - same and w.rank <= base + run)")).alias("w"), "v")
        found = flat.unionByName(picked) if found is None else found.unionByName(flat).unionByName(picked)
        open_ = hit.where(f"lo < hi and held > {most}")
        if open_.isEmpty():
            break
    wide = found.groupBy("k").agg(*[F.max(F.when(F.col("w.name") == name, F.col("v"))).alias(name) for name in ranks])
    return sizes.join(wide, "k").withColumnRenamed("k", key)


def floor_percentiles(values: DataFrame, key: str, value: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """key, n and for each name the value at sorted place floor(n * a / b), at most n - 1: all places from one histogram."""
    n = F.col("n")
    return order_statistics(values, key, value, {name: F.least(n - 1, F.floor(n * a / F.lit(float(b)))) + 1 for name, (a, b) in shares.items()})


def linear_percentiles(values: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key, n and for each name the percentile on the line between the two values around place (n - 1) * share."""
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = {f"{name}_{side}": F.least(F.col("n"), F.floor(at(q)) + 1 + side) for name, q in shares.items() for side in (0, 1)}
    two = order_statistics(values, key, value, ranks)
    return two.select(key, "n", *[(F.col(f"{name}_0") + (at(q) - F.floor(at(q))) * (F.col(f"{name}_1") - F.col(f"{name}_0"))).alias(name) for name, q in shares.items()])


def histogram_tail(values: DataFrame, value: str, bins: int, share: float) -> DataFrame:
    """Upper edge of the bin where the cumulated count reaches ceil(share * n): a percentile of any number of rows from a histogram of bounded size."""
    stats = values.agg(F.max(value).alias("top"), F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    # one row is broadcast
    held = values.withColumn("one", F.lit(1)).join(F.broadcast(stats), "one")
    binned = held.select("top", "n", F.when(F.col("top") > 0, F.floor(F.col(value) / F.col("top") * (bins - 1))).otherwise(0).cast("long").alias("bin"))
    counts = binned.groupBy("bin", "top", "n").agg(F.count(F.lit(1)).alias("held"))
    run = F.sum("held").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("run", run).where(F.col("run") >= F.ceil(F.col("n") * F.lit(share)))
    found = reached.groupBy("n", "top").agg(F.min("bin").alias("bin"))
    return found.select("n", "bin", ((F.col("bin") + 1) / (bins - 1) * F.col("top")).alias("edge"))
