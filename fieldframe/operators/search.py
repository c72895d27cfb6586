"""Searches over coding parameters: a calibration grid evaluated in one scan, and a policy narrowed round by round."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import metrics

# fixed values of the calibration grid: multipliers of the present settings, and seeds
ABS_FACTORS = (0.5, 0.75, 1.0, 1.5, 2.0)
REL_SEEDS = (0.0, 0.01, 0.02)
GAMMA_SEEDS = (0.0, 0.2)
CLUSTER_FACTORS = (0.5, 0.75, 1.0, 1.5, 2.0)
LEGACY_ABS, LEGACY_CLUSTER = 6.0 / 255.0, 8.0 / 6.0
LEAST_ABS, LEAST_CLUSTER, SAME = 1e-6, 0.1, 1e-6
#: Bins of the error histogram that a candidate's 99th percentile is read from, over errors up to the data's range.
BINS = 64
#: Bytes of a leaf's frame mean, of an event, and of a leaf's head.
FRAME_BYTES, EVENT_BYTES, LEAF_BYTES = 2, 3, 4


@dataclass(frozen=True)
class Setting:
    """Tolerances (absolute, relative, tightened by gamma where a series changes) and the error, in tolerances, up to which a leaf goes without events."""

    eps_abs: float
    eps_rel: float
    gamma: float
    cluster: float


def calibration_grid(span: float, now: Setting) -> list[Setting]:
    """The present setting, the older one by the data's range, and the grid around the present one; settings within 1e-6 of an earlier one go."""
    wanted = [now, Setting(span * LEGACY_ABS, now.eps_rel, now.gamma, LEGACY_CLUSTER)]
    wanted += [Setting(max(LEAST_ABS, now.eps_abs * a), r, g, max(LEAST_CLUSTER, now.cluster * c)) for a in ABS_FACTORS for r in REL_SEEDS for g in GAMMA_SEEDS for c in CLUSTER_FACTORS]
    out: list[Setting] = []
    for s in wanted:
        if all(max(abs(getattr(s, f) - getattr(o, f)) for f in ("eps_abs", "eps_rel", "gamma", "cluster")) >= SAME for o in out):
            out.append(s)
    return out


def _table(spark: SparkSession, settings: list[Setting]) -> DataFrame:
    """(place, tolerance, eps_abs, eps_rel, gamma, cluster): tolerance numbers the settings that differ in cluster only alike."""
    kinds = {k: i for i, k in enumerate(dict.fromkeys((s.eps_abs, s.eps_rel, s.gamma) for s in settings))}
    rows = [(i, kinds[s.eps_abs, s.eps_rel, s.gamma], s.eps_abs, s.eps_rel, s.gamma, s.cluster) for i, s in enumerate(settings)]
    return spark.createDataFrame(rows, "place int, tolerance int, eps_abs double, eps_rel double, gamma double, cluster double")


def calibrated(cells: DataFrame, settings: list[Setting], span: float) -> DataFrame:
    """What each setting costs over all leaves: place and its numbers, bytes, events, uniform (leaves without events), mean, rmse, max, p99 (upper edge of its bin), psnr.

    Cells are (leaf_id, t, v, p, delta): value, prediction and how much the series has
    changed. The tolerance of a cell is (eps_abs + eps_rel |v|) / (1 + gamma delta). A leaf whose errors all are
    within cluster tolerances keeps the prediction; elsewhere an error beyond its
    tolerance is an event, kept in steps of two tolerances. One scan of the cells serves
    all settings: each cell meets the settings of other tolerances in memory and is
    summed by leaf, tolerance, kind of error and bin; cluster thresholds only choose among those sums. Cells that
    are laid out by leaf (fields.leaf_cells) are shuffled no more.
    """
    spark = cells.sparkSession
    table = _table(spark, settings)
    kinds = {k: i for i, k in enumerate(dict.fromkeys((s.eps_abs, s.eps_rel, s.gamma) for s in settings))}
    each_kind = F.array(*[F.struct(F.lit(i).alias("tolerance"), *[F.lit(float(x)).alias(c) for c, x in zip(("eps_abs", "eps_rel", "gamma"), k, strict=True)]) for k, i in kinds.items()])
    met = cells.withColumn("frames", F.size(F.collect_set("t").over(Window.partitionBy("leaf_id")))).select("leaf_id", "frames", "v", F.round(F.expr("v - p"), 9).alias("r"), "delta", F.explode(each_kind).alias("s")).select("leaf_id", "frames", "v", "r", "delta", "s.*")
    met = met.withColumn("e", F.greatest(F.lit(LEAST_ABS), F.expr("(eps_abs + eps_rel * abs(v)) / (1 + gamma * delta)"))).withColumn("event", F.expr("abs(r) > e"))
    coded = F.expr("if(event, abs(r - sign(r) * floor(abs(r) / (2 * e) + 0.5) * 2 * e), abs(r))")
    two = F.explode(F.array(F.struct(F.lit("plain").alias("kind"), F.abs("r").alias("err"), F.lit(0).alias("events")), F.struct(F.lit("coded").alias("kind"), coded.alias("err"), F.col("event").cast("int").alias("events"))))
    each = met.select("leaf_id", "frames", "tolerance", (F.abs("r") / F.col("e")).alias("ratio"), two.alias("s")).select("leaf_id", "frames", "tolerance", "ratio", "s.*")
    binned = F.least(F.lit(BINS - 1), F.floor(F.col("err") / span * BINS)).cast("int").alias("bin")
    sums = each.groupBy("leaf_id", "tolerance", "kind", binned).agg(
        F.count(F.lit(1)).alias("n"), F.sum("events").alias("events"), F.sum("err").alias("sum"), F.sum(F.expr("err * err")).alias("sse"), F.max("err").alias("max"), F.max("ratio").alias("ratio"), F.max("frames").alias("frames")
    )
    # which kind of error counts follows from a leaf's sums, so they stay where they are; settings only add up bins
    leaf = Window.partitionBy("leaf_id", "tolerance")
    sums = sums.withColumns({"worst": F.max("ratio").over(leaf), "once": F.row_number().over(leaf.orderBy("kind", "bin")) == 1})
    clusters = F.create_map(*[x for k, i in kinds.items() for x in (F.lit(i), F.array(*[F.struct(F.lit(place).alias("place"), F.lit(float(s.cluster)).alias("cluster")) for place, s in enumerate(settings) if (s.eps_abs, s.eps_rel, s.gamma) == k]))])
    chosen = sums.withColumn("s", F.explode(F.element_at(clusters, F.col("tolerance")))).select("*", "s.place", F.expr("worst <= s.cluster").alias("plain")).withColumn("counts", (F.col("kind") == "plain") == F.col("plain"))
    mine = lambda c: F.when(F.col("counts"), F.col(c))
    heads = {"head": F.sum(F.when(F.col("once"), LEAF_BYTES + FRAME_BYTES * F.col("frames"))), "uniform": F.count_if(F.col("once") & F.col("plain"))}
    bins = chosen.groupBy("place", "bin").agg(*[F.sum(mine(c)).alias(c) for c in ("n", "events", "sum", "sse")], F.max(mine("max")).alias("max"), *[x.alias(c) for c, x in heads.items()])
    counted = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("bin", "n"))))
    whole = bins.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("n", "events", "sum", "sse", "head", "uniform")], F.max("max").alias("max"), counted.alias("bins"))
    # at most BINS counts a setting
    reached = F.expr("aggregate(bins, named_struct('run', 0L, 'bin', -1), (s, b) -> named_struct('run', s.run + b.n, 'bin', if(s.bin < 0 and s.run + b.n >= ceil(0.99D * n), b.bin, s.bin))).bin")
    out = whole.select(
        "place", (F.col("head") + EVENT_BYTES * F.col("events")).alias("bytes"), "events", "uniform", F.expr("sum / n").alias("mean"), F.expr("sqrt(sse / n)").alias("rmse"), "max", ((reached + 1) * span / BINS).alias("p99")
    )
    return out.withColumn("psnr", metrics.psnr(F.col("rmse"), F.lit(max(1e-6, span)))).join(F.broadcast(table.drop("tolerance")), "place")


def policy_rounds(leaves: DataFrame, peak: float, target: float, most_rounds: int = 40) -> DataFrame:
    """Rounds of a search for how many of the worst leaves get residuals: (round, k, step, bytes, psnr, chosen).

    leaves are (place, n, sse_plain, sse_coded, bytes), place from 1 in the order of falling error. A round
    tries the k of the last choice, a step fewer and a step more (0 to all); it takes the fewest bytes among those that reach
    the target PSNR, else the highest PSNR, the fewer leaves of equals. The first step is a
    quarter of the leaves; it halves each round, and the search stops after a step of one has changed nothing. Each round is one aggregate of the leaves for its three candidates.
    """
    spark = leaves.sparkSession
    total = leaves.count()
    k, step, rounds = total // 2, max(1, total // 4), []
    for number in range(1, most_rounds + 1):
        tried = sorted({min(total, max(0, k + d * step)) for d in (-1, 0, 1)})
        sums = []
        for i, c in enumerate(tried):
            inside = F.col("place") <= c
            sums += [F.sum(F.when(inside, F.col("sse_coded")).otherwise(F.col("sse_plain"))).alias(f"sse{i}"), F.sum(F.when(inside, F.col("bytes")).otherwise(0)).alias(f"bytes{i}")]
        row = leaves.agg(F.sum("n").alias("n"), *sums).first()
        found = []
        for i, c in enumerate(tried):
            found.append((c, int(row[f"bytes{i}"] or 0), _psnr((row[f"sse{i}"] or 0.0) / max(1, row["n"] or 0), peak)))
        good = [f for f in found if f[2] >= target]
        best = min(good, key=lambda f: (f[1], f[0])) if good else min(found, key=lambda f: (-f[2], f[0]))
        rounds += [(number, c, step, b, p, c == best[0]) for c, b, p in found]
        still = best[0] == k
        k = best[0]
        if step == 1 and still:
            break
        step = max(1, step // 2)
    return spark.createDataFrame(rounds, "round int, k long, step long, bytes long, psnr double, chosen boolean")


def _psnr(mean_square: float, peak: float) -> float:
    from math import log10, sqrt

    return 120.0 if mean_square <= 0 else 20 * log10(max(peak, 1e-12) / sqrt(mean_square))
