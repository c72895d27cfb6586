"""Operator 1, MinHash near-dedup by HyperMinHash.

A document's sketch has 256 buckets. A shingle's 64-bit hash names a bucket by its top
8 bits; the bucket keeps, of the smallest remaining 56-bit value, the number of leading
zeros and the 10 bits after the first one: a 16-bit register. A bucket without shingles
borrows from the first filled bucket in a fixed order of its own. Bands of 5 registers
propose pairs, a collision-corrected estimate from the registers thins them, and the
full shingle sets confirm them.

With 51 bands of 5, a pair at similarity 0.8 shares no band with probability
(1 - 0.8**5)**51, about 2e-9.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U, mix, written
from .components import components

BUCKETS, ROWS, MANTISSA = 256, 5, 10
BANDS = BUCKETS // ROWS
#: How far below the threshold an estimate may lie (over 8 standard deviations of 256 registers).
SLACK = 0.22
#: A shingle is rare if so many of the documents still in question have it at most.
RARE = 5
#: Shingles that more documents have are told apart before shingles are shuffled.
FREQUENT = 1000
#: A band's bucket of more pairs is split into parts of about so many.
PART_PAIRS = 1_000_000
#: Shingles are counted by hash in so many cells to bound what two sets can have in common.
CELLS = 256
#: Stands for a null doc_id inside pandas, which would turn a column with nulls into floats.
NO_ID = -(2**63)



@dataclass(frozen=True)
class Sketch:
    """A way to sketch sets: make(hashes, starts) gives a row of width 16-bit values a set; rows values make a band."""

    make: Callable[[np.ndarray, np.ndarray], np.ndarray]
    width: int
    rows: int
    #: The chance that values are equal though what they stand for differs, for sets of two sizes.
    collide: Callable[[np.ndarray, np.ndarray], np.ndarray]


_order = np.argsort(np.random.default_rng(7).random((BUCKETS, BUCKETS)), axis=0)


def registers(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of each set of sorted hashes; sets without hashes get zeros."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    cell = doc * BUCKETS + (h >> U(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, dtype=np.int64)
    value = h[first] & U(2**56 - 1)
    top = value >> U(8)  # 48 bits: exact in double precision
    zeros = 48 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
    shifted = top << np.minimum(zeros + 16, 63).astype(np.uint64)
    code = (zeros.astype(np.uint64) << U(MANTISSA)) | ((shifted << U(1)) >> U(64 - MANTISSA))
    table = np.zeros(n * BUCKETS, dtype=np.uint16)
    filled = np.zeros(n * BUCKETS, dtype=bool)
    table[cell[first]] = code.astype(np.uint16)
    filled[cell[first]] = True
    some = np.repeat(np.diff(at) > 0, BUCKETS)
    empty = np.flatnonzero(~filled & some)
    source = table.copy()
    for attempt in range(BUCKETS):
        if not len(empty):
            break
        base, bucket = empty // BUCKETS * BUCKETS, empty % BUCKETS
        take = base + _order[attempt, bucket]
        ok = filled[take]
        table[empty[ok]] = source[take[ok]]
        empty = empty[~ok]
    return table.reshape(n, BUCKETS)


def sketches(docs: DataFrame, k: int, sketch: Sketch) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, two order-free sums that stand for the whole set, and the registers."""

    def run(batches):
        for pdf in batches:
            for i, j in common.in_pieces(pdf, ["text"]):
                part = pdf.iloc[i:j]
                h, at = common.shingles(part["text"], k)
                reg = sketch.make(h, at)
                with np.errstate(over="ignore"):
                    sums = []
                    for seed in (U(0x51ED27), U(0xA24BAED4963EE407)):
                        run_sum = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(h ^ seed))))
                        sums.append((run_sum[at[1:]] - run_sum[at[:-1]]).view(np.int64))
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"].to_numpy(), "text_hash": part["text_hash"].to_numpy(), "n_shingles": np.diff(at), "s1": sums[0], "s2": sums[1], "regs": [r.tobytes() for r in reg]}
                )

    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    made = given.mapInPandas(run, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, regs binary")
    return made.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint16).reshape(-1, width)


def bands(sketched: DataFrame, sketch: Sketch) -> DataFrame:
    """One row (band, doc_id, n_shingles) for each of the bands of a document's compressed registers."""

    rows, n_bands = sketch.rows, sketch.width // sketch.rows

    def run(batches):
        seeds = mix(np.arange(1, n_bands + 1, dtype=np.uint64))
        for pdf in batches:
            reg = _matrix(pdf["regs"], sketch.width)[:, : n_bands * rows].reshape(-1, n_bands, rows).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(seeds, reg.shape[:2]).copy()
                for i in range(rows):
                    key = mix(key * U(0x9E3779B97F4A7C15) + reg[:, :, i])
            yield pd.DataFrame(
                {"band": key.reshape(-1).view(np.int64), "doc_id": np.repeat(pdf["doc_id"].to_numpy(), n_bands), "n": np.repeat(pdf["n_shingles"].to_numpy(), n_bands)}
            )

    return sketched.select("doc_id", "n_shingles", "regs").mapInPandas(run, "band long, doc_id long, n long")


def collision_rate(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The chance that a bucket's registers are equal though its smallest values differ, for sets of these sizes."""
    i = np.arange(0, 57)
    low, high = 0.5 ** (i + 1), 0.5**i

    def shares(n):
        # a borrowed bucket holds one set's smallest value too, so a bucket has one value at least
        per = np.maximum(n / BUCKETS, 1.0)[:, None]
        return (1 - low) ** per - (1 - high) ** per

    return (shares(n_a) * shares(n_b)).sum(axis=1) / 2**MANTISSA


HYPERMINHASH = Sketch(registers, BUCKETS, ROWS, collision_rate)


def estimate(reg_a: np.ndarray, reg_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, sketch: Sketch = HYPERMINHASH) -> np.ndarray:
    """Jaccard similarity from registers, less the matches that chance collisions make."""
    same, c = (reg_a == reg_b).mean(axis=1), sketch.collide(n_a, n_b)
    return np.clip((same - c) / (1 - c), 0, 1)


def _confirmed(pairs: DataFrame, sketched: DataFrame, texts: DataFrame, k: int, percent: int, sketch: Sketch) -> DataFrame:
    """Of candidate pairs (a, b), those whose full sets are alike enough."""

    def side(table, name, column):
        return table.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in column])

    def thin(batches):
        for pdf in batches:
            if len(pdf):
                reg_a, reg_b = _matrix(pdf["regs_a"], sketch.width), _matrix(pdf["regs_b"], sketch.width)
                likely = estimate(reg_a, reg_b, pdf["n_shingles_a"].to_numpy(float), pdf["n_shingles_b"].to_numpy(float), sketch)
                yield pdf.loc[likely >= percent / 100 - SLACK, ["a", "b"]]

    def verify(batches):
        for pdf in batches:
            for i, j in common.in_pieces(pdf, ["text_a", "text_b"]):
                part = pdf.iloc[i:j]
                both, union = common.jaccard_of_texts(part["text_a"], part["text_b"], k)
                yield part.loc[(100 * both >= percent * union) & (union > 0), ["a", "b"]]

    held = pairs.join(side(sketched, "a", ["regs", "n_shingles"]), "a").join(side(sketched, "b", ["regs", "n_shingles"]), "b")
    likely = held.mapInPandas(thin, "a long, b long")
    read = likely.join(side(texts, "a", ["text"]), "a").join(side(texts, "b", ["text"]), "b")
    return written(read.select("a", "b", "text_a", "text_b").mapInPandas(verify, "a long, b long").distinct(), "links")


def _rarities(texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of documents (doc_id, text, n, component): how many rare shingles each has, and the pairs that share one across components.

    A shingle is rare if at most RARE of these documents have it, so it makes a few pairs at most.
    """

    def run(batches):
        for pdf in batches:
            for i, j in common.in_pieces(pdf, ["text"]):
                part = pdf.iloc[i:j]
                h, at = common.shingles(part["text"], k)
                size = np.diff(at)
                yield pd.DataFrame({"h": h.view(np.int64)} | {c: np.repeat(part[c].to_numpy(), size) for c in ("doc_id", "n", "component")})

    held = written(texts.select("doc_id", "text", "n", "component").mapInPandas(run, "h long, doc_id long, n long, component long"), "shingles")
    counted = held.groupBy("h").agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    counted = written(counted.where(f"held <= {RARE} or held > {FREQUENT}"), "rare")
    # shingles of very many documents leave before the shuffle: there is one of them for FREQUENT rows at most
    rest = held.join(counted.where(f"held > {FREQUENT}").select("h"), "h", "left_anti")
    rare = rest.join(counted.where(f"held <= {RARE}").select("h", "lo", "hi"), "h")
    few = rare.groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    lists = rare.where("lo < hi").groupBy("h").agg(F.collect_list(F.struct("doc_id", "n", "component")).alias("l"))
    pairs = F.expr(
        "filter(flatten(transform(l, x -> transform(l, y -> struct(x.doc_id as a, y.doc_id as b, x.component as p, y.component as q, x.n as m, y.n as n)))),"
        f" z -> z.a < z.b and z.p <> z.q and 100 * least(z.m, z.n) >= {percent} * greatest(z.m, z.n))"
    )
    return few, lists.select(F.explode(pairs).alias("z")).select("z.a", "z.b").distinct()


def _profiles(texts: DataFrame, k: int) -> DataFrame:
    """doc_id, cells: how many of a document's shingles fall into each of CELLS cells by hash.

    Two sets have at most the sum of the cells' smaller counts in common, whatever the cells.
    """

    def run(batches):
        for pdf in batches:
            for i, j in common.in_pieces(pdf, ["text"]):
                part = pdf.iloc[i:j]
                h, at = common.shingles(part["text"], k)
                cell = np.repeat(np.arange(j - i), np.diff(at)) * CELLS + (mix(h) % U(CELLS)).astype(np.int64)
                counts = np.bincount(cell, minlength=(j - i) * CELLS).astype(np.int32).reshape(-1, CELLS)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "cells": list(counts)})

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id long, cells array<int>")


def _heads(members: DataFrame) -> DataFrame:
    """band, head, head_n: of each band's members (band, doc_id, n, size) the most central one, of equal ones that with the largest doc_id, whatever the order of rows."""
    central = members.groupBy("doc_id").agg(F.sum("size").alias("central"))
    first = F.struct("central", "doc_id")
    return members.join(central, "doc_id").groupBy("band").agg(F.max_by("doc_id", first).alias("head"), F.max_by("n", first).alias("head_n"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, sketch: Sketch = HYPERMINHASH) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, n_copies.

    Documents with 100 * intersection >= percent * union of their sets of k-word shingles
    are linked; component_id is the smallest doc_id reachable, itself included, and kept
    says whether that is the row's own.

    Equal sets are one class (n_copies rows have it) with a number of its own, and only
    classes are compared. In each band's bucket all classes are first paired with the
    most central one; buckets that then still hold several components pair their smaller
    components with all others of like size, less the pairs that cannot be alike for want
    of common shingles: pairs sharing a rare shingle are listed from it, for the others the
    rare ones that each has, and its shingles counted by hash, bound the intersection. So
    a group of n near copies costs about n comparisons, and no proposed link between
    different components goes untested. Buckets of very many such pairs are split.

    A null or blank text has no shingles and is linked with nothing. A row without
    doc_id is kept, its component_id is null. Rows with one doc_id are one document,
    whatever their texts: their classes are linked. Other columns are ignored. An empty
    table gives no rows.
    """
    sketched = written(sketches(docs, k, sketch), "sketches")
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    key = ["s1", "s2", "n_shingles"]
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.count(F.lit(1)).alias("n_copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    own_row = ["doc_id", "text_hash", *key]
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "text_hash", *key, "node"), own_row).dropDuplicates([*own_row, "node"])
    # from here on a class goes by its number in the column doc_id
    reps = written(reps.select(F.col("node").alias("doc_id"), "n_shingles", "regs"), "reps")

    banded = bands(reps, sketch)
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    members = written(banded.join(shared.select("band", "size"), "band"), "members")
    heads = _heads(members)
    alike = f"100 * least(n, head_n) >= {percent} * greatest(n, head_n)"
    star = members.join(heads, "band").where(f"doc_id <> head and {alike}")
    # the pairs that are tested are also those left out of the second round
    star = written(star.select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b")).distinct(), "star")
    wanted = classes.select(F.col("rep").alias("doc_id"), "text_hash", "node").join(members.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi")
    texts = common.rows_joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), written(wanted, "wanted"))
    texts = written(texts.where(F.xxhash64("text") == F.col("text_hash")).select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")
    links = _confirmed(star, reps, texts, k, percent, sketch)
    label = written(components(links), "labels")

    named = members.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    named = written(named, "named")
    sized = named.groupBy("band", "component").agg(F.count(F.lit(1)).alias("held"))
    mixed = sized.groupBy("band").agg(F.max_by("component", "held").alias("main"), F.max("held").alias("most"), F.sum("held").alias("total"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    parts = F.greatest(F.lit(1), F.ceil(F.expr(f"(total - most) * total / {PART_PAIRS}.0"))).cast("int")
    open_ = written(named.join(mixed.select("band", "main", parts.alias("parts")), "band"), "open")
    known = open_.select("doc_id", "n", "component").distinct()
    own, kin = _rarities(texts.join(known, "doc_id"), k, percent)
    # a pair that shares no rare shingle is bounded by the rare ones that each has, before it is made
    bound = f"100 * (n - own) >= {percent} * n"
    open_ = written(open_.join(own, "doc_id", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(bound), "bounded")
    # a pair is made in the first of its common buckets only
    profiles = _profiles(texts.join(open_.select("doc_id").distinct(), "doc_id", "left_semi"), k)
    of_doc = open_.groupBy("doc_id").agg(F.collect_list("band").alias("bands")).join(profiles, "doc_id")
    # sets of a pair differ in size by the threshold at most, so they lie in the same or neighbouring steps of size
    open_ = open_.join(of_doc, "doc_id").withColumn("step", F.floor(F.ln("n") / float(np.log(100 / percent) + 1e-9)))
    minor = open_.where("component <> main").select("band", F.col("doc_id").alias("x"), *[F.col(c).alias(f"{c}_x") for c in ("n", "own", "component", "bands", "cells")], F.explode(F.expr("sequence(step - 1, step + 1)")).alias("step"), F.expr("pmod(xxhash64(doc_id), parts)").alias("part"))
    every = open_.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1L)")))
    most, first = "least(n - own, n_x - own_x)", "array_min(array_intersect(bands, bands_x)) = band"
    common_most = "aggregate(zip_with(cells, cells_x, (p, q) -> least(p, q)), 0L, (s, z) -> s + z)"
    rest = minor.join(every, ["band", "step", "part"]).where(f"component_x <> component and 100 * {most} >= {percent} * (n + n_x - {most}) and {first} and 100 * {common_most} >= {percent} * (n + n_x - {common_most})")
    rest = rest.select(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b")).distinct()
    rest = rest.unionByName(kin).distinct().join(star, ["a", "b"], "left_anti")
    more = _confirmed(rest, reps, texts, k, percent, sketch)

    final = written(components(links.unionByName(more).unionByName(_of_one_document(full, classes, key))), "components")
    linked = final.join(classes.select("node", "rep"), "node")
    smallest = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named_classes = classes.join(linked.join(smallest, "component").select("node", "component_id"), "node", "left")
    named_classes = named_classes.select(*key, "n_copies", F.coalesce("component_id", "rep").alias("component_id"))
    flat = sketched.drop("regs", "text_hash")
    some = flat.where("n_shingles > 0 and doc_id is not null").join(named_classes, key)
    none = flat.where("n_shingles = 0 or doc_id is null").select("*", F.lit(1).cast("long").alias("n_copies"), F.col("doc_id").alias("component_id"))
    both = some.unionByName(none)
    return both.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_copies")


def _of_one_document(full: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Links (a, b) between the classes of each doc_id that has several."""
    several = full.groupBy("doc_id").agg(F.min("s1").alias("l1"), F.max("s1").alias("h1"), F.min("s2").alias("l2"), F.max("s2").alias("h2")).where("l1 < h1 or l2 < h2")
    several = written(several.select("doc_id"), "several")
    held = full.join(several, "doc_id", "left_semi").select("doc_id", *key).distinct().join(classes.select(*key, "node"), key)
    low = held.groupBy("doc_id").agg(F.min("node").alias("a"))
    return held.join(low, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one document of each group of near duplicates stays, with all their columns.

    The document with the smallest doc_id of a group stays. Of several rows with one
    doc_id one stays, the first by text; rows without doc_id all stay.
    """
    decided = near_duplicates(docs, k, percent).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n_rows"))
    decided = written(decided, "decided")
    single = common.rows_without(docs, decided.where("not kept or n_rows > 1").select("doc_id"))
    rows = common.rows_with(docs, decided.where("kept and n_rows > 1").select("doc_id"))
    # of repeated rows the first by text is an aggregate, partial before the shuffle however many rows one doc_id has
    row = F.struct(*[F.col(c) for c in docs.columns])
    (first,) = common.unused(docs.columns, "first_row")
    rows = rows.groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNotNull(), "text")).alias(first))
    return single.unionByName(rows.select(f"{first}.*"))
