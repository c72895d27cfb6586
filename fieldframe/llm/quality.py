"""Operator 5, a quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits or runs of other marks, in lower case; a text's
features are its words and pairs of neighbours (all pairs of a word with itself as one), hashed to 2**18 places, each with its
share of the text. Scores are sparse dot products of these shares with the weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U, mix

BITS = 18
#: Labelled rows that the model is fitted on at most, those with the smallest hashes of their doc_id.
FIT_ROWS = 20_000
#: The rows are dealt to so many learners, whose weights are averaged.
LEARNERS, EPOCHS = 8, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Shares are small numbers; they are multiplied by this.
SCALE = 20.0


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of the words and pairs of each text, and where each text's start."""
    data, starts = common.pack(texts)
    data = common.lower_ascii(data)
    kind = np.where((data == 32) | ((data >= 9) & (data <= 13)), 0, np.where(((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128), 1, 2)).astype(np.uint8)
    ws, we, _ = common.runs(kind)
    h = common.slices_hash(data, ws, we)
    doc = common.owner(starts, ws)
    with np.errstate(over="ignore"):
        # a word said again is one feature whatever the word
        pair = np.where(h[:-1] == h[1:], U(0x5265706561742121), mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]))
    near = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, dtype=np.int64)
    place = np.concatenate((h, pair[near] if len(near) else h[:0])) >> U(64 - BITS)
    doc = np.concatenate((doc, doc[near]))
    order = np.argsort(doc, kind="stable")
    return place[order].astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(starts) - 1)))).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates over rows of (places, values, label); the last weight is the intercept."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    for _ in range(epochs):
        for places, values, label in rows:
            zi, ni = z[places], n[places]
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
            g = (p - label) * values
            z[places] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[places] += g * g
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the doc_id as text, modulo of; null ids count as the text null."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))), F.lit(of))


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, of: int, held_out: int, bound: int) -> DataFrame:
    """doc_id, text, y of at most bound labelled rows outside the held-out remainder, chosen by hashed doc_id.

    Only doc_id and label are sorted; the chosen ids are few enough to be broadcast, so
    of the texts only the chosen ones are shuffled. Rows with a null label or id are no
    labelled rows; of rows with one doc_id the first by text is taken.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(remainder(F.col("doc_id"), of) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return held.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> np.ndarray:
    """Weights (2**BITS, and the intercept) fitted on labelled rows with crc32(doc_id) mod 5 other than 0.

    LEARNERS tasks train on their shares of the sample, and their weights are averaged; what
    the driver gets has one row a weight. Without labelled rows all weights are 0.
    """
    chosen = bounded_sample(docs, labels, "quality", 5, 0, bound)
    dealt = chosen.withColumn("learner", F.pmod(F.xxhash64("doc_id"), F.lit(LEARNERS))).repartition(LEARNERS, "learner").sortWithinPartitions("learner", F.xxhash64("doc_id"), "text")

    def learn(batches):
        rows: dict[int, list] = {}
        for pdf in batches:
            for i, j in common.in_pieces(pdf, ["text"]):
                part = pdf.iloc[i:j]
                places, at = features(part["text"])
                for k, (y, who) in enumerate(zip(part["y"], part["learner"], strict=True)):
                    own, count = np.unique(places[at[k] : at[k + 1]], return_counts=True)
                    values = np.append(SCALE * count / max(1, count.sum()), 1.0)
                    rows.setdefault(who, []).append((np.append(own, 2**BITS), values, int(y)))
        for some in rows.values():
            w = ftrl(some)
            used = np.flatnonzero(w)
            yield pd.DataFrame({"place": used, "weight": w[used], "rows": float(len(some))})

    learnt = dealt.mapInPandas(learn, "place long, weight double, rows double")
    summed = learnt.groupBy("place").agg(F.sum(F.col("weight") * F.col("rows")).alias("weight")).toPandas()
    out = np.zeros(2**BITS + 1)
    total = chosen.count()
    out[summed["place"].to_numpy(dtype=np.int64)] = summed["weight"].to_numpy() / max(1, total)
    return out


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """Per row of docs (doc_id, text; null text: empty): doc_id, held_out, score, predicted.

    A text without words scores what the intercept says. Equal texts have equal scores.
    Other columns are ignored; an empty table gives no rows.
    """
    spread = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = spread.value
        out = np.zeros(len(texts))
        frame = texts.to_frame("text")
        for i, j in common.in_pieces(frame, ["text"]):
            places, at = features(texts.iloc[i:j])
            run = np.concatenate(([0.0], np.cumsum(w[places].astype(np.float64))))
            size = np.diff(at)
            out[i:j] = SCALE * (run[at[1:]] - run[at[:-1]]) / np.maximum(size, 1) + w[-1]
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    rows = docs.select("doc_id", score(F.coalesce("text", F.lit(""))).alias("score"))
    held = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return rows.select("doc_id", held, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
