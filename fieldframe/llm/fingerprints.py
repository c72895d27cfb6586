"""Operator 9, document fingerprints by MinHash.

128 universal hash permutations over a text's five-word shingles are evaluated in numpy
for all texts of a batch at once; a fingerprint is one byte of each minimum. Groups of
near duplicates come from bands of the signatures, joined in Spark and verified.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .minhash_dedup import NO_ID, Sketch, near_duplicates

PERMUTATIONS, SHINGLE = 128, 5
_rng = np.random.default_rng(1009)
_A = _rng.integers(1, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def minima(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set of hashes its smallest value under each permutation; sets without hashes have zeros."""
    out = np.zeros((len(at) - 1, PERMUTATIONS), dtype=np.uint32)
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        x = (h >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for i in range(PERMUTATIONS):
                out[some, i] = np.minimum.reduceat(x * _A[i] + _B[i], at[some])
    return out


def _sixteen(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _low(minima(h, at), np.uint16)


def _low(values: np.ndarray, kind) -> np.ndarray:
    """Well-mixed low bits of each minimum: minima have small high bits, so they are multiplied out first."""
    with np.errstate(over="ignore"):
        return ((values * np.uint32(2654435769)) >> np.uint32(32 - 8 * np.dtype(kind).itemsize)).astype(kind)


MINHASH = Sketch(_sixteen, PERMUTATIONS, 4, lambda n_a, n_b: np.full(len(n_a), 2.0**-16))


def signatures(texts) -> list[bytes]:
    """A fingerprint's bytes for each text; empty for a text without words."""
    h, at = common.shingles(texts, SHINGLE)
    low = _low(minima(h, at), np.uint8)
    return [row.tobytes() if n else b"" for row, n in zip(low, np.diff(at), strict=True)]


def likeness(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Share of equal bytes less chance matches, 0 to 1; two texts without words are alike, one without is like no other."""
    both = [bool(a) and bool(b) for a, b in zip(left, right, strict=True)]
    out = np.array([float(not a and not b) for a, b in zip(left, right, strict=True)])
    if any(both):
        a = np.frombuffer(b"".join(x for x, ok in zip(left, both, strict=True) if ok), dtype=np.uint8).reshape(-1, PERMUTATIONS)
        b = np.frombuffer(b"".join(x for x, ok in zip(right, both, strict=True) if ok), dtype=np.uint8).reshape(-1, PERMUTATIONS)
        out[np.array(both)] = np.clip(((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256), 0, 1)
    return out


def _bucket(splits: list[int]):
    """How many of the sorted splits are at most doc_id, by binary search."""
    if not splits:
        return F.lit(0)
    found, wide = F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi")), F.array(*[F.lit(s).cast("long") for s in splits])

    def step(acc, _):
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        up = (acc["lo"] < acc["hi"]) & (F.get(wide, mid) <= F.col("__id"))
        return F.struct(F.when(up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(up | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    steps = F.array(*[F.lit(0)] * (len(splits).bit_length() + 1))
    return F.aggregate(steps, found, step)["lo"]


def with_next(docs: DataFrame):
    """Rows laid out so that each document is followed by the next one, by descending doc_id.

    doc_id ranges with about equal counts become buckets; each bucket borrows the first
    row of the one below, the lowest that of the highest. What is known on the driver is
    one split and one doc_id a bucket, as many as there are shuffle partitions; the texts
    are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"))
    cuts = ids.agg(F.percentile_approx("__id", F.array(*[F.lit((i + 1) / n) for i in range(n - 1)]), F.lit(100 * n)).alias("cuts")).first()[0] if n > 1 else None
    bucket = _bucket(sorted(set(cuts or [])))
    tops = sorted((r["b"], r["top"]) for r in ids.groupBy(bucket.alias("b")).agg(F.max("__id").alias("top")).collect())[::-1]
    lent = [(tops[(i + 1) % len(tops)][1], b) for i, (b, _) in enumerate(tops)]
    borrowed = spark.createDataFrame(lent, "__id long, borrower int")
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("lent"))
    to = F.struct(F.col("borrower").alias("bucket"), F.lit(1).alias("lent"))
    placed = rows.withColumn("__bucket", bucket).join(F.broadcast(borrowed), "__id", "left")
    placed = placed.select("doc_id", "text", "__id", F.explode(F.when(F.col("borrower").isNull(), F.array(own)).otherwise(F.array(own, to))).alias("w"))
    placed = placed.select(F.col("w.bucket").alias("bucket"), F.col("w.lent").alias("lent"), "__id", "doc_id", "text").repartitionById(n, F.col("bucket"))
    return placed.sortWithinPartitions("bucket", "lent", F.desc("__id"), "text")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text; null text: empty): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n / 2) code points replaced by as
    many first ones of the next document (all, if it has fewer). Documents follow each
    other by descending doc_id, rows of one doc_id by text, rows without doc_id come
    last; after the last comes the first. A single row follows itself. Other columns are
    ignored; an empty table gives no rows. Fingerprints are 256 hex digits, empty for
    a text without words.
    """
    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], columns)

    def run(batches):
        pending = None
        for pdf in batches:
            for i, j in common.in_pieces(pdf, ["text"], 1_000_000):
                part = pdf.iloc[i:j]
                bucket, lent = part["bucket"].tolist(), part["lent"].tolist()
                ids, texts = part["__id"].tolist(), part["text"].tolist()
                prints = signatures(texts)
                if pending:
                    bucket, lent, ids, texts, prints = ([p, *x] for p, x in zip(pending, (bucket, lent, ids, texts, prints), strict=True))
                own = [k for k in range(len(texts) - 1) if not lent[k] and bucket[k] == bucket[k + 1]]
                pending = (bucket[-1], lent[-1], ids[-1], texts[-1], prints[-1])
                if not own:
                    continue
                edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in own]
                mine, again = [prints[k] for k in own], signatures(edited)
                yield pd.DataFrame(
                    {
                        "doc_id": [ids[k] for k in own],
                        "n_chars": [len(texts[k]) for k in own],
                        "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
                        "fingerprint": [p.hex() for p in mine],
                        "edited_fingerprint": [p.hex() for p in again],
                        "near_edited": likeness(mine, again),
                        "near_next": likeness(mine, [prints[k + 1] for k in own]),
                    }
                )

    made = with_next(docs).mapInPandas(run, columns)
    return made.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Groups of near duplicates from these signatures: bands of four values joined in Spark, Jaccard similarity of the full sets verified.

    Rows and cases are those of minhash_dedup.near_duplicates with five-word shingles.
    """
    return near_duplicates(docs, SHINGLE, percent, MINHASH)
