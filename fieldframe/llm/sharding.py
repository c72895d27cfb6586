"""Operator 4, sharding by weighted rendezvous hashing, in DataFrame functions only.

Every record key gets a score for every shard, -ln(u) / weight with u in (0, 1) from a
hash of key and shard, and goes to the shard with the smallest. A shard's score depends
on nothing but the key and that shard, so a new shard takes records only into itself
and a removed one gives away only its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running
from . import common

#: Groups of hashed keys that a shard's rows are ordered by first.
NUMBERING_GROUPS = 1024
#: Equal rows that one task unrolls at a time.
UNROLLED = 100_000


def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of key:shard; null keys count as the text null."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, whose weighted score is best; ties go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    scores = [F.struct((-F.ln(uniform(key, s)) / float(w)).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*scores))["shard"]


def sharded(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 that of the bytes (null:
    of none, 0). shard is the rendezvous choice among the weights, grown_shard the choice
    with one more shard of weight 1. slot numbers a shard's rows from 0 without gaps,
    by group of hashed keys and then doc_id, size and text_crc32; equal rows differ by
    their slots only. Equal rows are counted before they are shuffled and unrolled again
    in stretches; the distinct ones go to tasks by ranges of that order, each shifted by
    the ranges before, so no task holds a shard, or the rows of one frequent doc_id. A null
    doc_id is a key of its own. Other columns are ignored; an empty table gives no rows.
    """
    key = F.col("doc_id")
    group = F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null"))), F.lit(NUMBERING_GROUPS)).cast("int")
    placed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, 1.0]).alias("grown_shard"),
        group.alias("group"),
    )
    order = ["shard", "group", "doc_id", "size", "text_crc32"]
    counted = placed.groupBy(*order, "grown_shard").agg(F.count(F.lit(1)).alias("held"))
    laid = common.written(running(counted, [F.col(c) for c in order], F.col("held"), "begin", "end"), "laid")
    # one row a shard
    first = laid.groupBy("shard").agg(F.min("begin").alias("first"))
    laid = laid.join(F.broadcast(first), "shard").withColumn("begin", F.col("begin") - F.col("first")).drop("first", "end", "group")
    few = laid.where(F.col("held") <= UNROLLED).withColumn("at", F.col("begin"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("held") - 1) / UNROLLED)))
    many = laid.where(F.col("held") > UNROLLED).withColumn("part", parts).repartition("shard", "doc_id", "begin", "part")
    many = many.withColumn("at", F.col("begin") + F.col("part") * UNROLLED).withColumn("held", F.least(F.lit(UNROLLED), F.col("held") - F.col("part") * UNROLLED)).drop("part")
    each = few.unionByName(many).withColumn("slot", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("held") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
