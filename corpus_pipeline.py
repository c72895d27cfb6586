"""A training-corpus pipeline of five stages over documents; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldframe.llm import decontaminate, minhash_dedup, sampling, secret_scan, toxicity
from fieldframe.llm.common import written

#: What Arrow may bring to a Python worker at once, in bytes, and one row more: 10,000 whole texts are some 30 MB, held by Spark, Arrow and pandas each.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "256k"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless the session has a bound of its own. No result depends on it."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that score 0.7 or more for toxicity go. The lexicon is learnt from the table of labels."""
    small_batches(spark)
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near duplicates (five-word shingles, 0.8) the document with the smallest doc_id stays."""
    small_batches(spark)
    return minhash_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item, verbatim or with other values, go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every document stays; secrets in its text become [kind], and n_chars follows."""
    return secret_scan.redacted(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every document as sampled SentencePiece ids, with the proof that they decode to its text."""
    small_batches(spark)
    return sampling.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]

#: SQL can express neither the learnt lexicon nor sampled pieces; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to the table that the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
