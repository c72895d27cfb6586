import corpus_pipeline
import pandas as pd
from pyspark.sql import functions as F

from fieldframe.llm import common


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() < before and last.where("not lossless").count() == 0


def test_python_stages_bound_batches_by_bytes(spark):
    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [pdf["text"].str.len().sum()], "longest": [pdf["text"].str.len().max()]})

    sf, key = "/root/testdata/sf0.001", corpus_pipeline.BATCH_BYTES
    long = spark.range(1, numPartitions=1).select((F.col("id") - 1).alias("doc_id"), F.expr("repeat('long word ', 60000)").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(600000).cast("long").alias("n_chars"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(long.select(*docs.columns)).coalesce(1)
    stages = dict(corpus_pipeline.STAGES)
    own = spark.conf.get(key, None)
    try:
        got = {}
        for bound in (None, "1g"):  # a session's own bound stays
            for name in ("toxicity", "near_duplicates", "pieces"):
                spark.conf.set(key, bound) if bound else spark.conf.unset(key)
                got[name, bound] = sorted(map(repr, stages[name](spark, docs, sf).collect()))
                assert spark.conf.get(key) == (bound or corpus_pipeline.BATCH)
                held = docs.where("text is not null").select("text").mapInPandas(sizes, "n long, longest long").collect()
                assert bound or len(held) > 1 and all(r["n"] <= 256 * 1024 + r["longest"] for r in held)
                assert not bound or len(held) == 1
                assert sum(r["n"] for r in held) == docs.agg(F.sum(F.length("text"))).first()[0]
        for name in ("toxicity", "near_duplicates", "pieces"):
            assert got[name, None] == got[name, "1g"]
    finally:
        spark.conf.set(key, own) if own else spark.conf.unset(key)
