"""Operators and pipeline stages on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from test_operators import prose

import corpus_pipeline
from fieldframe.llm import fingerprints, quality, secret_scan, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, h long, span string, bucket int, w double"
LONG = " ".join(prose(77, 60)) + " word" * 60_000 + " token = abcdef123456"
ROWS = [(i, " ".join(prose(i, 60))) for i in range(20)] + [(3, " ".join(prose(3, 60))), (None, None), (None, "a text without number"), (50, ""), (51, " \n\t "), (52, None), (53, LONG), (54, LONG), (55, "x\x00y password: hunter22"), (55, "x\x00y password: hunter22")]


@pytest.fixture
def hard(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, 2, "x", 3, 4.0) for i, t in ROWS], COLUMNS)


def test_scores_of_hard_rows(spark, hard):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module, learn in ((quality, quality.fit), (toxicity, toxicity.learn)):
        model = learn(hard, labels)
        got = module.scored(hard, model).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (53, 54)}) == 1 and len({(r.doc_id, r.score) for r in got if r.doc_id == 3}) == 1
        assert module.scored(hard.limit(0), model).count() == 0
        assert module.scored(hard.limit(0), learn(hard.limit(0), labels)).count() == 0


def test_fingerprints_of_rows_without_number(hard):
    got = fingerprints.fingerprinted(hard).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)
    assert len({r.fingerprint for r in got if r.doc_id in (53, 54)}) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_groups_of_signature_bands(hard):
    """The bands of operator 9's own signatures find the copies, and nothing else."""
    got = fingerprints.groups(hard.where("doc_id is not null")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: (53 if i == 54 else i) for i, _ in ROWS if i is not None}


def test_masked_tables(spark, hard):
    masked = secret_scan.redacted(hard)
    assert masked.columns == hard.columns and masked.count() == len(ROWS) and secret_scan.redacted(hard.limit(0)).count() == 0
    assert all("hunter22" not in (r.text or "") for r in masked.collect())


@pytest.mark.parametrize("empty", [False, True])
def test_stages_of_hard_rows(spark, hard, empty, tmp_path):
    """Each stage keeps its columns and, but for copies, every clean row; run() gives the same as the stages."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = hard.limit(0) if empty else hard
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(last) == now.count() and all(r.lossless for r in last)
    kept = {r.doc_id for r in last}
    assert kept == (set() if empty else {i for i, _ in ROWS} - {54})
