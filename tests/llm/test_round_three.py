"""Operators 11 to 13 against plain code, and their hard cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldframe.llm import divergence, packing, queries, tokens, whitening

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# operator 11


def plain_whitening(rows, weighted=False):
    """(key, component) -> n, deviation, |whitened|, explained by loops over Python integers and one dense decomposition."""
    fine = [(k, [math.floor(256 * float(c)) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    copies = Counter(tuple(x) for _, x in fine)
    weight = dict(copies) if weighted else dict.fromkeys(copies, 1)
    n = sum(weight.values())
    sums = [sum(w * x[j] for x, w in weight.items()) for j in range(len(fine[0][1]))]
    centred = {x: np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) for x in copies}
    v = sum(w * np.outer(centred[x], centred[x]) for x, w in weight.items()) / n
    e, u = np.linalg.eigh(v)
    out = []
    for k, x in fine:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(min(4, len(sums))):
            out.append((k, c + 1, n, deviation, abs(float(centred[tuple(x)] @ u[:, -1 - c])) / math.sqrt(e[-1 - c]), e[-1 - c] / np.trace(v)))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def assert_whitened(got, want):
    got = sorted(([r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained] for r in got), key=lambda r: (r[0] is not None, r))
    assert [r[:4] for r in got] == [list(r[:4]) for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], atol=1e-7)


def test_op11(spark):
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = queries.queries()["op11_embedding_whitening"](spark, SF).collect()
    assert_whitened(got, plain_whitening(list(rows[["vec_id", "embedding"]].itertuples(index=False, name=None))))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6


@pytest.mark.parametrize("weighted", [False, True])
def test_whitening_of_hard_rows(spark, weighted):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(0, [3, 2, 1, 0.5, 0.2])]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(None, rows[1][1]), (None, rows[1][1]), (7, rows[2][1])]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [])]
    frame = spark.createDataFrame([(k, v, "a", 1, 2.0) for k, v in rows + bad], "vec_id long, embedding array<double>, x string, copies int, whitened double")
    got = whitening.whitened(frame, multiplicity=weighted).collect()
    assert_whitened(got, plain_whitening(rows, weighted))
    assert got[0].identity_error < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, 0.0)] * 4
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], schema)).collect()
    assert sorted((r.component, r.whitened is None) for r in flat) == [(1, False)] * 8 + [(2, True)] * 8
    # spaces of their own by length, values beyond what 64-bit products hold
    two = whitening.whitened(spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [1.0, 1e30])], "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.component): r.n for r in two} == {(1, 1): 2, (2, 1): 2, (3, 1): 2, (3, 2): 2, (4, 1): 2, (4, 2): 2}
    assert {r.deviation for r in two if r.vec_id in (1, 2)} == {256**2} and {r.deviation for r in two if r.vec_id == 3} == {None}


def test_exact_integers():
    x = np.array([[2**40, -3], [5, 2**62]], dtype=np.int64)
    d = whitening._centred(x, 10**6, [2**61, -1])
    assert [[int(v) for v in r] for r in d] == [[10**6 * 2**40 - 2**61, -3 * 10**6 + 1], [5 * 10**6 - 2**61, 10**6 * 2**62 + 1]]
    assert whitening._squares(np.array([[3, 4], [2**31, 2**31]])) == [25, None]
    assert whitening._squares(np.array([[3, 4], [2**40, 1]], dtype=object)) == [25, None]


# operator 12


def plain_divergence(rows):
    """Dense shares of every group and kept term, in Python integers."""
    occurs, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.add((lang, source))
        occurs[lang, source].update(words)
        documents[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= 3]
        sources = [s for g, s in groups if g == lang]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        p = {s: shares(occurs[lang, s]) for s in sources}
        q = shares(sum((occurs[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if occurs[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[: None if part == "pair" else 200]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


HARD_DOCS = [
    ("en", "a", "The cat the CAT, the_dog Ärger ÄRGER x9y"),
    ("en", "a", "the cat"),
    ("en", "b", "the the the cat\x00dog"),
    ("en", "b", None),
    ("en", None, "the Cat sat"),
    ("en", "z", ""),
    ("en", "z", "  123 \n"),
    ("de", "a", "nur einmal"),
    ("de", "b", None),
    ("fr", "only", "mot mot"),
    ("fr", "only", "mot"),
    ("fr", "only", "mot"),
    (None, "a", "x x"),
    (None, None, "x"),
    (None, "c", "X y"),
    ("en", "long", "the cat " * 300_000 + "Ärger"),
] + [("en", "a", "repeated row with the cat")] * 5


@pytest.mark.parametrize("chunk", [512, 2])
def test_divergence_of_hard_rows(spark, chunk, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    frame = spark.createDataFrame([(i, *r, 1, 2, "c") for i, r in enumerate(HARD_DOCS)], "doc_id long, lang string, source string, text string, n long, slot int, term string")
    got = sorted(tuple(r) for r in divergence.divergence(frame).collect())
    assert got == plain_divergence(HARD_DOCS)
    assert {r[:3] for r in got} >= {("de", "a", "pair"), ("", "", "pair"), ("en", "z", "pair")} and all(r[4] == 0 for r in got if r[0] == "de")
    assert divergence.divergence(frame.limit(0)).count() == 0


def test_divergence_of_many_small_rounds(spark, monkeypatch):
    """Posting rounds, counting rounds and text slices of a few rows give the same as one."""
    for name, value in (("HELD", 50), ("TOP", 7)):
        monkeypatch.setattr(divergence, name, value)
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    rows = list(docs[["lang", "source", "text"]].itertuples(index=False, name=None))
    got = sorted(tuple(r) for r in divergence.divergence(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert got == [r for r in plain_divergence(rows) if r[2] == "pair" or r[5] <= 7]


def test_op12(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op12_source_divergence"]).df()
    got = queries.queries()["op12_source_divergence"](spark, SF).toPandas()
    by = ["lang", "source", "part", "rank"]
    assert want.columns.tolist() == got.columns.tolist() and got.sort_values(by).reset_index(drop=True).equals(want.sort_values(by).reset_index(drop=True))


def test_accumulator_in_small_rounds(monkeypatch):
    draw = np.random.default_rng(2)
    counts = {(s, t): int(n) for s in range(5) for t in range(60) if (n := draw.poisson(0.7))}
    total = [sum(n for (g, _), n in counts.items() if g == s) for s in range(5)]

    def run(posting_limit):
        monkeypatch.setattr(divergence, "POSTINGS", posting_limit)
        tile = divergence._Tile("l", 0, 0)
        for s in range(5):
            tile.head(str(s), 0, total[s], sum(total), 60, True)
        tile.ready()
        rows = sorted((t, s, n) for (s, t), n in counts.items())
        for low in range(0, 60, 20):
            t, s, n = (np.array(x) for x in zip(*[r for r in rows if low <= r[0] < low + 20], strict=True))
            names, term = np.unique(t, return_inverse=True)
            tile.add(term, s, n, np.array([sum(counts.get((g, x), 0) for g in range(5)) for x in t]), [b"%03d" % x for x in names])
        return [b.to_pydict() for b in tile.emitted()]

    assert run(1 << 18) == run(3)
    p = [[1 + 10**9 * (counts.get((s, t), 0) + 1) // (total[s] + 60) for t in range(60)] for s in range(5)]
    first = run(4)[0]
    assert first["value"] == [sum((a - b) ** 2 // b for a, b in zip(p[0], p[o], strict=True)) for o in range(1, 5)]


def test_shares_are_exact():
    n, total = np.array([0, 5, 9 * 10**14]), np.array([7, 9 * 10**15, 9 * 10**15])
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total, strict=True)]


# operator 13


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def checked(pieces, ids, limit=2048):
    """Every id in one piece, offsets without gaps, sequences of the limit or a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for k, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[k])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids[k])
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == limit or at < limit and at & (at - 1) == 0
    return by_sequence


def test_op13(spark, library):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in docs[["doc_id", "text"]].itertuples(index=False, name=None)}
    pieces = queries.queries()["op13_vector_packing"](spark, SF).collect()
    sequences = checked(pieces, ids)
    assert sum(sum(r.length for r in s) < 2048 for s in sequences.values()) <= 11 * spark.read.parquet(f"{SF}/documents.parquet").rdd.getNumPartitions()


def test_packing_of_hard_texts(spark, library):
    rows = [(0, None), (1, ""), (2, "a"), (3, "<|endoftext|> x<|endoftext|>"), (4, "word " * 200_000), (5, "x" * 30_000), (6, "\n\n \t it's we'LL 'tis''s"), (7, "ä中\x00𝒳½ a1")] + [(10 + i, "hi") for i in range(900)]
    frame = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], "doc_id long, text string, start long, length long, ids string").coalesce(1)
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}
    checked(packing.packed_texts(frame, VOCABULARY).collect(), ids)
    assert packing.packed_texts(frame.limit(0), VOCABULARY).count() == 0
    same = packing.packed_texts(frame.where("doc_id = 2").selectExpr("cast(null as long) doc_id", "text").union(frame.where("doc_id = 2").select("doc_id", "text")), VOCABULARY).collect()
    assert sorted(str(r.doc_id) for r in same) == ["2", "None"]


def plain_choice(demands, limits):
    """The dot-product heuristic without cutting, by loops: sequences as lists of places."""
    left, out = dict(enumerate(demands)), []
    while left:
        room, own = list(limits), []
        while True:
            fits = [(sum(d / m * r / m for d, r, m in zip(v, room, limits, strict=True)), -i) for i, v in left.items() if all(d <= r for d, r in zip(v, room, strict=True))]
            if not fits:
                break
            i = -max(fits)[1]
            room = [r - d for r, d in zip(room, left.pop(i), strict=True)]
            own.append(i)
        out.append(own)
    return out


def test_limits_hold_together(spark):
    draw = np.random.default_rng(9)
    limits = packing.Limits(tokens=64, segments=6, loss=20)
    examples = [(i, [int(x) for x in draw.integers(0, 9, n)], [bool(x) for x in draw.random(n) < 0.3]) for i, n in enumerate(draw.integers(1, 40, 120))]
    examples = [(i, a, b) for i, a, b in examples if sum(b) <= 20]
    frame = spark.createDataFrame(examples, "doc_id int, ids array<int>, loss array<boolean>").coalesce(1)
    for cut in (False, True):
        pieces = packing.packed(frame, limits, cut).collect()
        by = defaultdict(list)
        for r in pieces:
            by[r.sequence_id].append(r)
        for rows in by.values():
            assert sum(r.length for r in rows) <= 64 and len(rows) <= 6 and sum(r.loss_tokens for r in rows) <= 20
        loss = {i: b for i, _, b in examples}
        assert all(r.loss_tokens == sum(loss[r.doc_id][r.start : r.start + r.length]) for r in pieces)
        assert sum(r.length for r in pieces) == sum(len(a) for _, a, _ in examples)
        if not cut:
            assert len(pieces) == len(examples)
            got = [[r.doc_id for r in sorted(by[s], key=lambda r: r.offset)] for s in sorted(by)]
            want = plain_choice([(len(a), 1, sum(b)) for _, a, b in examples], (64, 6, 20))
            assert got == [[examples[i][0] for i in own] for own in want]


def test_examples_beyond_a_limit_and_nulls(spark):
    frame = spark.createDataFrame([("a", list(range(50)), None), ("b", None, None), ("c", [], []), ("d", [7, None], [None]), ("e", [1] * 9, [True] * 9)], "doc_id string, ids array<int>, loss array<boolean>")
    pieces = packing.packed(frame, packing.Limits(16, 3, 4)).collect()
    assert sum(r.length for r in pieces if r.doc_id == "a") == 50 and max(r.length for r in pieces) <= 4
    assert {r.doc_id for r in pieces} == {"a", "d", "e"} and [r.loss_tokens for r in pieces if r.doc_id == "d"] == [1]
    with pytest.raises(ValueError):
        packing.Limits(0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sStmdrevl1!.<|>½é中　\x85")), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_words_give_the_librarys_ids(texts):
    ours = tokens.tokens(VOCABULARY)
    assert [x.tolist() for x in ours.encode(texts)] == [e.ids for e in ours.library.encode_batch(texts, add_special_tokens=False)]


def test_slices_and_other_pipelines(monkeypatch):
    monkeypatch.setattr(tokens, "CHARS", 9)
    text = "It's 12 o'clock,  and all<|endoftext|> is well!\n\nbut a1b2c3d4e5f6 " * 5
    ours = tokens.Tokens(VOCABULARY)
    assert ours.encode([text])[0].tolist() == ours.library.encode(text, add_special_tokens=False).ids
    other = tokens.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.by_words and other.encode(["Some text", None])[0].tolist() == other.library.encode("Some text", add_special_tokens=False).ids
