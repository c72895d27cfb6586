import hashlib
import random
import re

import numpy as np
import pytest

from fieldframe.llm import chat, common, components, decontaminate, fingerprints, minhash_dedup, quality, sampling, secret_scan, sharding, toxicity, warc

HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "one two"), (5, "x" * 50_000), (6, "ß É 漢字 ▁ \\ <s> \x01 \x02"), (7, "word " * 20_000)]


def prose(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def corpus():
    rows, i = [], 10
    for seed in range(25):
        base = prose(seed, 60 + seed * 4)
        rows.append((i, " ".join(base)))
        for k in range(4):
            edited = list(base)
            for p in random.Random(seed * 10 + k).sample(range(len(base)), 1 + k * 2):
                edited[p] = f"e{seed}_{k}"
            rows.append((i + k + 1, " ".join(edited)))
        i += 7
    return rows


def brute_components(rows, k):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("make", [lambda d: minhash_dedup.near_duplicates(d, 4, 80), lambda d: minhash_dedup.near_duplicates(d, 4, 80, fingerprints.MINHASH)])
def test_near_duplicates(docs, make):
    rows = corpus()
    got = {r.doc_id: r.component_id for r in make(docs(rows)).collect()}
    assert got == brute_components(rows, 4)


def test_near_duplicates_hard_cases(docs):
    out = minhash_dedup.near_duplicates(docs(HARD), 4, 80).collect()
    assert len(out) == len(HARD)
    by = {r.doc_id: r for r in out}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[2].component_id == 2
    assert by[None].component_id is None and by[None].kept and by[7].n_shingles == 1
    assert minhash_dedup.near_duplicates(docs([]), 4, 80).count() == 0
    kept = minhash_dedup.deduplicated(docs(HARD))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7", "None"]
    assert kept.columns == docs([]).columns


def test_heads_do_not_depend_on_the_order_of_rows(spark):
    members = [(band, i, 10 + i, 4) for band in (1, 2, 3) for i in range(4)]
    for rows in (members, members[::-1]):
        table = spark.createDataFrame(rows, "band long, doc_id long, n long, size long").coalesce(1)
        assert sorted(tuple(r) for r in minhash_dedup._heads(table).collect()) == [(1, 3, 13), (2, 3, 13), (3, 3, 13)]


def test_tested_pairs_are_made_once(docs, monkeypatch):
    """What _confirmed tests first is a written table, so the second round leaves out just these pairs."""
    seen, confirmed = [], minhash_dedup._confirmed
    monkeypatch.setattr(minhash_dedup, "_confirmed", lambda pairs, *rest: (seen.append(pairs), confirmed(pairs, *rest))[1])
    minhash_dedup.near_duplicates(docs(corpus()[:10]), 4, 80)
    assert len(seen) == 2 and len(seen[0].inputFiles()) > 0 and all("/star-" in f for f in seen[0].inputFiles())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_registers_estimate_similarity():
    a, b = prose(1, 3000), prose(1, 3000)
    b[::25] = [f"q{i}" for i in range(len(b[::25]))]
    h, at = common.shingles([" ".join(a), " ".join(b)], 4)
    reg = minhash_dedup.registers(h, at)
    both, union = common.jaccard_of_texts([" ".join(a)], [" ".join(b)], 4)
    n = np.diff(at).astype(float)
    assert abs(minhash_dedup.estimate(reg[:1], reg[1:], n[:1], n[1:])[0] - both[0] / union[0]) < 0.1


def test_sampling_is_lossless_and_reproducible(docs):
    rows = HARD + [(50, "Hello  world\n\nagain and again")]
    got = sampling.encoded(docs(rows)).collect()
    assert all(r.lossless for r in got) and len(got) == len(rows)
    again = {(r.doc_id, r.n_bytes): r.ids_crc32 for r in sampling.encoded(docs(rows[::-1]).coalesce(1)).collect()}
    assert again == {(r.doc_id, r.n_bytes): r.ids_crc32 for r in got}
    texts = {(r.doc_id, r.text) for r in sampling.decoded(sampling.encoded(docs(rows))).collect()}
    assert texts == {(i, t or "") for i, t in rows}


def test_sampling_follows_the_lattice():
    v = sampling.vocabulary(sampling.MODEL, 1.0)
    word, n = " there", 4000
    weight = dict(zip(v.ids.tolist(), v.weights.tolist()))
    piece = {v.bytes[i].decode(): w for i, w in weight.items() if v.bytes[i].decode("utf-8", "ignore") in word}

    def ways(s):
        return [[]] if not s else [[p, *rest] for p in piece if s.startswith(p) for rest in ways(s[len(p) :])]

    mass = {tuple(w): np.exp(sum(piece[p] for p in w)) for w in ways(word)}
    ids, at, _ = sampling.sampled([word] * n, list(range(n)), v, 3)
    seen = {}
    for i in range(n):
        key = tuple(v.bytes[k].decode() for k in ids[at[i] : at[i + 1]])
        seen[key] = seen.get(key, 0) + 1
    for way, m in mass.items():
        p = m / sum(mass.values())
        assert abs(seen.get(way, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def test_chat_escapes_and_spans(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\", "\\[INST]", "<\\s>", "", "[", "<|end|>\n"]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "tool", "user", "assistant", None], texts))] + [(2, 0, "user", None), (None, 3, "assistant", "x"), (2, 0, "user", None)]
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    said = [(r or "", t) for _, _, r, t in rows[:7]]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(t for r, t in said if r == "assistant").encode()).hexdigest()
    assert got[2].n_turns == 2 and got[None].loss_chars == 1
    made = chat.render([("user", "a"), ("assistant", "x\ny"), ("user", "b")], chat.forgetful)
    assert made.rewritten == 2 and len(made.spans) == 2


def test_sharding(docs):
    rows = HARD + [(i, "t") for i in range(100, 600)]
    got = sharding.sharded(docs(rows)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {r["doc_id"]: r["size"] for r in got}
    assert sizes[1] == 1 and sizes[2] == 1 and sizes[5] == 50_001
    heavy = [r["shard"] for r in sharding.sharded(docs(rows), (1.0, 3.0)).collect()]
    assert 0.65 < sum(heavy) / len(heavy) < 0.85
    assert sharding.sharded(docs([])).count() == 0


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "A train leaves Boston at 30 km per hour and meets Alice after 12 hours on the long road home"), (2, "what is it"), (3, None), (None, "a")], "item_id long, text string")
    rows = [
        (10, "Some words. A train leaves Denver at 45 km per hour and meets Bobby after 17 hours on the long road home"),
        (11, "A train leaves Denver at 45 km per hour and meets Denver after 45 hours on the long road home"),
        (12, "so what is it then"),
        (13, "nothing of the kind"),
        *HARD,
    ]
    got = {(r.doc_id, r.item_id): (r.kind, r.contaminated) for r in decontaminate.matches(docs(rows), bench).collect()}
    assert got == {(10, 1): ("reparameterised", True), (11, 1): ("inconsistent", False), (12, 2): ("verbatim", True)}
    assert decontaminate.decontaminated(docs(rows), bench).count() == len(rows) - 2
    assert decontaminate.matches(docs([]), bench).count() == 0 and decontaminate.matches(docs(rows), bench.limit(0)).count() == 0


def test_decontamination_of_items_with_few_literals(spark, docs):
    """Verbatim copies are found, in any case, whatever the placeholders; other values make no hit."""
    mixed = "Add 3 and 4 then 5 and 6 then 7 and 8 then 9 and tell us slowly what the whole sum of them is"
    items = [(1, "12 plus 30 equals"), (2, "Add 3 and 4 then 5"), (3, "What Is The Capital City Of France And Of Spain"), (4, "1 2 3 4 5 6 7 8 9 10 11 12"), (5, mixed)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (10, "so 12 plus 30 equals what"),
        (11, "please add 3 and 4 then 5"),
        (12, "we ask what is the capital city of france and of spain again"),
        (13, "count 1 2 3 4 5 6 7 8 9 10 11 12"),
        (14, "12 plus 31 equals, add 3 and 4 then 6, What Is The Capital City Of Norway, 2 3 4 5 6 7 8 10"),
        (15, mixed.replace("3", "13").replace("9", "19")),
        (16, mixed),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs([*rows, *HARD]), bench).collect()}
    assert {k: (r.kind, r.contaminated) for k, r in got.items()} == {**{(9 + i, i): ("verbatim", True) for i in (1, 2, 3, 4)}, (15, 5): ("reparameterised", True), (16, 2): ("verbatim", True), (16, 5): ("verbatim", True)}
    assert got[16, 5].n_windows == got[16, 5].item_windows == 18 and got[13, 4].n_windows == got[13, 4].item_windows == 5
    assert got[15, 5].n_windows < 18 and got[15, 5].coverage == 1
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs(rows), bench).collect()) == [14]


def test_decontamination_of_coinciding_values_and_of_fragments(spark, docs):
    fruit = "The farmer has 3 apples and 5 pears in the basket and gives 3 apples to each child"
    long = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in prose(900, 120)]
    pieces = [" ".join(long[i : i + 12]) for i in range(0, 120, 12)]
    bench = spark.createDataFrame([(1, fruit), (2, " ".join(long))], "item_id long, text string")
    rows = [
        (10, fruit.replace("3", "4").replace("5", "4")),
        (11, fruit.replace("3", "4", 1).replace("5", "6")),
        (12, f"{fruit} {fruit.replace('3', '7').replace('5', '9')}"),
        (20, " moreover ".join(pieces)),
        (21, " and ".join(p + " then" * 20 for p in pieces)),
        (22, pieces[0] + " far" * 400 + " " + pieces[5]),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs(rows), bench).collect()}
    assert {k: (r.kind, r.contaminated) for k, r in got.items()} == {
        (10, 1): ("reparameterised", True),
        (11, 1): ("inconsistent", False),
        (12, 1): ("verbatim", True),
        (20, 2): ("verbatim", True),
        (21, 2): ("verbatim", True),
        (22, 2): ("verbatim", False),
    }
    assert [got[i, 2].n_windows for i in (20, 21, 22)] == [50, 50, 5] and got[20, 2].item_windows == 113


def test_secrets(docs):
    rows = HARD + [(20, "ä \x01 password = abc123x, TOKEN:'short' secret=12345 AKIA" + "A" * 16 + " AKIAB " + "0f" * 12 + " api_key: " + "ab" * 20), (21, "AKIA" + "Z" * 20)]
    got = {r.doc_id: r for r in secret_scan.digest(docs(rows)).collect()}
    text = rows[-2][1]
    want = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secret_scan.RULES[0].pattern, text) if len(m[2]) >= 6]
    want += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert got[20].spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(want)) and got[21].n_access == 1 and got[1].spans == ""
    assert len(got) == len({i for i, _ in rows})
    masked = {r.doc_id: r.text for r in secret_scan.redacted(docs(rows)).collect()}
    assert masked[21] == "[access]" and "abc123x" not in masked[20] and masked[5] == rows[6][1]
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == [] and frozenset({"aki", "kia"}) in secret_scan.trigram_query("AKIA[A-Z]+")


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (5, "u\nv", "\r\n\r\nWARC/1.1 é")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert got[1].payload_digest == got[2].payload_digest == warc.payload_digest(b"same") and got[1].payload_bytes == 4
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_fingerprints(docs):
    rows = [r for r in HARD if r[0] is not None] + [(i, " ".join(prose(i, 80))) for i in range(100, 140)]
    got = fingerprints.fingerprinted(docs(rows)).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    want = []
    for i, (k, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        want.append((k, len(t), hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and r.near_next < 0.2 for r in got if r.doc_id >= 101)
    assert fingerprints.fingerprinted(docs([])).count() == 0


def test_quality_and_toxicity(spark, docs):
    rows, labels = [], []
    for i in range(300):
        w = prose(i, 40)
        bad, toxic = i % 4 == 0, i % 3 == 0
        text = " ".join(x + " ***" if bad else x for x in w) + (" you are a zorblat today." if toxic else ".")
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(rows + [(1000, None), (1001, "")])
    scores = {r.doc_id: r for r in quality.scored(d, quality.fit(d, known)).collect()}
    assert np.mean([scores[i].predicted == q for i, q, _ in labels if scores[i].held_out]) > 0.95 and 0 <= scores[1000].score <= 1
    lexicon = toxicity.learn(d, known)
    tox = {r.doc_id: r for r in toxicity.scored(d, lexicon).collect()}
    assert np.mean([tox[i].predicted == t for i, _, t in labels if tox[i].held_out]) > 0.95 and tox[1000].score == 0
    empty = known.limit(0)
    assert quality.scored(d, quality.fit(d, empty)).count() == 302 and toxicity.scored(d, toxicity.learn(d, empty)).count() == 302


def test_grammar_scores_clauses():
    machine, lexicon = toxicity.grammar(), toxicity.Lexicon({"idiot": 1.0})
    score = lambda t: toxicity.score_texts([t], lexicon, machine)[0]
    assert score("what an idiot.") == pytest.approx(0.75)
    assert score("you idiot.") > score("an idiot.") > score("he said an idiot.") > 0
    assert score("not an idiot.") < 0.7 and score("i will kill you.") > 0.7 and score("time to kill.") == 0
    assert score("a nice day") == 0 and score("idiotic.") == 0


def plain_sample(text, key, seed, v):
    """One draw by dictionaries and loops: forward sums of every word, then pieces from its end."""
    factor = {v.bytes[i]: (i, v.factor_of[i]) for i in v.byte_ids.tolist()} | {v.bytes[i]: (i, v.factor_of[i]) for i in v.ids.tolist()}
    data, out = text.encode(), []
    cuts = [i for i in range(len(data)) if i == 0 or (data[i] == 32 != data[i - 1]) or ((data[i] == 10) != (data[i - 1] == 10))]
    row = common.mix(np.array([key], dtype=np.int64).view(np.uint64) + common.mix(np.array([seed], dtype=np.uint64)))
    for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(data)])):
        word, total = data[a:b], [1.0]
        ways = lambda d: [(k, *factor[word[d - k : d]]) for k in range(min(d, 48), 0, -1) if word[d - k : d] in factor]  # noqa: E731, B023
        for d in range(1, len(word) + 1):
            total.append(sum(total[d - k] * f for k, _, f in ways(d)))
        d, pieces = len(word), []
        while d:
            stream = common.mix(row + np.array([n], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            u = int(common.mix(stream + np.array([d + 1], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[0] >> np.uint64(40))
            run, options = 0.0, ways(d)
            for k, i, f in options:
                run += total[d - k] * f
                if np.ceil(run / total[d] * 2**24) > u:
                    break
            pieces.append(i)
            d -= k
        out += pieces[::-1]
    return out


def test_sampling_against_plain_loops(spark, docs, monkeypatch):
    v = sampling.vocabulary(sampling.MODEL, 1.0)
    texts = ["Hello  world\n\nagain, and again?", " ß 漢字▁\\ <s> \x01", "ab" * 60, " ".join(prose(5, 60)), ""]
    with np.errstate(over="ignore"):
        want = [plain_sample(t, k, 1, v) for k, t in enumerate(texts)]
    got = {r.doc_id: list(r.ids) for r in sampling.encoded(docs(list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == want
    # words taken one by one, in short blocks, give the same
    monkeypatch.setattr(sampling, "LONG", 2)
    monkeypatch.setattr(sampling, "TOGETHER", 10**9)
    monkeypatch.setattr(sampling, "STRETCH", 50)
    monkeypatch.setattr(sampling, "CHUNK", 40)
    ids, at, _ = sampling.sampled(texts, list(range(len(texts))), v, 1)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == want


def test_sampling_hard_cases(spark, docs):
    assert sampling.encoded(docs([])).count() == 0 and sampling.decoded(sampling.encoded(docs([]))).count() == 0
    long = [(1, "x" * 1_000_000), (2, ("ab" * 150 + " ") * 1000)]
    assert all(r.lossless for r in sampling.encoded(docs(long)).select("lossless").collect())
    ids = spark.createDataFrame([(1, None), (2, []), (3, [sampling.vocabulary(sampling.MODEL, 1.0).byte_ids[97].item()])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sampling.decoded(ids).collect()} == {1: None, 2: "", 3: "a"}


def test_op2_query_decodes_every_text(spark):
    from fieldframe.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.queries()["op2_sentencepiece_sampling"](spark, sf).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in got) and len(got) == len(texts)
    assert sum(r.n_pieces for r in got) < 0.6 * sum(map(len, texts.values()))


def test_near_duplicates_of_a_doc_id_with_several_texts(docs):
    first, second = " ".join(prose(1, 60)), " ".join(prose(2, 60))
    rows = [(1, first), (1, second), (2, first + " z"), (3, second + " z"), (4, " ".join(prose(3, 60)))]
    got = minhash_dedup.near_duplicates(docs(rows), 4, 80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    kept = minhash_dedup.deduplicated(docs([*rows, (1, None)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id == 4 or r.text) == [(4, rows[4][1])] and len(kept) == 2


def test_split_buckets_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "PART_PAIRS", 2)
    monkeypatch.setattr(minhash_dedup, "FREQUENT", 6)
    rows = corpus()
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs(rows), 4, 80).collect()}
    assert got == brute_components(rows, 4)


def test_helper_columns_do_not_clash(spark):
    names = ["doc_id", "text", "bit_slot", "BIT_WORD", "bit_mask", "bit_set", "bit_key", "first_row", "__spans", "__rules"]
    rows = [(i, " ".join(prose(i // 2, 30)), *range(8)) for i in range(6)] + [(0, "a", *range(8))]
    given = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    ids = spark.createDataFrame([(2,), (5,)], "doc_id long")
    assert common.rows_with(given, ids).columns == names and sorted(r.doc_id for r in common.rows_with(given, ids).collect()) == [2, 5]
    assert sorted(r.doc_id for r in common.rows_without(given, ids).collect()) == [0, 0, 1, 3, 4]
    joined = common.rows_joined(given, spark.createDataFrame([(2, "x"), (9, "y")], "doc_id long, more string"))
    assert [(r.doc_id, r.more) for r in joined.collect()] == [(2, "x")]
    assert sorted(r.doc_id for r in minhash_dedup.deduplicated(given).collect()) == [0, 2, 4]
    assert secret_scan.redacted(given).columns == names and secret_scan.redacted(given).count() == 7


def test_chat_with_noncharacters_nulls_and_many_turns(spark):
    make = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns long, alone string")
    rows = [(1, 0, "tool﷐x", "hi﷑"), (1, 1, "assistant", "﷐" * 3), (None, 0, "assistant", "a"), (None, 0, "assistant", "b")]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", "word " * 40) for i in range(60)] + [(3, 0, "user", "x" * 200_000), (4, None, None, None)]
    got = {(r.conv_id, r.text if r.conv_id is None else None): r for r in chat.formatted(make([(*r, 7, "z") for r in rows])).collect()}
    first = got[1, None]
    assert [first.text[s.text_start : s.text_end] for s in first.spans] == ["hi﷑", "﷐" * 3] and first.loss_chars == 3
    assert len(got) == 6 and sum(r.loss_chars for (c, _), r in got.items() if c is None) == 2 and got[2, None].n_turns == 60 and got[2, None].loss_chars == 30 * 200
    assert got[3, None].turns_sha256 == hashlib.sha256(f"user\n{'x' * 200_000}\n".encode()).hexdigest() and got[4, None].formatted_chars == 24
    assert chat.formatted(make([])).count() == 0


def test_trigram_queries_of_many_rules(docs):
    rules = [secret_scan.Rule(f"k{i}", f"key{i:02d}zz[0-9]+") for i in range(40)] + [secret_scan.Rule("any", "[0-9]{5}")]
    assert sum(len(q) for r in rules for q in secret_scan.trigram_query(r.pattern)) > 62
    rows = [(i, f"see KEY{i:02d}ZZ7 and key{i:02d}zz{i}") for i in range(40)] + [(50, "12345"), (51, "key")]
    got = {r.doc_id: sorted(s.kind for s in r["__spans"]) for r in secret_scan.found(docs(rows), tuple(rules)).collect()}
    assert got == {**{i: [f"k{i}"] for i in range(40)}, 50: ["any"], 51: []}
    assert secret_scan.digest(docs([])).count() == 0
    for pattern, want in (("(abc)+d", [{"abc"}]), ("a[bc]d|xyz", [{"abd"}, {"acd"}, {"xyz"}]), ("(?i:ABC)?x", []), (r"ab\.c{2,3}[^x]", [{"ab."}]), ("(?=look)abc", [{"abc"}]), (r"\d+abc$", [{"abc"}])):
        assert sorted(map(sorted, secret_scan.trigram_query(pattern))) == sorted(map(sorted, want)), pattern


def test_warc_of_other_makers(spark, tmp_path):
    import gzip

    body = b"<html>\r\n\r\nx" * 20_000
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"

    def rec(kind, content, block, more=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}>\r\n{more}Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    typeless = b"WARC/1.0\r\nWARC-Record-ID: <urn:none>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    records = [rec("warcinfo", "application/warc-fields", b"software: x\r\n"), rec("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"), rec("response", "application/http; msgtype=response", http + body), rec("resource", "text/plain", b"plain\r\n\r\ntext"), rec("metadata", "application/http", b"no blank line"), typeless]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    warc.register(spark)
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    want = {"warcinfo": b"software: x\r\n", "request": b"", "response": body, "resource": b"plain\r\n\r\ntext", "metadata": b"no blank line", None: b"abc"}
    assert len(got) == 12 and all(bytes(r.payload) == want[r.record_type] and r.payload_bytes == len(want[r.record_type]) for r in got)
    assert warc.read_archives(spark, f"file://{tmp_path}").where("record_type is not null").count() == 10
    assert warc.read_archives(spark, f"file://{tmp_path}", ("record_id", "payload_bytes")).where("record_id = 'urn:resource'").count() == 2
    assert warc.resolved(spark, "/x/y") == "file:///x/y" and warc.resolved(spark, "viewfs://a/b") == "viewfs://a/b"


def test_warc_of_repeated_ids_long_payloads_and_clashing_columns(spark):
    long = "é" * 300_000
    rows = [(1, "u", long), (2, "u", long), (2, "v", long), (2, "w", "other"), (None, "n", long), (None, "n", None), (None, "m", "alone"), (7, None, "small")]
    pages = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "page_id long, url string, html string, n long, d string, first string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect())
    assert got == sorted([("1", 600_000, "revisit", 2), ("2", 600_000, "response", None), ("2", 600_000, "response", None), ("2", 5, "response", None), ("None", 600_000, "revisit", 2), ("None", 0, "response", None), ("None", 5, "response", None), ("7", 5, "response", None)])
