"""Re-parameterised questions whose names open sentences and whose units come from patterns; frequent keys of shards."""

import random

import pytest

from fieldframe.llm import decontaminate, sharding


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")


def test_names_that_open_sentences(spark, docs):
    items = [
        (1, "Tom sold 5 kites. Ann sold 3 kites. Who sold more?"),
        (2, "A runner ran 12 kilometers before noon and then walked back home again"),
        (3, "kestrel flies over the river and lands on the old mill each day"),
    ]
    rows = [
        (10, "Max sold 8 kites. Eva sold 2 kites. Who sold more?"),
        (11, "A runner ran 4 miles before noon and then walked back home again"),
        (12, "Kestrel flies over the river and lands on the old mill each day"),
        (13, "We saw kites. They sold well. Who sold more of them nobody knows."),
        (14, "A runner ran home before noon and then slept"),
        (15, "Max sold 8 kites. Max sold 2 kites. Who sold more?"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, r.contaminated) for r in decontaminate.matches(docs(rows), bench, sentence_names=True).collect()}
    assert got == {
        (10, 1): ("reparameterised", True),
        (11, 2): ("reparameterised", True),
        (12, 3): ("verbatim", True),
        (15, 1): ("reparameterised", True),
    }
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs(rows), bench, sentence_names=True).collect()) == [13, 14]


UNITS = "kilometers kilograms milligrams megabytes gallons pounds kg cm mL GB kWh tonnes hours cents"


def test_units_and_no_units(spark, docs):
    rows = [(i, f"it took 7 {u} of it") for i, u in enumerate(UNITS.split())] + [(100, "it took 7 kites of it"), (101, "it took 7 ago"), (102, "7kg"), (103, "7th")]
    d = docs(rows)
    plain = decontaminate._plain_words(spark.createDataFrame([(1, "x")], "item_id long, text string"))
    form = decontaminate.template_words(d["text"], plain)[1]
    got = {r.doc_id: list(r.form) for r in d.select("doc_id", form.alias("form")).collect()}
    assert all(got[i][3] == decontaminate.UNIT for i in range(len(UNITS.split()))) and got[102] == [decontaminate.NUMBER, decontaminate.UNIT]
    assert got[100][3] == "kites" and got[101][3] == "ago" and decontaminate.UNIT not in got[103]


@pytest.mark.parametrize("size", [1, 3, decontaminate.WINDOW])
def test_texts_are_split_once(spark, docs, size):
    """The optimiser makes no second split of each text, and texts shorter than a window have none."""
    d = docs([(1, "Ann has 12 kg of it"), (2, "so it is"), (3, "word"), (4, ""), (5, None)])
    plain = decontaminate._plain_words(spark.createDataFrame([(1, "x")], "item_id long, text string"))
    windows = decontaminate._windows(d, "doc_id", [(size, False)], plain)
    assert windows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    got = sorted((r.doc_id, r["size"], r.exact, r["at"]) for r in windows.collect())
    assert got == [(i, size, False, k) for i, n in ((1, 6), (2, 3), (3, 1)) for k in range(n - size + 1)]


def test_templates_recalled_with_other_names_and_numbers(spark, docs):
    """Of ten templates with five fills each every one is found; clean prose is not."""
    rng = random.Random(5)
    names, things = ["Olga", "Pedro", "Quinn", "Ravi", "Sana", "Theo", "Uma", "Viktor"], ["apples", "marbles", "stamps", "pencils"]
    templates = [
        "{n} has {a} {t} and gives {b} {t} to a friend. How many {t} are left for {m}?",
        "{n} drives {a} kilometers in {b} hours. What is the average speed of the car on that road?",
        "{n} buys {a} kilograms of flour and uses {b} kilograms for bread. How much flour is left over?",
        "{n} reads {a} pages each day for {b} days. How many pages are read in all of that time?",
        "A tank holds {a} liters and loses {b} liters each hour. When will the tank be quite empty?",
        "{n} earns {a} dollars and spends {b} dollars on food. What share of the money is then saved?",
        "{n} and {m} share {a} {t} in equal parts. How many {t} does each of them get to keep?",
        "A box weighs {a} pounds and a bag weighs {b} pounds. How much heavier is the box than the bag?",
        "{n} sleeps {a} hours and works {b} hours a day. How many hours of the day are still free?",
        "{n} plants {a} trees in {b} rows of equal length. How many trees stand in each of these rows?",
    ]
    fill = lambda s, t, n, m: s.format(n=n, m=m, a=rng.randint(20, 90), b=rng.randint(2, 19), t=t)
    items = [(i, fill(s, things[i % 4], "Olga", "Pedro")) for i, s in enumerate(templates)]
    rows = [(100 * i + k, "Some notes on sums. " + fill(s, things[i % 4], *rng.sample(names[2:], 2)) + " That was all.") for i, s in enumerate(templates) for k in range(5)]
    clean = [(5000 + k, " ".join(rng.choice("the of river market history garden they walked slowly each day how many people were there in it".split()) for _ in range(60)).capitalize() + ".") for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.matches(docs(rows + clean), bench, sentence_names=True).where("contaminated").collect()]
    found = {d for d, i in got if d // 100 == i}
    assert len(found) == len(rows) and not [d for d, _ in got if d >= 5000]


def test_frequent_keys_of_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "UNROLLED", 7)
    rng = random.Random(6)
    rows = [(None, f"text {rng.randrange(40)}") for _ in range(150)] + [(5, "same")] * 100 + [(k, None) for k in range(100, 160)]
    got = sharding.sharded(docs(rows)).collect()
    assert len(got) == len(rows)
    for shard in range(16):
        mine = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and sum(r.doc_id == 5 for r in got) == 100
    same = [r for r in got if r.doc_id == 5]
    assert max(r.slot for r in same) - min(r.slot for r in same) == 99
