"""Operator 6, benchmark decontamination by template windows, in DataFrame functions only.

Texts become templates: numbers, units behind numbers and names turn into typed
placeholders, everything else into lower-case words. With sentence_names a capitalised
word that opens a sentence is a name too, if the benchmark never has it in lower case. Windows of 8 template
words are hash-joined with those of the benchmark; those of the benchmark with too few
words that are no placeholders are joined on their words as they stand, in lower case. A matched window says which value of
the document stands where the item has which; a question with other values put in is
caught when those slots are consistent, that is, one value of the item is always one
value of the document. Two numbers or units of the item may become the same one; two
names may not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 8
#: A window needs so many words that are no placeholders to be matched as a template; others are matched word for word.
LITERALS = 5
#: The least share of an item's windows that a contaminated document has.
COVERAGE = 0.1
#: An item's windows lie in one occurrence if no more words than this, or than the item has windows, were put in or left out between two.
SPREAD = 32
#: The benchmark's windows are broadcast up to this many (about 100 bytes each), and joined by a shuffle beyond.
BROADCAST_WINDOWS = 500_000

#: Parts that a window's items are met in where they are joined by a shuffle.
PARTS = 16

# Units of measure and currencies that may follow a number, as alternatives of an expression without regard to case.
UNITS = [
    "(?:kilo|hecto|deca|deci|centi|milli|micro|nano|mega|giga|tera)?(?:meter|metre|gram|liter|litre|watt|joule|volt|amp|ampere|byte|bit|hertz|calorie|pascal|newton|ohm|tonne)s?",
    "[kcmn]?[mgl]",
    "[kmgt]b",
    "[kmgt]?hz",
    "[km]wh?",
    *"mph kmh lb lbs oz ft inch inches foot feet".split(),
    "(?:yard|mile|acre|hectare|gallon|pint|quart|cup|ounce|pound|ton|knot|degree|dozen)s?",
    "(?:nano|micro|milli)?seconds?",
    "(?:minute|hour|day|week|month|year|decade)s?",
    "(?:dollar|euro|cent|franc|peso|rupee|ruble)s?",
    *"pence yen yuan percent".split(),
]

# Words that open sentences and are no names, in whatever case the benchmark has them.
OPENERS = (
    "a about after all also although an and any are as assume at because before between both but by calculate can compute consider could describe determine did do does each estimate "
    "evaluate every explain find first for from give given had has have he her here his how i if in is it its just let list look most my name no not now of on once one or our please "
    "read say select she should show since so solve some suppose tell that the their then there these they this those though thus to two use was we were what when where whether which "
    "while who whose why will with without would write yes yet you your"
).split()
#: Bits of the table of words that the benchmark has in lower case (or that open sentences): 32 kB whatever the benchmark. A name whose bit another word has set stays a word.
WORD_BITS = 18

# Sentinels of one character each, from the private use area; START stands before a capitalised word that opens a sentence.
NUMBER, UNIT, NAME, START = "\ue000", "\ue001", "\ue002", "\ue003"


def template_words(text: Column, plain: bytes | None) -> tuple[Column, Column]:
    """Words of a text as they stand, and their template forms, one for one.

    A word is a run of letters, digits and marks, also with . , : / or - between two
    digits. A number is a word that starts with a digit; a unit is one of UNITS right
    behind a number; a name is a capitalised word right behind a lower-case word, a
    comma or another name's word on the same line, or, given the plain words (the bits of
    _plain_words), one that opens a sentence or line and is none of them in lower case.
    """
    clean = F.coalesce(F.translate(text, NUMBER + UNIT + NAME + START, ""), F.lit(""))
    # marks in front of names and units survive the split as part of the word
    # looking for the capital first is quick, most places have none
    marked = F.regexp_replace(clean, r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll},] )", NAME)
    if plain is not None:
        marked = F.regexp_replace(marked, r"(?=\p{Lu}\p{Ll})(?:(?<![^\n])|(?<=[.!?:] ))", START)
    marked = F.regexp_replace(marked, rf"(?i)(\d ?)(?=(?:{'|'.join(UNITS)})(?![\p{{L}}\d]))", "$1" + UNIT)
    word = F.lit(rf"[{NAME}{UNIT}{START}]?(?:\d+(?:[.,:/-]\d+)*|[\p{{L}}\p{{M}}]+)")
    raw = F.transform(F.regexp_extract_all(marked, word, F.lit(0)), lambda w: F.translate(w, NAME + UNIT + START, ""))
    return raw, F.transform(F.regexp_extract_all(F.lower(marked), word, F.lit(0)), lambda w: _form(w, plain))


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(1 << WORD_BITS))


def _form(word: Column, plain: bytes | None) -> Column:
    inside = F.when((word >= "0") & (word < ":"), NUMBER).when(word.startswith(NAME), NAME).when(word.startswith(UNIT), UNIT)
    if plain is None:
        return inside.otherwise(word)
    bare = word.substr(F.lit(2), F.length(word))
    slot = _slot(bare)
    byte = F.conv(F.hex(F.lit(plain).substr(F.floor(slot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(slot, F.lit(8)))), F.lit(2)) == 1
    return inside.when(word.startswith(START), F.when(known, bare).otherwise(NAME)).otherwise(word)


def _plain_words(items: DataFrame) -> bytes:
    """The bits of words that the benchmark has in lower case, and of OPENERS: gathered by byte, 2 ** WORD_BITS / 8 numbers at most."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    rows = items.select(F.explode(words).alias("w")).where(F.col("w") == F.lower("w"))
    openers = items.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in OPENERS])).alias("w"))
    slots = rows.unionByName(openers).select(_slot(F.col("w")).alias("slot"))
    held = slots.groupBy(F.floor(F.col("slot") / 8).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot % 8 as int))")).alias("mask"))
    bits = bytearray((1 << WORD_BITS) // 8)
    for r in held.collect():
        bits[r["byte"]] = r["mask"]
    return bytes(bits)


def _windows(rows: DataFrame, key: str, kinds: list[tuple[int, bool]], plain: bytes | None) -> DataFrame:
    """Rows (key, size, exact, at, h): every window of a text's words for each of some (size, exact), from one split of the text.

    h is the hash of the window's template, or with exact that of its words in lower case.
    """
    raw, form = template_words(F.col("text"), plain)
    some = {exact for _, exact in kinds}
    split = rows.select(key, *([form.alias("form")] if False in some else []), *([raw.alias("raw")] if True in some else []))
    codes = {False: ("codes", lambda: F.transform("form", lambda w: F.xxhash64(w))), True: ("plain", lambda: F.transform("raw", lambda w: F.xxhash64(F.lower(w))))}
    hashed = split.withColumns({codes[e][0]: codes[e][1]() for e in some})
    n = F.size("form" if False in some else "raw")
    if len(kinds) == 1:
        ((size, exact),) = kinds
        # no condition on rows here: the optimiser would move it below the split and split every text once more for it
        windows = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), _window_at(size, codes[exact][0])))
        return hashed.select(key, F.explode(windows).alias("w")).select(key, F.lit(size).alias("size"), F.lit(exact).alias("exact"), "w.*")
    named = lambda size, exact: (F.lit(size).alias("size"), F.lit(exact).alias("exact"))
    each = [F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), _window_at(size, codes[exact][0], *named(size, exact)))) for size, exact in kinds]
    none = F.array().cast("array<struct<size:int,exact:boolean,at:int,h:bigint>>")
    return hashed.select(key, F.explode(F.concat(*[F.coalesce(e, none) for e in each])).alias("w")).select(key, "w.*")


def _window_at(size: int, codes: str, *more: Column):
    return lambda i: F.struct(*more, i.alias("at"), F.xxhash64(F.slice(F.col(codes), i + 1, F.lit(size))).alias("h"))


def _item_windows(items: DataFrame, plain: bytes | None) -> DataFrame:
    """Rows (item_id, size, exact, at, h, form, raw): the windows of a benchmark's items, of WINDOW words or of all that an item has."""
    raw, form = template_words(F.col("text"), plain)
    split = items.select("item_id", form.alias("form"), raw.alias("raw")).withColumn("n", F.size("form"))
    split = split.withColumn("codes", F.transform("form", lambda w: F.xxhash64(w))).withColumn("plain", F.transform("raw", lambda w: F.xxhash64(F.lower(w))))
    size = F.least(F.col("n"), F.lit(WINDOW))
    part = lambda c, i: F.slice(F.col(c), i + 1, F.col("size"))
    fields = lambda i: F.struct(i.alias("at"), F.xxhash64(part("codes", i)).alias("t"), F.xxhash64(part("plain", i)).alias("x"), part("form", i).alias("form"), part("raw", i).alias("raw"))
    windows = split.where("n > 0").withColumn("size", size).select("item_id", "size", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("size")), fields)).alias("w")).select("item_id", "size", "w.*")
    literal = F.size(F.filter("form", lambda x: ~x.isin(NUMBER, UNIT, NAME)))
    windows = windows.withColumn("exact", literal < F.least(F.lit(LITERALS), F.col("size")))
    return windows.select("item_id", "size", "exact", "at", F.when(F.col("exact"), F.col("x")).otherwise(F.col("t")).alias("h"), "form", "raw")


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, sentence_names: bool = False) -> DataFrame:
    """Per document and benchmark item that share template windows: doc_id, item_id, n_windows, item_windows, coverage, n_slots, n_changed, consistent, kind, contaminated.

    n_windows counts the item's windows that the document has, of item_windows; coverage
    is their share, or that among the item's windows matched as templates if greater (the
    others are matched word for word, so a question with other values can't have them). n_slots counts
    the item's distinct slot values in them, n_changed those that the document has
    otherwise, consistent says whether one value of the item is one value of the document
    and, for names, the reverse. kind is verbatim (no slot changed), reparameterised (changed
    consistently) or inconsistent. contaminated: coverage is at least the least share and
    the slots are consistent. Of several places in a document where an item's windows lie,
    the contaminated one counts, then the one with most windows. A place is one diagonal
    (windows at one distance from the item's) or all neighbouring ones, as words put in
    between make them.

    An item of fewer words than a window is one window of its own length. Null and blank
    texts have no windows; rows with a null id are left out; rows of one id are taken
    together. Empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id"), "text").where("doc_id is not null")
    items = benchmark.select(F.col("item_id"), "text").where("item_id is not null")
    schema = (
        "doc_id long, item_id long, n_windows long, item_windows long, coverage double, n_slots long, n_changed long, consistent boolean, kind string, contaminated boolean"
    )
    plain = _plain_words(items) if sentence_names else None
    of_items = _item_windows(items, plain)
    template_at = lambda c: F.countDistinct(F.when(~F.col("exact"), F.col(c)))
    item_windows = of_items.groupBy("item_id").agg(F.countDistinct("at").alias("item_windows"), template_at("at").alias("item_templates"))
    known = of_items.select("item_id", "size", "exact", F.col("at").alias("item_at"), "h", F.col("form").alias("item_form"), F.col("raw").alias("item_raw"))
    # the size of what is broadcast is checked; a larger benchmark is joined by a shuffle
    small = known.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    keys = known.select("h", "size", "exact").distinct()
    kinds = sorted((r["size"], r["exact"]) for r in keys.select("exact", "size").distinct().collect())
    if not kinds:
        return docs.sparkSession.createDataFrame([], schema)
    windows = _windows(rows, "doc_id", kinds, plain)
    hits = windows.join(F.broadcast(keys) if small else keys, ["h", "size", "exact"], "left_semi")
    of_docs = common.written(hits.select("doc_id", "size", "exact", "at", "h"), "hits")
    # the slot values are read again from the texts of the few documents with hits, at the hits
    places = of_docs.groupBy("doc_id").agg(F.collect_set(F.struct("size", "exact", "at", "h")).alias("places"))
    texts = common.rows_with(rows, of_docs.select("doc_id").distinct()).join(places, "doc_id")
    raw, form = template_words(F.col("text"), plain)
    words_at = lambda c, x: F.slice(F.col(c), x["at"] + 1, x["size"])
    at_hits = F.transform("places", lambda x: F.struct(x["size"].alias("size"), x["exact"].alias("exact"), x["at"].alias("at"), x["h"].alias("h"), words_at("form", x).alias("form"), words_at("raw", x).alias("raw")))
    hit = texts.select("doc_id", "places", raw.alias("raw"), form.alias("form")).select("doc_id", F.explode(at_hits).alias("w")).select("doc_id", "w.*")
    # a window that very many items and documents share is met in parts
    parts = 1 if small else PARTS
    hit = hit.withColumn("part", F.pmod(F.xxhash64("doc_id", "at"), F.lit(parts)))
    every = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    hit = hit.join(F.broadcast(every) if small else every, ["h", "size", "exact", "part"])
    lower = lambda c: F.transform(c, lambda w: F.lower(w))
    same = F.when(F.col("exact"), lower("raw") == lower("item_raw")).otherwise(F.col("form") == F.col("item_form"))
    slots = F.filter(
        F.arrays_zip("item_form", "item_raw", "raw"), lambda s: s["item_form"].isin(NUMBER, UNIT, NAME)
    )
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    found = hit.where(same).select("doc_id", "item_id", shift, "item_at", "exact", F.transform(slots, lambda s: F.struct(F.lower(s["item_raw"]).alias("was"), F.lower(s["raw"]).alias("now"), (s["item_form"] == NAME).alias("name"))).alias("slots"))
    # windows on one diagonal are one occurrence of the item, and so are those on neighbouring diagonals; each counts by itself and with the others
    ordered = Window.partitionBy("doc_id", "item_id").orderBy("shift")
    near = F.least(F.lit(SPREAD), F.col("item_windows"))
    found = found.join(F.broadcast(item_windows) if small else item_windows, "item_id")
    found = found.withColumn("apart", F.coalesce(F.col("shift") - F.lag("shift").over(ordered) > near, F.lit(True)))
    found = found.withColumn("run", F.sum(F.col("apart").cast("long")).over(ordered))
    of_run = Window.partitionBy("doc_id", "item_id", "run")
    found = found.withColumn("several", F.min("shift").over(of_run) < F.max("shift").over(of_run))
    found = common.written(found.drop("apart", "item_windows", "item_templates"), "slots")
    of_diagonal, of_several = (F.struct(F.lit(k).alias("joined"), F.col(c).cast("long").alias("at")) for k, c in ((False, "shift"), (True, "run")))
    places = F.when(F.col("several"), F.array(of_diagonal, of_several)).otherwise(F.array(of_diagonal))
    found = found.withColumn("place", F.explode(places))
    place = ["doc_id", "item_id", "place"]
    counted = found.groupBy(*place).agg(F.countDistinct("item_at").alias("n_windows"), template_at("item_at").alias("n_templates"))
    pairs = found.select(*place, F.explode("slots").alias("s")).groupBy(*place, "s.was", "s.now").agg(F.max("s.name").alias("name"))
    of_names = lambda c: F.countDistinct(F.when(F.col("name"), F.col(c)))
    judged = pairs.groupBy(*place).agg(
        F.countDistinct("was").alias("n_slots"),
        F.count(F.lit(1)).alias("n_pairs"),
        of_names("was").alias("n_names"),
        of_names("now").alias("n_names_now"),
        F.sum(F.when(F.col("was") != F.col("now"), 1).otherwise(0)).alias("n_changed"),
    )
    joined = counted.join(judged, place, "left").join(F.broadcast(item_windows) if small else item_windows, "item_id")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    consistent = (n("n_pairs") == n("n_slots")) & (n("n_names") == n("n_names_now"))
    share = F.greatest(F.col("n_windows") / F.col("item_windows"), F.when(F.col("item_templates") > 0, F.col("n_templates") / F.col("item_templates")))
    best = F.struct(
        (consistent & (share >= coverage)).alias("contaminated"),
        F.col("n_windows"),
        share.alias("coverage"),
        (-n("n_changed")).alias("kept"),
        n("n_slots").alias("n_slots"),
        consistent.alias("consistent"),
        "item_windows",
    )
    top = joined.groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
    changed = -F.col("b.kept")
    return top.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("item_id").cast("long").alias("item_id"),
        "b.n_windows",
        "b.item_windows",
        "b.coverage",
        "b.n_slots",
        changed.alias("n_changed"),
        "b.consistent",
        F.when(changed == 0, "verbatim").when(F.col("b.consistent"), "reparameterised").otherwise("inconsistent").alias("kind"),
        "b.contaminated",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, sentence_names: bool = False) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; rows without doc_id stay."""
    bad = common.written(matches(docs, benchmark, coverage, sentence_names).where("contaminated").select("doc_id").distinct(), "contaminated")
    return common.rows_without(docs, bad)
