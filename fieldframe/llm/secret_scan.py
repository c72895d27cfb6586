r"""Operator 7, secret scans over a trigram index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: a text
that matches must hold all trigrams of one alternative at least. Postings list, for each
trigram that any rule asks for, the documents that hold it; a rule's candidates are the
documents found in all postings of one of its alternatives, and only they are verified
with the expression. A rule without mandatory trigrams scans all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern that Java's and Python's engines read alike; what it matches must not lie inside longer text of the same kind.

    Of matches only those whose capture group has least characters count.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Base rules in their listed order, then further ones. A greedy run of a class with a
#: least length ({24,}) finds what a run of any length finds, less the short ones.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
#: An expression's parts are spelled out up to this many strings; beyond, trigrams come from its pieces.
SPELLED = 64
OPEN, CLOSE, PLAIN = "\x01", "\x02", "\x03"


class _Expression:
    """Reads a regular expression from left to right for the strings that its parts can match.

    part() gives a pair: the set of all strings that a part can match (None: too many to
    spell out), and pieces, sets of strings of which one each is surely in a match.
    """

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def next_is(self, text: str) -> bool:
        if self.pattern.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def part(self):
        """Branches up to a closing bracket or the end."""
        branches = [self.sequence()]
        while self.next_is("|"):
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        return (set().union(*[b[0] for b in branches]) if all(b[0] is not None for b in branches) else None), []

    def sequence(self):
        exact: set[str] = {""}
        pieces: list[set[str]] = []
        cut = False
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            some, inner = self.repeated()
            grown = {a + b for a, b in product(exact, some)} if some is not None else None
            if grown is not None and len(grown) <= SPELLED:
                exact = grown
                continue
            pieces += [exact] if exact != {""} else []
            pieces += inner
            exact, cut = (some if some is not None else {""}), True
        if not cut:
            return exact, []
        return None, pieces + ([exact] if exact != {""} else [])

    def repeated(self):
        some, inner = self.atom()
        counted = re.compile(r"([*+?]|\{(\d*)(,?)(\d*)\})[?+]?").match(self.pattern, self.at)
        if not counted:
            return some, inner
        self.at = counted.end()
        least = {"*": 0, "?": 0, "+": 1}.get(counted[1], int(counted[2] or 0))
        if counted[1] == "?" or counted[1] in ("{0,1}", "{,1}"):
            return (some | {""} if some is not None else None), []
        if counted[1] == "{1}":
            return some, inner
        # what is repeated once at least is surely there once
        return None, ([some] if some else inner) if least else []

    def atom(self):
        c = self.pattern[self.at]
        self.at += 1
        if c == "(":
            if self.next_is("?"):
                if re.compile(r"<?[=!]").match(self.pattern, self.at):
                    self.at = re.compile(r"<?[=!]").match(self.pattern, self.at).end()
                    self.part()
                    self.at += 1
                    return {""}, []
                self.at = re.compile(r"P?<\w+>|[a-zA-Z-]*:|[a-zA-Z-]*(?=\))").match(self.pattern, self.at).end()
            inside = self.part()
            self.at += 1
            return inside
        if c == "[":
            return self.bracket(), []
        if c == "\\":
            return self.escaped(), []
        if c in "^$":
            return {""}, []
        return (None if c == "." else {c}), []

    def escaped(self) -> set[str] | None:
        found = re.compile(r"x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.)", re.DOTALL).match(self.pattern, self.at)
        self.at = found.end()
        if found[3] is None:
            return {chr(int(found[1] or found[2], 16))}
        if found[3] in "bBAzZ":
            return {""}
        control = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}
        return {control[found[3]]} if found[3] in control else None if found[3].isalnum() else {found[3]}

    def bracket(self) -> set[str] | None:
        """The characters of a class of eight at most; None for larger, negated and ranged ones."""
        held: set[str] | None = None if self.next_is("^") else set()
        first = True
        while first or self.pattern[self.at] != "]":
            first, c = False, self.pattern[self.at]
            self.at += 1
            one = self.escaped() if c == "\\" else {c}
            if self.pattern[self.at] == "-" and self.pattern[self.at + 1] != "]":
                self.at += 2 + (self.pattern[self.at + 1] == "\\")
                one = None
            held = held | one if held is not None and one is not None else None
        self.at += 1
        return held if held is not None and len(held) <= 8 else None


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of which one holds, each a set of lower-case trigrams that are all there; empty: nothing is mandatory.

    The piece whose alternatives all have trigrams, and the most at least, is asked for.
    """
    whole, pieces = _Expression(pattern).part()
    choices = [whole] if whole is not None else pieces
    grams = [[frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in piece] for piece in choices]
    usable = [sorted({a for a in g if not any(b < a for b in g)}, key=sorted) for g in grams if g and all(g)]
    return max(usable, key=lambda g: min(map(len, g)), default=[])


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Rows (trigram, doc_id): which of the trigrams each text holds, letters in either case."""
    low = F.lower("text")
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in trigrams]), lambda g: g.isNotNull())
    return docs.select("doc_id", low.alias("low")).select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """Rows (doc_id, rules): per document the kinds whose trigram query it meets; rules that scan fully are not listed."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    needed = sorted(set().union(*[g for q in queries.values() for g in q])) if any(queries.values()) else []
    if not needed:
        return docs.select("doc_id", F.array().cast("array<string>").alias("rules")).limit(0)
    bit = {g: i for i, g in enumerate(needed)}
    listed = postings(docs, needed)
    # bits of trigrams in words of 62, as many words as they need
    words = range(-(-len(bit) // 62))
    own = {w: [(g, i % 62) for g, i in bit.items() if i // 62 == w] for w in words}
    number = lambda w: F.create_map(*[x for g, i in own[w] for x in (F.lit(g), F.lit(1 << i))])[F.col("trigram")]
    met = listed.groupBy("doc_id").agg(*[F.coalesce(F.bit_or(number(w).cast("long")), F.lit(0)).alias(f"met{w}") for w in words])
    asked = []
    for kind, query in queries.items():
        holds = F.lit(False)
        for alternative in query:
            every = F.lit(True)
            for w in words:
                mask = sum(1 << (bit[g] % 62) for g in alternative if bit[g] // 62 == w)
                if mask:
                    every = every & (F.col(f"met{w}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
            holds = holds | every
        if query:
            asked.append(F.when(holds, F.lit(kind)))
    return met.select("doc_id", F.filter(F.array(*asked), lambda k: k.isNotNull()).alias("rules")).where(F.size("rules") > 0)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of a rule's matches, leftmost first, in code points.

    Matches are wrapped in two control characters (the text's own ones of these were put
    aside, one for one) and the text is split there, so every second piece is a match
    and lengths add up to positions.
    """
    wrapped = F.regexp_replace(text, rule.pattern, OPEN + "$0" + CLOSE)
    pieces = F.split(wrapped, f"[{OPEN}{CLOSE}]")
    step = lambda acc, piece: F.struct(
        (acc["at"] + F.char_length(piece)).alias("at"),
        (~acc["hit"]).alias("hit"),
        F.when(
            acc["hit"] & (F.char_length(F.regexp_extract(piece, rule.pattern, rule.group)) >= rule.least),
            F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), F.lit(order).alias("order"), (acc["at"] + F.char_length(piece)).alias("end"), F.lit(rule.kind).alias("kind")))),
        ).otherwise(acc["found"]).alias("found"),
    )
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("found"))
    found = F.aggregate(pieces, first, step)["found"]
    return F.when(F.contains(wrapped, F.lit(OPEN)), found).otherwise(none)


def found(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs (doc_id, text and whatever else) with an array column __spans of (start, order, end, kind), by start and then rule.

    Null and empty texts have none. A row without doc_id is verified with every rule.
    Rows of one doc_id share their candidates, so each is verified where one of them is.
    If docs has a column __spans, underscores set the new one's name apart.
    """
    return _found(docs, rules)[0]


def _found(docs: DataFrame, rules) -> tuple[DataFrame, str]:
    spans, asked_for = common.unused(docs.columns, "__spans", "__rules")
    kinds = candidates(docs.where("doc_id is not null"), rules)
    chosen = common.written(kinds.select("doc_id", F.col("rules").alias(asked_for)), "candidates")
    clean = F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, PLAIN + PLAIN)
    full = [(i, r) for i, r in enumerate(rules) if not trigram_query(r.pattern)]
    asked = [(i, r) for i, r in enumerate(rules) if trigram_query(r.pattern)]

    def scanned(rows, which, test):
        parts = [(F.when(F.array_contains(asked_for, r.kind), spans_of(clean, r, i)) if test else spans_of(clean, r, i)) for i, r in which]
        none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
        return rows.withColumn(spans, F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts])) if parts else none)

    columns = [*docs.columns, spans]
    picked = chosen.select("doc_id")
    plain = scanned(common.rows_without(docs, picked).where("doc_id is not null"), full, False)
    loose = scanned(docs.where("doc_id is null"), full + asked, False)
    rows = common.rows_joined(docs, chosen)
    rows = rows.withColumn(asked_for, F.concat(asked_for, F.array(*[F.lit(r.kind) for _, r in full]).cast("array<string>")))
    verified = scanned(rows, full + asked, True)
    return plain.select(*columns).unionByName(verified.select(*columns)).unionByName(loose.select(*columns)), spans


def redacted(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with every secret's characters replaced by [kind]; overlapping secrets become one, named by the first. n_chars is set anew where there is one."""
    rows, spans = _found(docs, rules)
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")))
        .otherwise(acc["out"])
        .alias("out"),
    )
    done = F.aggregate(F.col(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.lit(2**31 - 1))))
    rows = rows.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = found(docs.select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("__spans", lambda s: s["order"] < len(BASE))
    n = lambda i: F.size(F.filter("__spans", lambda s: s["order"] == i)).cast("long")
    return rows.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans")
    )
