"""Operator 10, toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, intent, negation, report, quote, clause
end, other). Five transducers read the symbols one after the other: insults and threats
mark hits, targets raise them, negation and reported speech lower them. Composed they are
one machine whose transitions carry a symbol and a factor; a clause weighs what its hits
weigh, and a text's score is 1 - 4**-(sum of its clauses), so one plain insult scores 0.75.

What counts as an insult is a list of fixed words and a lexicon learnt from labelled
rows: words, or beginnings of words, that toxic texts have and others have not. A beginning
that tells toxic texts only where two or three different words have it makes these words
weak or faint insults: so many of them weigh what one plain insult does, and a word said
again adds nothing.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import bounded_sample, remainder

#: Labelled rows that the lexicon is learnt from at most, those with the smallest hashes of their doc_id.
FIT_ROWS = 30_000
#: A term is taken if this share of all texts that have it are toxic, and if chance would so seldom make any of all terms look like that.
PURITY, CHANCE = 0.9, 0.01
#: Beginnings of words that may be terms, in characters.
STEMS = (4, 5, 6, 7)
#: What insults of words that tell only by twos and by threes weigh.
WEIGHTS = {2: 0.45, 3: 0.3}

# Words of the grammar's classes in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons scum trash clown stupid worthless pathetic disgusting loser losers imbecile bastard abschaum dummkopf vollidiot crétin connard idiota imbécil estúpido".split()
THREATS = "kill hurt destroy beat stab shoot töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yourself he she they them him her du dich dir ihr euch sie toi vous te tú ti usted ustedes ellos".split()
INTENTS = "will shall gonna going must werde werden wird vais va voy vamos".split()
NEGATIONS = "not never no isn't aren't nicht kein keine keinen nie pas jamais ni nunca".split()
REPORTS = "said says say wrote told called calls claimed alleged quoted sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó".split()

INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT, QUOTE, END, OTHER, HIT, WEAK, FAINT = range(12)
SYMBOLS = range(12)


class Transducer:
    """A deterministic weighted transducer: step[state][symbol] is (next state, symbol out, factor)."""

    def __init__(self, step: list[dict[int, tuple[int, int, float]]]):
        self.step = [{s: row.get(s, (k if s != END else 0, s, 1.0)) for s in SYMBOLS} for k, row in enumerate(step)]

    def then(self, other: Transducer) -> Transducer:
        """The machine that feeds this one's output to the other; factors multiply. Only states that can be reached are kept."""
        number, todo, rows = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            row = {}
            for s in SYMBOLS:
                a2, out, x = self.step[a][s]
                b2, out2, y = other.step[b][out]
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                row[s] = (number[a2, b2], out2, x * y)
            rows.append(row)
        return Transducer(rows)

    def clauses(self, symbols) -> list[float]:
        """The weight of each clause that has hits."""
        state, held, out = 0, 0.0, []
        for s in symbols:
            state, said, factor = self.step[state][s]
            if said == HIT:
                held += factor
            if s == END and held:
                out.append(held)
                held = 0.0
        return [*out, held] if held else out


def grammar() -> Transducer:
    insult = Transducer([{INSULT: (0, HIT, 1.0), WEAK: (0, HIT, WEIGHTS[2]), FAINT: (0, HIT, WEIGHTS[3])}])
    # a threat is a verb of violence behind an intent, or at a target
    threat = Transducer([{INTENT: (1, INTENT, 1.0), THREAT: (2, OTHER, 1.0)}, {THREAT: (0, HIT, 1.2)}, {TARGET: (0, HIT, 0.8), OTHER: (0, OTHER, 1.0)}])
    # a target earlier in the clause raises what hits it
    target = Transducer([{TARGET: (1, TARGET, 1.0)}, {HIT: (1, HIT, 1.5)}])
    # a negation reaches over one word
    negation = Transducer([{NEGATION: (1, NEGATION, 1.0)}, {HIT: (0, HIT, 0.4), **{s: (2, s, 1.0) for s in (TARGET, INTENT, REPORT, OTHER)}}, {HIT: (0, HIT, 0.4), **{s: (0, s, 1.0) for s in (TARGET, INTENT, REPORT, OTHER)}}])
    # what follows a verb of speech in its clause, or stands in quotes behind one, is reported
    report = Transducer([{REPORT: (1, REPORT, 1.0)}, {HIT: (1, HIT, 0.5), QUOTE: (2, QUOTE, 1.0)}, {HIT: (2, HIT, 0.5), QUOTE: (0, QUOTE, 1.0), END: (2, END, 1.0)}])
    return insult.then(threat).then(target).then(negation).then(report)


_PLAIN = (("“", '"'), ("”", '"'), ("„", '"'), ("«", '"'), ("»", '"'), ("’", "'"))


def _words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case; start, end and kind (1 word, 2 clause end, 3 quote) of their runs; where each text starts."""
    low = []
    for t in texts:
        t = t.lower() if isinstance(t, str) else ""
        for a, b in _PLAIN:
            t = t.replace(a, b)
        low.append(t)
    data, starts = common.pack(low)
    table = np.zeros(256, dtype=np.uint8)
    table[[*range(48, 58), *range(97, 123), *range(128, 256), 39]] = 1
    table[[ord(c) for c in ".!?;\n"]] = 2
    table[ord('"')] = 3
    kind = table[data]
    edge = starts[1:-1] - 1  # the space behind a text also ends its clause
    kind[edge] = 2
    start, end, kind = common.runs(kind)
    return data, start, end, kind, starts


class Lexicon:
    """Insult terms with their purities: whole words, beginnings (marked by a star), and those that are weak (by two) or faint (by three)."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        classes = [(THREATS, THREAT), (TARGETS, TARGET), (INTENTS, INTENT), (NEGATIONS, NEGATION), (REPORTS, REPORT), ([t for t in terms if t[-1] != "*"], INSULT)]
        self.words = {w: c for some, c in classes for w in some}
        marks = {1: INSULT, 2: WEAK, 3: FAINT}
        self.stems = {t.rstrip("*"): marks[len(t) - len(t.rstrip("*"))] for t in sorted(terms, key=len, reverse=True) if t[-1] == "*"}

    def symbols(self, data, start, end, kind, doc) -> np.ndarray:
        out = np.full(len(start), OTHER, dtype=np.int64)
        out[kind == 2], out[kind == 3] = END, QUOTE
        hashed = common.Hasher(data)
        word = kind == 1
        code = np.where(word, hashed(start, end), 0)
        faint, weak, plain = ({s: c for s, c in self.stems.items() if c == mark} for mark in (FAINT, WEAK, INSULT))
        for some, full in ((faint, False), (weak, False), (plain, False), (self.words, True)):
            by_size: dict[int, list[str]] = {}
            for w in some:
                by_size.setdefault(0 if full else len(w.encode()), []).append(w)
            for size, same in by_size.items():
                have, _, ends, _, starts = _words(same)
                known = common.Hasher(have)(starts[:-1], starts[1:] - 1)
                order = np.argsort(known)
                label = np.array([some[w] for w in same])[order]
                at = np.flatnonzero(word & (end - start > size)) if size else np.flatnonzero(word)
                mine = hashed(start[at], start[at] + size) if size else code[at]
                hit = np.searchsorted(known[order], mine).clip(0, len(known) - 1)
                ok = known[order][hit] == mine
                out[at[ok]] = label[hit[ok]]
        # of a text's weak and faint words each counts where it comes first
        soft = np.flatnonzero((out == WEAK) | (out == FAINT))
        again = np.ones(len(soft), dtype=bool)
        again[np.unique(np.stack((doc[soft].astype(np.uint64), code[soft])), axis=1, return_index=True)[1]] = False
        out[soft[again]] = OTHER
        return out


def score_texts(texts, lexicon: Lexicon, machine: Transducer) -> np.ndarray:
    data, start, end, kind, starts = _words(texts)
    doc = common.owner(starts, start)
    symbols = lexicon.symbols(data, start, end, kind, doc)
    out = np.zeros(len(starts) - 1)
    hot = np.unique(doc[(symbols == INSULT) | (symbols == THREAT) | (symbols == WEAK) | (symbols == FAINT)])
    lo, hi = np.searchsorted(doc, hot), np.searchsorted(doc, hot, side="right")
    for d, i, j in zip(hot, lo, hi, strict=True):
        out[d] = 1 - 4.0 ** -min(sum(machine.clauses(symbols[i:j].tolist())), 30.0)
    return out


def _terms(text: str) -> set[str]:
    """A text's words, beginnings of words with a star, and with two or three those of so many different words or more."""
    words, stems = set(), Counter()
    data, start, end, kind, _ = _words([text])
    raw = data.tobytes()
    for a, b in zip(start[kind == 1].tolist(), end[kind == 1].tolist(), strict=True):
        words.add(raw[a:b].decode("utf-8", "replace"))
    for w in words:
        stems.update(w[:k] for k in STEMS if len(w) > k)
    return {*words, *(s + "*" * r for s, n in stems.items() for r in (1, *WEIGHTS) if n >= r)}


def _telling(toxic: int, clean: int, rate: float, terms: int) -> bool:
    """Whether a term is pure, and would so rarely be by chance (a bound of Chernoff's, over all terms)."""
    n = toxic + clean
    q = toxic / n
    if q < PURITY or q <= rate:
        return False
    apart = q * math.log(q / rate) + ((1 - q) * math.log((1 - q) / (1 - rate)) if clean else 0.0)
    return n * apart > math.log(terms / CHANCE)


def learn(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS, fixed: list[str] = INSULTS) -> Lexicon:
    """A lexicon from labelled rows with crc32(doc_id) mod 3 other than 1, and fixed insults.

    Terms are counted over the sample in Spark. Of the telling terms each toxic text names
    the one that most toxic texts have, and terms named at least twice are kept: words
    that only come along with an insult are never named. What the driver gets is bounded
    by the sample. Without toxic or without other rows only the fixed insults are there.
    """
    chosen = bounded_sample(docs, labels, "toxic", 3, 1, bound)

    def count(batches):
        toxic, clean = Counter(), Counter()
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                (toxic if y else clean).update(_terms(text))
        every = list(toxic | clean)
        for i in range(0, len(every), 20_000):
            some = every[i : i + 20_000]
            yield pd.DataFrame({"term": pd.Series(some, dtype=object), "toxic": [toxic[t] for t in some], "clean": [clean[t] for t in some]})

    counted = chosen.select("text", "y").mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = common.written(counted, "terms")
    n_rows, n_toxic = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < n_toxic < n_rows:
        return Lexicon({w: 1.0 for w in fixed})
    rate, n_terms = n_toxic / n_rows, counted.count()
    pure = counted.where(f"toxic >= 3 and toxic >= {PURITY} * (toxic + clean)").toPandas()
    told = [_telling(t, c, rate, n_terms) for t, c in zip(pure["toxic"], pure["clean"], strict=True)]
    pure = pure[np.array(told, dtype=bool)]
    support = dict(zip(pure["term"], pure["toxic"], strict=True))
    purity = dict(zip(pure["term"], pure["toxic"] / (pure["toxic"] + pure["clean"]), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(support)

    def name(batches):
        best = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                own = [t for t in _terms(text) if t in shared.value]
                if own:
                    best[max(own, key=lambda t: (shared.value[t], t))] += 1
        yield pd.DataFrame({"term": pd.Series(list(best), dtype=object), "n": list(best.values())})

    named = chosen.where("y = 1").select("text").mapInPandas(name, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where("n >= 2").toPandas()
    return Lexicon({w: 1.0 for w in fixed} | {t: float(purity[t]) for t in sorted(named["term"])})


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """Per row of docs (doc_id, text; null text: empty): doc_id, held_out, score, predicted.

    A text without hits, or without words, scores 0. Equal texts have equal scores. Other
    columns are ignored; an empty table gives no rows.
    """
    score = _score(docs, lexicon)
    rows = docs.select("doc_id", score(F.coalesce("text", F.lit(""))).alias("score"))
    held = (remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    return rows.select("doc_id", held, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def _score(docs: DataFrame, lexicon: Lexicon):
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, grammar()))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        lexicon, machine = shared.value
        out = np.zeros(len(texts))
        for i, j in common.in_pieces(texts.to_frame("text"), ["text"]):
            out[i:j] = score_texts(texts.iloc[i:j], lexicon, machine)
        return pd.Series(out)

    return score


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns."""
    return docs.where(_score(docs, lexicon)(F.coalesce("text", F.lit(""))) < threshold)
