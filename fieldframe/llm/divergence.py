"""Operator 12, source divergence audit by Gustavson's row accumulation.

Each (lang, source) group is a row of a sparse matrix over the terms its language keeps;
the same entries ordered by term are the index. In every task a group scatters its terms
through the index into a dense accumulator over its peers, so no pair of postings is ever
emitted: a task writes one number per pair of groups. A peer without a term still has a share, so
the accumulator holds differences from the shares of absent terms and these zero
baselines are added from counts alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Shares are counted in 1 / UNIT.
UNIT = 1_000_000_000
#: A term stays if this many documents of its language have it.
LEAST_DOCUMENTS = 3
TOP = 200
#: Groups of one language that meet in one accumulator; more groups are met tile by tile.
CHUNK = 512
#: Postings in one round of numpy work, and distinct (group, term) a counting task holds.
POSTINGS, HELD = 1 << 18, 1 << 19
#: Slices in which a group's best terms are picked before they meet.
SLICES = 16
#: Postings that a task is planned for.
PER_TASK = 2_000_000

# letters of any script as bytes of UTF-8: A-Z in lower case, all other ASCII is blank
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of terms; a long text comes in slices that end between terms."""
    data = text.translate(_LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), held (documents that have it); a row with an empty term for every group that occurs."""

    def run(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for name, text in zip(names, batch.column("text").cast(pa.binary()), strict=True):
                n, held = groups.setdefault(name, (Counter(), Counter()))
                own = set()
                for some in _words(text.as_py()):
                    n.update(some)
                    own.update(some)
                held.update(own)
                held[b""] = 0
            if sum(len(n) for n, _ in groups.values()) >= HELD:
                yield from emitted(groups)
                groups = {}
        yield from emitted(groups)

    def emitted(groups):
        for (lang, source), (n, held) in groups.items():
            terms = pa.array(list(held), type=pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(held)), pa.repeat(source, len(held)), terms, pa.array([n[t] for t in held], pa.int64()), pa.array(list(held.values()), pa.int64())], names=["lang", "source", "term", "n", "held"]
            )

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, "lang string, source string, term string, n long, held long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / total), exact for any long n < total: three decimals of the quotient at a time."""
    rest = n + 1
    out, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + out


def gains(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are below 2^30, so squares fit."""
    return (p - q) ** 2 // q


class _Tile:
    """The groups of one language in one or two chunks, and the accumulators of their pairs."""

    def __init__(self, lang: str, a: int, b: int):
        self.lang, self.a, self.b = lang, a, b
        self.names: list[str] = []
        self.chunks: list[int] = []
        self.totals: list[int] = []
        self.kept = self.of_lang = 0
        self.first = False
        self.rows = None

    def head(self, source: str, chunk: int, n: int, of_lang: int, kept: int, first: bool) -> None:
        """A group: its occurrences of kept terms, those of its language, and how many terms that keeps. The first task also counts what no group has."""
        self.names.append(source)
        self.chunks.append(chunk)
        self.totals.append(n)
        self.kept, self.of_lang, self.first = kept, of_lang, first

    def ready(self) -> None:
        if self.rows is not None:
            return
        self.place = {s: i for i, s in enumerate(self.names)}
        self.rows = np.zeros((len(self.names), len(self.names)), dtype=np.int64)
        self.size = np.array(self.totals, dtype=np.int64) + self.kept
        self.absent = shares(np.zeros(len(self.names), dtype=np.int64), np.maximum(self.size, 1))
        self.top: list[list[tuple[int, bytes]]] = [[] for _ in self.names]
        chunk = np.array(self.chunks)
        left, right = np.flatnonzero(chunk == self.a), np.flatnonzero(chunk == self.b)
        self.sides = [(left, right)] if self.a == self.b else [(left, right), (right, left)]

    def add(self, term: np.ndarray, source: np.ndarray, n: np.ndarray, of_lang: np.ndarray, words: list[bytes]) -> None:
        """Postings in the order of their terms (numbered from 0); words spells them."""
        p = shares(n, self.size[source])
        for rows, peers in self.sides:
            self._scatter(term, source, p, rows, peers, len(words))
        if self.a == self.b:
            self._best(term, source, p, shares(of_lang, np.full(len(n), self.of_lang + self.kept)), words)

    def _scatter(self, term, source, p, rows, peers, n_terms) -> None:
        absent = self.absent
        index = np.isin(source, peers)
        peer, share = source[index], p[index]
        start = np.concatenate(([0], np.cumsum(np.bincount(term[index], minlength=n_terms))))
        order = np.argsort(source, kind="stable")
        begin = np.searchsorted(source[order], np.arange(len(self.names) + 1))
        for g in rows.tolist():
            own = order[begin[g] : begin[g + 1]]
            if not len(own):
                continue
            mine, acc = absent[g], self.rows[g]
            # present here, absent there
            values, times = np.unique(p[own], return_counts=True)
            acc[peers] += ((gains(values[:, None], absent[peers][None, :]) - gains(mine, absent[peers])[None, :]) * times[:, None]).sum(axis=0)
            # present in both: the accumulator over all peers that the index names
            width = start[term[own] + 1] - start[term[own]]
            stop = np.cumsum(width)
            for low in range(0, len(own), step := max(1, POSTINGS // max(1, len(peers)))):
                some = slice(low, low + step)
                w = width[some]
                past = stop[some] - w - (stop[low] - width[low])
                at = np.repeat(start[term[own[some]]] - past, w) + np.arange(int(w.sum()))
                here, there, whose = np.repeat(p[own[some]], w), share[at], peer[at]
                np.add.at(acc, whose, gains(here, there) - gains(here, absent[whose]) - gains(mine, there) + gains(mine, absent[whose]))
        # absent here, present there
        by_peer = np.argsort(peer, kind="stable")
        begin = np.searchsorted(peer[by_peer], np.arange(len(self.names) + 1))
        for s in peers.tolist():
            values, times = np.unique(share[by_peer[begin[s] : begin[s + 1]]], return_counts=True)
            if len(values):
                self.rows[rows, s] += ((gains(absent[rows][:, None], values[None, :]) - gains(absent[rows], absent[s])[:, None]) * times[None, :]).sum(axis=1)

    def _best(self, term, source, p, q, words) -> None:
        above = np.flatnonzero(p > q)
        value, who = gains(p[above], q[above]), source[above]
        for g in np.unique(who).tolist():
            mine = np.flatnonzero(who == g)
            v, old = value[mine], self.top[g]
            least = -old[-1][0] if len(old) == TOP else 0
            if len(v) > TOP:
                least = max(least, int(np.partition(v, -TOP)[-TOP]))
            fresh = mine[v >= least]
            self.top[g] = sorted(old + [(-int(value[i]), words[term[above[i]]]) for i in fresh.tolist()])[:TOP]

    def emitted(self) -> Iterator[pa.RecordBatch]:
        if self.rows is None and not self.first:
            return
        self.ready()
        if self.first and self.kept:
            self.rows += self.kept * gains(self.absent[:, None], self.absent[None, :])
        for rows, peers in self.sides:
            names = pa.array([self.names[s] for s in peers.tolist()], pa.string())
            for g in rows.tolist():
                yield _batch(self.lang, self.names[g], "pair", names, self.rows[g, peers], peers != g)
        for g, best in enumerate(self.top):
            if best:
                yield _batch(self.lang, self.names[g], "term", pa.array([t for _, t in best], pa.binary()).cast(pa.string()), np.array([-v for v, _ in best]), None)


def _batch(lang: str, source: str, part: str, item: pa.Array, value: np.ndarray, only: np.ndarray | None) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([*(pa.repeat(x, len(item)) for x in (lang, source, part)), item, pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])
    return out if only is None else out.filter(pa.array(only))


def _accumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by lang, a, b and term, a tile's groups (term null) before its postings; sums and best terms of the task."""
    tile, waiting, held = None, [], 0

    def flush(last: bool):
        """Adds what waits, but for the last term, which may go on, unless last."""
        nonlocal waiting, held
        if not waiting:
            return
        table = pa.Table.from_batches(waiting)
        coded = lambda c: pa.concat_arrays(table.column(c).chunks).dictionary_encode()
        words, named = coded("term"), coded("source")
        term = words.indices.to_numpy()
        n = len(table) if last else int(np.searchsorted(term, term[-1]))
        if n:
            source = np.array([tile.place[s] for s in named.dictionary.to_pylist()], dtype=np.int64)[named.indices.to_numpy()]
            tile.add(term[:n].astype(np.int64), source[:n], table.column("n").to_numpy()[:n], table.column("of_lang").to_numpy()[:n], words.dictionary.cast(pa.binary()).to_pylist())
        rest = table.slice(n)
        waiting, held = rest.to_batches() if len(rest) else [], len(rest)

    for batch in batches:
        lang, a, b = batch.column("lang").dictionary_encode(), batch.column("a").to_numpy(), batch.column("b").to_numpy()
        code, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
        edges = np.flatnonzero((code[1:] != code[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
            if low == high:
                continue
            key = (names[code[low]], int(a[low]), int(b[low]))
            if tile is None or (tile.lang, tile.a, tile.b) != key:
                flush(True)
                if tile:
                    yield from tile.emitted()
                tile = _Tile(*key)
            part = batch.slice(low, high - low)
            heads = part.column("term").null_count
            for row in part.slice(0, heads).to_pylist():
                tile.head(**{c: row[c] for c in ("source", "chunk", "n", "of_lang", "kept", "first")})
            if heads < len(part):
                tile.ready()
                waiting.append(part.slice(heads).select(["term", "source", "n", "of_lang"]))
                held += len(part) - heads
                if held >= POSTINGS:
                    flush(False)
    flush(True)
    if tile:
        yield from tile.emitted()


def divergence(docs: DataFrame) -> DataFrame:
    """How far sources of a language lie apart in their shares of terms: lang, source, part, item, value, rank.

    Terms are runs of A-Z, a-z and characters beyond ASCII, A-Z in lower case; null lang,
    source and text count as empty. A language keeps the terms that 3 of its documents (rows; repeated ones
    count each) have. A group's share of a term is p = 1 + floor(10^9 (n + 1) / (N + V)), n its
    occurrences, N their sum and V the number of kept terms. Part pair: for every other source
    of the language the sum over all kept terms of floor((p - q)^2 / q), q that source's share; 0 if none
    is kept, so a group without terms has rows as well. Part term: the 200 terms of the group's own with the largest floor((p - q)^2 / q)
    among those with p > q, q the language's share. Ranks go by value descending, then item in the order of its
    bytes. A source alone in its language has no pair. Other columns are ignored; no documents give no rows.
    """
    spark = docs.sparkSession
    counts = written(_counted(docs), "counts")
    same = Window.partitionBy("lang", "term")
    met = counts.where("term <> ''").withColumn("in_documents", F.sum("held").over(same)).where(F.col("in_documents") >= LEAST_DOCUMENTS)
    kept = written(met.select("lang", "source", "term", "n", F.sum("n").over(same).alias("of_lang"), (F.min("source").over(same) == F.col("source")).alias("leads")), "kept")
    groups = counts.where("term = ''").select("lang", "source")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("leads").alias("kept"))
    groups = groups.join(sums, ["lang", "source"], "left").fillna(0, ["n", "kept"])
    langs = groups.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.sum("kept").alias("kept"), F.count(F.lit(1)).alias("sources"))
    most = langs.agg(F.max("sources")).first()[0] or 0
    chunks = max(1, -(-most // CHUNK))
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // PER_TASK))
    chunk = F.pmod(F.xxhash64("source"), F.lit(chunks)).cast("int")

    def tiled(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if chunks > 1 else rows.withColumns({"chunk": F.lit(0), "other": F.lit(0)})
        return rows.withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other")}).drop("other")

    postings = tiled(kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(slots)).cast("int").alias("slot"), "lang", "source", "term", "n", "of_lang"))
    heads = tiled(groups.drop("kept").join(langs.drop("sources"), "lang")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("first", F.col("slot") == 0)
    stream = postings.unionByName(heads, allowMissingColumns=True).repartitionById(slots, "slot").sortWithinPartitions("lang", "a", "b", F.asc_nulls_first("term"))
    parts = stream.mapInArrow(_accumulated, "lang string, source string, part string, item string, value long")
    values = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # the best of each slice of a group's terms hold the best of the group, so few rows of it meet in one task
    slice_of = F.when(F.col("part") == "term", F.pmod(F.xxhash64("item"), F.lit(SLICES))).otherwise(0)
    values = values.withColumn("slice", slice_of).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part", "slice").orderBy(F.desc("value"), "item")))
    values = values.where((F.col("part") == "pair") | (F.col("rank") <= TOP)).drop("slice", "rank")
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(place).cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= TOP))
