"""Operator 2, SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A text's lattice has an edge for every vocabulary piece that spells its bytes there, and
a faint byte edge where no piece spells a byte. Pieces do not reach across words, so the
forward sums are found once for each distinct word of a batch; every occurrence then draws
its pieces from the end to the front with random numbers that depend on the row key, the
word's place and the place in the word only. Words of a usual length are worked on together
in numpy; a very long one in stretches, with the sums of one carried into the next.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The factor of a byte edge is 2 to this power: it is taken where nothing else spells the text.
BYTE = -24
#: Words of more bytes are worked on one by one, in blocks of STRETCH states, if fewer than TOGETHER of a chunk's words are as long.
LONG, TOGETHER, STRETCH = 64, 25, 1 << 15
#: Bytes of words that are worked on at a time.
CHUNK = 1 << 19
#: Codes of pieces are looked up by their bits above this one.
TOP = U(44)


class Vocabulary:
    """Pieces of a SentencePiece model as bytes, with factors for the lattice, and these as log-weights.

    A BPE model has an order in place of log-probabilities; its pieces get Zipf factors
    1 / (rank + 10). A unigram model's are the exponentials of its scores. Both are raised to alpha.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, dtype=np.int64)
        plain, scores = [], []
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.bytes[i], self.byte_ids[b] = bytes([b]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = model.id_to_piece(i).replace("▁", " ").encode()
                plain.append(i)
                scores.append(model.get_score(i))
        scores = np.array(scores)
        # scores of a BPE model are whole numbers that tell its pieces' order only
        ranked = bool((scores == np.floor(scores)).all())
        rank = np.empty(len(scores))
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
        factor = (1 / (10.0 + rank) if ranked else np.exp(scores)) ** alpha
        # the lattice is cut before a space that follows something else, so pieces must not run across one
        for i in plain:
            p = self.bytes[i]
            if b" " in p.lstrip(b" ") or b"\n" in p:
                raise ValueError(f"piece {i} reaches across words")
        size = np.array([len(self.bytes[i]) for i in plain])
        data = np.frombuffer(b"".join(self.bytes[i] for i in plain), dtype=np.uint8)
        ends = np.cumsum(size)
        code = common.slices_hash(data, ends - size, ends)
        order = np.argsort(code)
        self.codes, self.ids, self.weights = code[order], np.array(plain)[order], np.log(factor[order])
        self.sizes = np.unique(np.append(size, 1))
        # the sums of as many states as a piece is long must fit into one range of exponents
        byte = 2.0 ** max(BYTE, -900 // (int(self.sizes[-1]) + 4))
        if (self.sizes[-1] + 4) * -np.log2(min(byte, factor[size == 1].min(initial=1.0))) > 950:
            raise ValueError("weights are too far apart")
        self.table = None
        self.none = n  # stands for no piece
        self.factor_of = np.zeros(n + 1)
        self.factor_of[plain] = factor
        self.factor_of[self.byte_ids] = byte
        # by the top bits of a code: the first piece with them, or len(codes) for none; self.shared is the most pieces that have the same
        top = (self.codes >> TOP).astype(np.int64)
        self.first = np.full(1 << 64 - int(TOP), len(top), dtype=np.uint16 if len(top) < 65536 else np.int32)
        self.first[top[::-1]] = np.arange(len(top))[::-1]
        self.shared = int(np.bincount(top).max(initial=0))

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the codes are those of pieces, and these pieces' ids."""
        hit = self.first[code >> TOP]
        some = np.flatnonzero(hit < len(self.codes))
        hit, code = hit[some].astype(np.int64), code[some]
        ok = self.codes[hit] == code
        for _ in range(self.shared - 1):
            missed = np.flatnonzero(~ok)
            hit[missed] = np.minimum(hit[missed] + 1, len(self.codes) - 1)
            ok[missed] = self.codes[hit[missed]] == code[missed]
        return some[ok], self.ids[hit[ok]]

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and where each id's end."""
        if self.table is None:
            size = np.array([len(b) for b in self.bytes], dtype=np.int64)
            self.table = np.frombuffer(b"".join(self.bytes), dtype=np.uint8), np.cumsum(size) - size, size
        flat, start, size = self.table
        own = size[ids]
        ends = np.cumsum(own)
        return flat[np.repeat(start[ids] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)], ends

    def decode(self, ids) -> bytes:
        """The bytes of a text from its piece ids."""
        return b"".join([self.bytes[i] for i in ids])


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def _spelled(data: np.ndarray, left: np.ndarray, v: Vocabulary):
    """For each length of pieces, longest first: places with so many bytes left in their word where a piece stands, and which."""
    hashed = common.Hasher(data)
    for length in v.sizes[::-1]:
        pos = np.flatnonzero(left >= length)
        some, ids = v.find(hashed(pos, pos + length))
        yield int(length), pos[some], ids


def _chances(end: np.ndarray, value: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    """Each edge's chance that a draw at its state takes it or one before it, in 2**-24ths; edges go by state, longest first.

    Sums run in that order and scale by powers of two only, so they are the same as in _forward.
    """
    first, row, rank = _ranks(end)
    top = np.maximum.reduceat(exponent, first)
    table = np.zeros((len(first), rank.max() + 1))
    table[row, rank] = np.ldexp(value, exponent - top[row])
    run = np.cumsum(table, axis=1)
    return np.ceil(run[row, rank] / run[row, -1] * 2.0**24).astype(np.int64)


def _ranks(end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted states: where each new one starts, each entry's row, and its place inside the row."""
    first = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(end))))
    return first, row, np.arange(len(end)) - first[row]


def _forward(data: np.ndarray, size: np.ndarray, v: Vocabulary):
    """Forward sums of the lattices of short words, the longest first, laid end to end.

    A state is a place between two bytes of a word; those of one depth of all words lie
    next to each other, so states at a distance are slices. Returns where each depth
    starts, the lengths that any piece of these words has, longest first, and by length and
    state the piece and the chance that a draw takes this length or a longer one, in 2**-24ths.
    """
    held = np.searchsorted(-size, -np.arange(size[0] + 1), side="right")
    off = np.concatenate(([0], np.cumsum(held)))
    word = np.repeat(np.arange(len(size)), size)
    after = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    spelled = [s for s in _spelled(data, size[word] - after, v) if s[0] == 1 or len(s[1])]
    lengths = np.array([length for length, _, _ in spelled])
    piece = np.full((len(lengths), off[-1]), v.none, dtype=np.uint16 if v.none < 65536 else np.int32)
    piece[-1, off[after + 1] + word] = v.byte_ids[data]
    for j, (length, pos, ids) in enumerate(spelled):
        piece[j, off[after[pos] + length] + word[pos]] = ids
    total = np.ones(off[-1])
    chance = np.zeros((len(lengths), off[-1]), dtype=np.int32)
    for d in range(1, size[0] + 1):
        n, here = held[d], slice(off[d], off[d + 1])
        # longer pieces don't end here
        least = int((lengths > d).sum())
        run = np.zeros((len(lengths) - least + 1, n))
        for j, length in enumerate(lengths[least:].tolist()):
            start = off[d - length]
            np.multiply(total[start : start + n], v.factor_of[piece[least + j, here]], out=run[j + 1])
            run[j + 1] += run[j]
        total[here] = run[-1]
        chance[least:, here] = np.ceil(run[1:] / run[-1] * 2.0**24)
        if d % 4 == 0:
            scale = np.ldexp(1.0, -np.frexp(run[-1])[1])
            for back in range(min(d, int(lengths[0])) + 1):
                total[off[d - back] : off[d - back] + n] *= scale
    return off, lengths, piece, chance


def _uniform(stream: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """A whole number under 2**24 for each word and state of it."""
    return (mix(stream + (depth + 1).astype(np.uint64) * U(0xD1342543DE82EF95)) >> U(40)).astype(np.int64)


def _long_word(data: np.ndarray, stream: np.uint64, v: Vocabulary) -> np.ndarray:
    """Pieces of one word of any length, by the same sums and draws in blocks of STRETCH states: a number a state is kept, edges are made again on the way back."""
    n, longest = len(data), int(v.sizes[-1])
    mantissa, exponent = np.full(n + 1, 0.5), np.ones(n + 1, dtype=np.int64)

    def block(lo, hi):
        """Edges into the states lo + 1 to hi: state, length, piece and factor, by state, longest first."""
        low = max(0, lo - longest)
        part = data[low:hi]
        bare, found = np.ones(len(part), dtype=bool), []
        for length, pos, ids in _spelled(part, np.arange(len(part), 0, -1), v):
            if length == 1:
                bare[pos] = False
            found.append((pos + length, np.full(len(pos), length), ids))
        found.append((np.flatnonzero(bare) + 1, np.ones(bare.sum(), dtype=np.int64), v.byte_ids[part[bare]]))
        end, length, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        order = order[end[order] + low > lo]
        return end[order] + low, length[order], piece[order], v.factor_of[piece[order]]

    recent, scale = [1.0], 0  # forward sums of the last states, over 2**scale
    for lo in range(0, n, STRETCH):
        hi = min(n, lo + STRETCH)
        end, length, _, weight = block(lo, hi)
        first, _, _ = _ranks(end)
        first, length, weight = [*first.tolist(), len(end)], length.tolist(), weight.tolist()
        sums, scales = [], []
        for k in range(hi - lo):
            total, behind = 0.0, len(recent)
            for i in range(first[k], first[k + 1]):
                total += recent[behind - length[i]] * weight[i]
            recent.append(total)
            sums.append(total)
            scales.append(scale)
            if total < 1e-100:
                recent, scale = [x * 2.0**300 for x in recent[-longest:]], scale - 300
        recent = recent[-longest:]
        mantissa[lo + 1 : hi + 1], shift = np.frexp(np.array(sums))
        exponent[lo + 1 : hi + 1] = shift + np.array(scales)
    out, at = [], n
    for lo in reversed(range(0, n, STRETCH)):
        hi = min(n, lo + STRETCH)
        if at <= lo:
            continue
        end, length, piece, weight = block(lo, hi)
        start = end - length
        chance = _chances(end, mantissa[start] * weight, exponent[start])
        states = np.arange(lo + 1, hi + 1)
        key = (states << 24) + _uniform(np.full(hi - lo, stream, dtype=np.uint64), states)
        taken = np.searchsorted((end << 24) + chance, key, side="right")
        step, spelled = length[taken].tolist(), piece[taken].tolist()
        while at > lo:
            k = at - lo - 1
            out.append(spelled[k])
            at -= step[k]
    return np.array(out[::-1], dtype=np.int32)


def _short_words(data: np.ndarray, begin: np.ndarray, size: np.ndarray, stream: np.ndarray, v: Vocabulary):
    """(words, their next piece from the end) in steps: the sums once for each distinct word, then every word's draws."""
    code = common.slices_hash(data, begin, begin + size)
    _, one, kind = np.unique(code, return_index=True, return_inverse=True)
    order = np.argsort(-size[one], kind="stable")
    rank = np.empty(len(one), dtype=np.int64)
    rank[order] = np.arange(len(one))
    one, kind = one[order], rank[kind]
    own = size[one]
    places = np.repeat(begin[one] - np.cumsum(own) + own, own) + np.arange(own.sum())
    off, lengths, piece, chance = _forward(data[places], own, v)
    live, depth, steps = np.arange(len(begin)), size, []
    while len(live):
        state = off[depth] + kind[live]
        which = (chance[:, state] <= _uniform(stream[live], depth).astype(np.int32)).sum(axis=0)
        steps.append((live, piece[which, state]))
        depth = depth - lengths[which]
        live, depth = live[depth > 0], depth[depth > 0]
    return steps


def sampled(texts, keys, v: Vocabulary, seed: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Piece ids of all texts, where each text's start, and the texts' bytes.

    Words are taken some CHUNK bytes at a time, and very long ones by themselves, so memory
    beyond a few numbers a byte has a bound; what is drawn doesn't depend on either.
    """
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    if not len(data):
        return np.zeros(0, dtype=np.int32), np.zeros(len(raw) + 1, dtype=np.int64), raw
    space, line = data == 32, data == 10
    cut = np.zeros(len(data), dtype=bool)
    cut[0] = True
    cut[1:] = (space[1:] & ~space[:-1]) | (line[1:] != line[:-1])
    cut[starts[:-1][sizes > 0]] = True
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, len(data)))
    doc = common.owner(starts, begin)
    first_word = np.searchsorted(doc, np.arange(len(raw)))
    with np.errstate(over="ignore"):
        row = mix(np.asarray(keys, dtype=np.int64).view(np.uint64) + mix(np.array([seed], dtype=np.uint64)))
        stream = mix(row[doc] + (np.arange(len(doc)) - first_word[doc]).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        count, made = np.zeros(len(doc), dtype=np.int64), []
        cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(data), CHUNK)), len(begin)))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            limit = max(LONG, np.partition(size[i:j], j - i - TOGETHER)[j - i - TOGETHER]) if j - i >= TOGETHER else LONG
            long = i + np.flatnonzero(size[i:j] > limit)
            short = i + np.flatnonzero(size[i:j] <= limit)
            whole = {w: _long_word(data[begin[w] : begin[w] + size[w]], stream[w], v) for w in long.tolist()}
            for w, pieces in whole.items():
                count[w] = len(pieces)
            steps = []
            if len(short):
                lo, hi = begin[short[0]], begin[short[-1]] + size[short[-1]]
                if hi - lo > 2 * CHUNK:  # a long word lies between them
                    at = np.repeat(begin[short] - np.concatenate(([0], np.cumsum(size[short])))[:-1], size[short]) + np.arange(size[short].sum())
                    steps = _short_words(data[at], np.concatenate(([0], np.cumsum(size[short])))[:-1], size[short], stream[short], v)
                else:
                    steps = _short_words(data[lo:hi], begin[short] - lo, size[short], stream[short], v)
            for live, _ in steps:
                count[short[live]] += 1
            end = np.cumsum(count[i:j])
            ids = np.empty(end[-1], dtype=np.int32)
            for k, (live, piece) in enumerate(steps):
                ids[end[short[live] - i] - 1 - k] = piece
            for w, pieces in whole.items():
                ids[end[w - i] - len(pieces) : end[w - i]] = pieces
            made.append(ids)
    ids = np.concatenate(made)
    return ids, np.concatenate(([0], np.cumsum(np.bincount(doc, weights=count, minlength=len(raw)).astype(np.int64)))), raw


def encoded(docs: DataFrame, model: str = MODEL, alpha: float = 1.0, seed: int = 1, with_ids: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, ids, n_pieces, ids_crc32, n_bytes, lossless.

    ids is a segmentation drawn from the lattice; a text and doc_id always give the same
    one for a seed, in whatever batch they come; alpha sharpens (above 1) or flattens the
    choice. lossless says that decoding the ids gave the text's bytes. A null or empty
    text has no pieces; a null doc_id draws as the key -2**63. Other columns are ignored.
    Repeated rows are equal; an empty table gives no rows.
    """

    def run(batches):
        v = vocabulary(model, alpha)
        for pdf in batches:
            for i, j in common.in_pieces(pdf, ["text"], 300_000):
                part = pdf.iloc[i:j]
                ids, at, raw = sampled(part["text"].tolist(), part["doc_id"].to_numpy(), v, seed)
                each = [ids[at[k] : at[k + 1]] for k in range(len(raw))]
                out_bytes, ends = v.spelled(ids)
                out_bytes, ends = out_bytes.tobytes(), np.append(0, ends)[at].tolist()
                out = {
                    "doc_id": part["doc_id"].to_numpy(),
                    "n_pieces": np.diff(at),
                    "ids_crc32": [zlib.crc32(x.astype("<i4").tobytes()) for x in each],
                    "n_bytes": [len(r) for r in raw],
                    "lossless": [out_bytes[a:b] == r for a, b, r in zip(ends[:-1], ends[1:], raw, strict=True)],
                }
                yield pd.DataFrame(out | ({"ids": each} if with_ids else {}))

    from .minhash_dedup import NO_ID

    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    made = given.mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, lossless boolean" + (", ids array<int>" if with_ids else ""))
    return made.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def decoded(pieces: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows with ids, and text from them: the exact text that was encoded; null ids give a null text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        v, out, at = vocabulary(model, 1.0), [], 0
        held = [x is not None for x in ids]
        size = np.array([len(x) if x is not None else 0 for x in ids], dtype=np.int64)
        while at < len(ids):
            # a few texts at a time
            to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), CHUNK // 8)) + at)
            some = [x for x in ids.iloc[at:to] if x is not None and len(x)]
            made, ends = v.spelled(np.concatenate(some).astype(np.int64) if some else np.zeros(0, dtype=np.int64))
            made, ends = made.tobytes(), np.append(0, ends)[np.append(0, np.cumsum(size[at:to]))].tolist()
            out += [made[a:b].decode("utf-8", "surrogatepass") if ok else None for a, b, ok in zip(ends[:-1], ends[1:], held[at:to], strict=True)]
            at = to
        return pd.Series(out, dtype=object)

    return pieces.withColumn("text", text("ids"))
