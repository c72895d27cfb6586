"""Ids of a byte-level BPE vocabulary, each distinct word of a batch encoded once by the tokenizers library.

The library spends most of its time on words it has met before. So the pattern that splits
text before the merges runs in numpy over the code points of many texts, words are found by a
64-bit hash and compared code point by code point with the word known by it, and only words that
the worker has not met yet go to the library. Words, ids and hashes lie in arrays: no word is an object of its own.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import regex

from .common import _BASE, _TABLE, U, _power_tables, mix

#: Words a worker remembers before it starts anew, as it does after 16 times as many code points of words: some 110 MB of arrays, apart from room to grow.
REMEMBERED = 1 << 20
#: Words in one call of the library.
AT_ONCE = 4096
#: Code points in one round of numpy work.
CHARS = 1 << 20
LETTER, DIGIT, OTHER, SPACE, EDGE, UNKNOWN = 1, 2, 3, 4, 0, 9
#: A blank between two words, or a letter before a mark or digit: no word of the pattern spans it, so a long text may be cut there.
_CUT = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=[.,;:!?。、，0-9])")


def word_starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where words of the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ start; edges between texts count as starts. The last code point is an edge."""
    start = np.ones(len(codes), dtype=bool)
    start[1:] = kinds[1:] != kinds[:-1]
    start[kinds == EDGE] = True
    # the last blank of a run in front of something else is a word's beginning (a space) or a word of its own
    after = np.flatnonzero((kinds[1:] != SPACE) & (kinds[1:] != EDGE) & (kinds[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[codes[after - 1] == 32]] = False
    # an apostrophe that begins a word takes s, t, m, d, re, ve or ll along
    mark = np.flatnonzero((codes == 39) & start & (np.append(kinds[1:], EDGE) == LETTER))
    if len(mark):
        one, two = codes[mark + 1], codes[np.minimum(mark + 2, len(codes) - 1)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        took = mark[single | double]
        rest = took + 1 + np.where(single, 1, 2)[single | double]
        start[took + 1] = False
        start[rest[kinds[rest] == LETTER]] = True
    return start


def _slices(text: str, limit: int) -> list[str]:
    """The text in slices of about limit code points, cut where no word is cut; a word of any length stays whole."""
    out, at = [], 0
    while len(text) - at > limit:
        m = _CUT.search(text, at + limit)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at else [text]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one range behind the other."""
    stop = np.cumsum(length)
    out = np.repeat(start - stop + length, length)
    out += np.arange(len(out))
    return out


def _spread(values: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of rows out of rows that lie one behind the other."""
    return values.take(_ranges((np.cumsum(lengths) - lengths)[rows], lengths[rows]))


def _groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash stands first, by rising hash, and the group of each. Hashes that differ in few low bits only may share a group: what sorts is a hash with its place instead of those."""
    low = U(max(len(hashes), 1).bit_length())
    key = np.sort((hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64))
    order = (key & ((U(1) << low) - U(1))).astype(np.int64)
    begins = np.ones(len(key), dtype=bool)
    begins[1:] = key[1:] >> low != key[:-1] >> low
    group = np.empty(len(key), dtype=np.int64)
    group[order] = np.cumsum(begins) - 1
    return order[begins], group


class _Rows:
    """Rows of different lengths in one array that grows at its end."""

    def __init__(self, dtype):
        self.values, self.stop = np.zeros(0, dtype=dtype), np.zeros(1, dtype=np.int64)
        self.used, self.rows = 0, 0

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        """Adds rows of these lengths, whose values lie one behind the other."""
        stop = self.used + np.cumsum(lengths)
        self.values = self._grown(self.values, self.used, values)
        self.stop = self._grown(self.stop, self.rows + 1, stop)
        self.used, self.rows = self.used + len(values), self.rows + len(lengths)

    @staticmethod
    def _grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(array):
            array = np.concatenate((array[:used], np.empty(used + 2 * len(more), dtype=array.dtype)))
        array[used : used + len(more)] = more
        return array

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.stop[rows + 1] - self.stop[rows]

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The values of these rows, one row behind the other."""
        return self.values.take(_ranges(self.stop[rows], self.lengths(rows)))


class Tokens:
    """Encodes texts by a tokenizer file of the tokenizers library, without special tokens at the ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split, added, model = made.get("pre_tokenizer") or {}, made.get("added_tokens") or [], made.get("model") or {}
        #: Whether words can be encoded one by one; if not, whole texts go to the library.
        self.by_words = (
            split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and made.get("normalizer") is None
            and not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added)
            and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and sum(len(t) == 1 for t in model["vocab"]) >= 256
        )
        self.added = {a["content"]: np.array([a["id"]], dtype="<u4") for a in added}
        self.marks = re.compile("(" + "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # the words known do its work
        if self.by_words:
            #: The same merges for words that are split already, and the bytes of each id.
            self.merges = Tokenizer(self.library.model)
            self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.bytes = np.zeros(1 + max(model["vocab"].values()), dtype=np.int64)
            self.bytes[list(model["vocab"].values())] = list(map(len, model["vocab"]))
        self._forget()
        self.kinds = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        every = np.arange(0x110000, dtype=np.uint64)
        with np.errstate(over="ignore"):
            self.values = _TABLE[every & U(255)] + (every >> U(8)) * _BASE

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        """The class of each code point in the splitting pattern; the library itself is asked once for each, so both go by the same Unicode tables."""
        out = self.kinds[codes]
        if (new := out == UNKNOWN).any():
            alone = lambda a, c: len(self.library.pre_tokenizer.pre_tokenize_str(a + c)) == 1
            for c in np.unique(codes[new]).tolist():
                self.kinds[c] = next((kind for a, kind in (("a", LETTER), ("1", DIGIT), ("!", OTHER)) if alone(a, chr(c))), SPACE)
            out = self.kinds[codes]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (null: none), as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []
        held = 0
        for i, text in enumerate(texts):
            for part in self.marks.split(text or "") if self.marks and text else [text or ""]:
                if part in self.added:
                    waiting.append((i, part))
                    continue
                for piece in _slices(part, CHARS):
                    if piece:
                        waiting.append((i, piece))
                        held += len(piece)
                    if held >= CHARS:
                        self._flush(waiting, out)
                        waiting, held = [], 0
        self._flush(waiting, out)
        return [np.concatenate(o) if len(o) > 1 else o[0] if o else np.zeros(0, dtype="<u4") for o in out]

    def _flush(self, waiting: list[tuple[int, str]], out: list[list[np.ndarray]]) -> None:
        plain = [t for _, t in waiting if t not in self.added]
        encoded = iter(self._words(plain)) if plain else iter(())
        for i, t in waiting:
            out[i].append(self.added[t] if t in self.added else next(encoded))

    def _forget(self) -> None:
        """Starts anew: no word is known. Words are numbered as they come; hashes are sorted, with the number of the word of each beside it."""
        self.hashes, self.numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.codes, self.ids = _Rows(np.uint32), _Rows(np.dtype("<u4"))

    def _remember(self, words: list[str], codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of words that now are known; codes are theirs, one word behind the other."""
        some = (words[i : i + AT_ONCE] for i in range(0, len(words), AT_ONCE))
        ids = np.concatenate([np.array(self.merges.encode_batch_fast([w], add_special_tokens=False, is_pretokenized=True)[0].ids, dtype="<u4") for w in some])
        # each id stands for some bytes and no id for bytes of two words
        size = np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))[np.cumsum(lengths) - 1]
        stop = np.searchsorted(np.cumsum(self.bytes[ids]), size) + 1
        self.ids.extend(ids, np.diff(stop, prepend=0))
        self.codes.extend(codes, lengths)
        return np.arange(self.codes.rows - len(words), self.codes.rows)

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        edges = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds = self._kinds(codes)
        kinds[edges] = EDGE
        at = np.flatnonzero(word_starts(codes, kinds))
        end = np.append(at[1:], len(codes))
        word = kinds[at] != EDGE
        at, end = at[word], end[word]
        up, down = _power_tables(len(codes) + 1)
        total = np.zeros(len(codes) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values.take(codes) * up[: len(codes)], out=total[1:])
            hashes = mix((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64))
        if self.codes.rows > REMEMBERED or self.codes.used > 16 * REMEMBERED:
            self._forget()
        length = end - at
        learn = lambda w: self._remember(list(map(joined.__getitem__, map(slice, at[w].tolist(), end[w].tolist()))), codes[_ranges(at[w], length[w])], length[w])
        first, which = _groups(hashes)
        distinct = hashes[first]
        place = np.searchsorted(self.hashes, distinct)
        new = np.append(self.hashes, U(0))[place] != distinct
        new |= place == len(self.hashes)
        if new.any():
            order = np.argsort(first[new])
            numbers = np.empty(len(order), dtype=np.int64)
            numbers[order] = learn(first[new][order])
            self.hashes, self.numbers = np.insert(self.hashes, place[new], distinct[new]), np.insert(self.numbers, place[new], numbers)
            place += np.cumsum(new) - new
        number = self.numbers[place]
        # a word whose code points are not those of the word known by its hash is learnt by itself
        chars, known = self.codes.lengths(number), self.codes.take(number)
        same = chars[which] == length
        if not same.all() or (_spread(known, chars, which) != codes[kinds != EDGE]).any():
            alike = np.flatnonzero(same)
            differ = _spread(known, chars, which[alike]) != codes[_ranges(at[alike], length[alike])]
            same[np.repeat(alike, length[alike])[differ]] = False
            which[~same] = len(number) + np.arange(len(same) - same.sum())
            number = np.append(number, learn(np.flatnonzero(~same)))
        n = self.ids.lengths(number)
        every = _spread(self.ids.take(number), n, which)
        stop = np.concatenate(([0], np.cumsum(n[which])))
        return np.split(every, stop[np.searchsorted(at, edges)][:-1])


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """The worker's own encoder of a file; it lives as long as the worker."""
    return Tokens(path)
