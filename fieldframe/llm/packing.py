"""Operator 13, packing by vector bin packing: the dot-product heuristic under simultaneous limits.

Every example asks for a vector (tokens, one segment, loss-bearing tokens) and every
sequence has as much of each to give. A sequence takes, of the examples at hand that fit,
the one whose demand has the largest dot product with what is left, each dimension taken
as a share of its limit, until none fits; if cutting is allowed, a piece of the best of the others fills
what is left. Each task packs what it reads, a pool of examples at a time, so nothing is
shuffled and no key can be hot; what a task emits depends on its own rows only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import tokens

END = 1
#: Examples and ids that a task chooses among; a single longer example is held as it is.
POOL, POOL_IDS = 1024, 1 << 21
#: Rows in a batch of results.
ROWS = 8192


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most. segments counts pieces, loss the tokens that bear loss."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be positive")


class _Pool:
    """Examples of one task that wait for a place, as (key, ids, loss-bearing ids before each)."""

    def __init__(self, limits: Limits, cut: bool, first: int):
        self.limits, self.cut, self.sequence = limits, cut, first
        self.examples: list[tuple] = []
        self.taken: list[int] = []
        self.held = 0

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None) -> None:
        """loss marks the ids that bear loss (None: all do)."""
        before = None if loss is None else np.concatenate(([0], np.cumsum(loss)))
        self.examples.append((key, ids, before))
        self.taken.append(0)
        self.held += len(ids)

    def full(self) -> bool:
        return len(self.examples) >= POOL or self.held >= POOL_IDS

    def _loss(self, i: int, start: int, end: int) -> int:
        before = self.examples[i][2]
        return end - start if before is None else int(before[end] - before[start])

    def _prefix(self, i: int, room: int, loss: int) -> int:
        """Of how many ids of example i, from where it stands, one sequence can take."""
        start, (_, ids, before) = self.taken[i], self.examples[i]
        if before is None:
            return min(len(ids) - start, room, loss)
        return min(len(ids) - start, room, int(np.searchsorted(before, before[start] + loss, side="right")) - 1 - start)

    def place(self, least: int) -> Iterator[tuple]:
        """Closes sequences until at most least examples wait; rows (example, start, length, sequence, offset)."""
        most = self.limits
        share = np.array([most.tokens, most.segments, most.loss], dtype=float)
        size = np.array([len(e[1]) - t for e, t in zip(self.examples, self.taken, strict=True)], dtype=np.int64)
        loss = np.array([self._loss(i, t, len(self.examples[i][1])) for i, t in enumerate(self.taken)], dtype=np.int64)
        demand = np.stack([size, np.ones(len(size), dtype=np.int64), loss], axis=1) / share
        waiting = int((size > 0).sum())
        # without cutting, an example beyond a limit by itself is cut all the same: it has no whole place
        over = (size > most.tokens) | (loss > most.loss)
        while waiting > least:
            room, segments, bearing = most.tokens, most.segments, most.loss
            pieces: list[list[int]] = []
            while room and segments:
                worth = demand @ (np.array([room, segments, bearing]) / share)
                fits = (size > 0) & (size <= room) & (loss <= bearing)
                if fits.any():
                    i = int(np.argmax(np.where(fits, worth, -1.0)))
                    n = int(size[i])
                else:
                    worth = np.where((size > 0) & (self.cut | over), worth, -1.0)
                    i = int(np.argmax(worth)) if len(worth) else 0
                    n = self._prefix(i, room, bearing) if len(worth) and worth[i] >= 0 else 0
                    if not n:
                        break
                pieces.append([i, self.taken[i], n])
                self._take(i, n, size, loss, demand, share)
                room, segments, bearing = room - n, segments - 1, bearing - self._loss(i, pieces[-1][1], pieces[-1][1] + n)
            length = most.tokens - room
            if self.cut and room:
                # a sequence is padded up to its limit unless its length is a power of two: what is beyond that waits for the next one
                back = length - (1 << (length.bit_length() - 1))
                while back:
                    i, _, n = pieces[-1]
                    gone = min(n, back)
                    self._take(i, -gone, size, loss, demand, share)
                    pieces[-1][2] -= gone
                    back -= gone
                    if not pieces[-1][2]:
                        pieces.pop()
            offset = 0
            for i, start, n in pieces:
                yield i, start, n, self.sequence, offset
                offset += n
            self.sequence += 1
            waiting = int((size > 0).sum())
        keep = [i for i in range(len(size)) if size[i]]
        self.examples, self.taken = [self.examples[i] for i in keep], [self.taken[i] for i in keep]
        self.held = int(size.sum())

    def _take(self, i: int, n: int, size: np.ndarray, loss: np.ndarray, demand: np.ndarray, share: np.ndarray) -> None:
        self.taken[i] += n
        size[i] -= n
        loss[i] = self._loss(i, self.taken[i], len(self.examples[i][1]))
        demand[i, 0], demand[i, 2] = size[i] / share[0], loss[i] / share[2]


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def _packed(frames: DataFrame, key: str, read, limits: Limits, cut: bool) -> DataFrame:
    """read turns a batch into (keys, [(ids, loss)]); key is carried along whatever its type is."""
    schema = T.StructType([T.StructField(key, frames.schema[key].dataType), *T.StructType.fromDDL(_PIECES).fields])
    arrow = pa.schema([(f.name, pa.int64()) for f in schema.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sequences of a task are numbered from its own range, so numbers are unique and a repeated task gives the same ones
        pool = _Pool(limits, cut, TaskContext.get().partitionId() << 33)
        keys, rows = [], []

        def ready(least: int):
            examples = pool.examples
            for i, start, n, sequence, offset in pool.place(least):
                name, ids, _ = examples[i]
                keys.append(name)
                rows.append((start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), sequence, offset, pool._loss(i, start, start + n)))

        def batch() -> pa.RecordBatch:
            whole = pa.concat_arrays([pa.array([k], type=kind) if not isinstance(k, pa.Array) else k for k in keys]) if keys else pa.array([], type=kind)
            columns = [pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)]
            out = pa.RecordBatch.from_arrays([whole, *columns], names=[key, *arrow.names])
            keys.clear(), rows.clear()
            return out

        kind = None
        for some in batches:
            kind = some.column(key).type
            for name, (ids, loss) in read(some):
                if len(ids):
                    pool.add(name, ids, loss)
                if pool.full():
                    ready(POOL // 2 if pool.held < POOL_IDS else 0)
                    if len(rows) >= ROWS:
                        yield batch()
        ready(0)
        if rows:
            yield batch()

    return frames.mapInArrow(run, schema)


def packed(examples: DataFrame, limits: Limits = Limits(), cut: bool = False, key: str = "doc_id") -> DataFrame:
    """Packs examples (key, ids array<int>, and loss array<boolean> if some ids bear none) into sequences under all limits at once.

    Rows per piece: key, start (ids of the example before it), length, ids_crc32,
    doc_tokens (the example's ids), sequence_id, offset (in the sequence, gapless from 0)
    and loss_tokens. Without cut an example stays whole unless it alone is beyond a limit;
    with cut it is cut where that fills a sequence, and each sequence has the limit's
    length or a power of two. Null or empty ids give no row, null ids inside count as 0;
    a null or short loss array bears loss where it says nothing, a null inside bears none. Rows of one key are examples of their own. Other columns
    are ignored; an empty table gives no rows.
    """
    columns = [key, "ids", *(["loss"] if "loss" in examples.columns else [])]

    def read(batch: pa.RecordBatch):
        given = batch.column("loss").to_pylist() if "loss" in batch.schema.names else [None] * len(batch)
        for i, (ids, loss) in enumerate(zip(batch.column("ids").to_pylist(), given, strict=True)):
            ids = np.array([x or 0 for x in ids or []], dtype="<u4")
            if loss is not None:
                loss = np.array([bool(x) for x in loss[: len(ids)]] + [True] * (len(ids) - len(loss)), dtype=bool)
            yield batch.column(key).slice(i, 1), (ids, loss)

    return _packed(examples.select(*columns), key, read, limits, cut)


def packed_texts(docs: DataFrame, vocabulary: str, end: int = END, limits: Limits = Limits()) -> DataFrame:
    """packed, with cutting, of texts (doc_id, text) encoded by a tokenizer file without special tokens, and the id end behind each; all ids bear loss.

    A null or empty text is the end id alone, so each row of docs has a piece.
    """

    def read(batch: pa.RecordBatch):
        encoder = tokens(vocabulary)
        texts = batch.column("text")
        sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
        at, held = 0, 0
        for i in range(len(batch) + 1):
            if i == len(batch) or held > 1 << 20:
                for j, ids in enumerate(encoder.encode(texts.slice(at, i - at).to_pylist()), at):
                    whole = np.full(len(ids) + 1, end, dtype="<u4")
                    whole[:-1] = ids
                    yield batch.column("doc_id").slice(j, 1), (whole, None)
                at, held = i, 0
            if i < len(batch):
                held += sizes[i]

    return _packed(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id", read, limits, True)
