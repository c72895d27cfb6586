"""Helpers that several corpus operators share.

Text work inside tasks is vectorised: the texts of one Arrow batch are laid end to
end as UTF-8 bytes, words are found from byte classes, and every word gets a 64-bit
hash from prefix sums, so there is no Python loop over words.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bits of the table that tells which rows need a join: 2**26 bits in 64-bit words are a million rows at most.
FILTER_BITS = 26
_BASE = U(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_powers = {"n": 0}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (tests on one machine) a folder under the warehouse is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as set it apart from the columns, in whatever case these are."""
    held, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def _passed(rows: DataFrame, ids: DataFrame, key: str, how: str) -> tuple[DataFrame, str]:
    """rows with a column (its name is the second result) that says whether the bit of their hashed key is set by any of ids.

    The table of bits is broadcast; its size has a fixed bound whatever the data, and a
    fuller table only lets more rows through to the exact join. With 2**FILTER_BITS ids or
    more it lets most rows through, and the exact join then shuffles as a plain join would.
    """
    slot, word, bits, passed = unused(rows.columns, "bit_slot", "bit_word", "bit_mask", "bit_set")
    place = lambda: F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << FILTER_BITS))
    table = ids.select(place().alias(slot)).groupBy((F.col(slot) / 64).cast("long").alias(word))
    table = table.agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod({slot}, 64) as int)))").alias(bits))
    there = rows.withColumn(slot, place()).withColumn(word, (F.col(slot) / 64).cast("long")).join(F.broadcast(table), word, how)
    there = there.withColumn(passed, F.expr(f"coalesce(shiftright({bits}, cast(pmod({slot}, 64) as int)) & 1, 0) = 1"))
    return there.select(*rows.columns, passed), passed


def _exact(tested: DataFrame, passed: str, rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Joins rows that passed the bits with ids. The join's key depends on the bits, so the optimiser can't move it below them, where it would shuffle all rows."""
    (same,) = unused([*rows.columns, *ids.columns], "bit_key")
    named = tested.where(passed).withColumn(same, F.when(F.col(passed), F.col(key))).drop(passed)
    return named.join(ids.withColumnRenamed(key, same), same, how).drop(same)


def rows_with(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is in ids (distinct, column key), shuffling few other rows."""
    return _exact(*_passed(rows, ids, key, "inner"), rows, ids.select(key), key, "left_semi")


def rows_joined(rows: DataFrame, table: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows joined with table (key and columns of other names than those of rows) by key, shuffling few rows without a partner."""
    return _exact(*_passed(rows, table, key, "inner"), rows, table, key, "inner")


def rows_without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is not in ids, null keys included, shuffling few other rows."""
    tested, passed = _passed(rows, ids, key, "left")
    clear = tested.where(~F.col(passed)).drop(passed)
    return clear.unionByName(_exact(tested, passed, rows, ids.select(key), key, "left_anti"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    if _powers["n"] < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        inverse = U(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
            down = np.cumprod(np.full(size, inverse, dtype=np.uint64))
        _powers.update(n=size, up=up, down=down)
    return _powers["up"], _powers["down"]


def pack(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), a space after each, and where each starts; one more start ends it."""
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    starts = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b" ".join(raw) + b" " if raw else b"", dtype=np.uint8), starts


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def runs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal non-zero kind: start, end, kind."""
    if not len(kind):
        none = np.zeros(0, dtype=np.int64)
        return none, none, kind
    edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.concatenate(([0], edges))
    end = np.concatenate((edges, [len(kind)]))
    keep = kind[start] != 0
    return start[keep], end[keep], kind[start[keep]]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes other than space and \\x09-\\x0D: start, end."""
    start, end, _ = runs(((data != 32) & ((data < 9) | (data > 13))).astype(np.uint8))
    return start, end


class Hasher:
    """64-bit hashes of any slices of some bytes, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data) + 1)
        with np.errstate(over="ignore"):
            self.total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_TABLE[data] * up[: len(data)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def slices_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Hasher(data)(start, end)


def owner(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which text of pack() holds each byte position."""
    return np.searchsorted(starts, at, side="right") - 1


def shingles(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of k words of each text, as 64-bit hashes.

    Words are runs of bytes other than space and \\x09-\\x0D after A-Z were put in lower
    case. A text with fewer than k words has its whole sequence as one shingle, one
    without words or null has none. Returns the hashes, sorted within each text, and
    where each text's hashes start (one more start than texts).
    """
    data, starts = pack(texts)
    data = lower_ascii(data)
    ws, we = words(data)
    h = slices_hash(data, ws, we)
    doc = owner(starts, ws)
    n = len(starts) - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    with np.errstate(over="ignore"):
        if len(h) >= k:
            m = len(h) - k + 1
            rolled = np.zeros(m, dtype=np.uint64)
            for i in range(k):
                rolled = mix(rolled * _BASE + h[i : i + m])
            whole = doc[:m] == doc[k - 1 :]
            full, full_doc = rolled[whole], doc[:m][whole]
        else:
            full, full_doc = h[:0], doc[:0]
        short = np.flatnonzero((count > 0) & (count < k))
        tail = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            there = count[short] > i
            tail[there] = mix(tail[there] * _BASE + h[first[short[there]] + i])
        tail = mix(tail + count[short].astype(np.uint64))
    full, full_doc = np.concatenate((full, tail)), np.concatenate((full_doc, short))
    order = np.lexsort((full, full_doc))
    full, full_doc = full[order], full_doc[order]
    fresh = np.ones(len(full), dtype=bool)
    fresh[1:] = (full[1:] != full[:-1]) | (full_doc[1:] != full_doc[:-1])
    full, full_doc = full[fresh], full_doc[fresh]
    return full, np.concatenate(([0], np.cumsum(np.bincount(full_doc, minlength=n)))).astype(np.int64)


def jaccard_of_texts(left, right, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the shingle sets of each pair of texts."""
    a, a_at = shingles(left, k)
    b, b_at = shingles(right, k)
    both = np.array(
        [len(np.intersect1d(a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]], assume_unique=True)) for i in range(len(a_at) - 1)],
        dtype=np.int64,
    )
    return both, np.diff(a_at) + np.diff(b_at) - both


def in_pieces(frame, columns, limit: int = 500_000):
    """Row ranges of a pandas frame whose texts hold about limit characters, so that arrays stay small."""
    size = sum(frame[c].str.len().fillna(0).astype("int64") for c in columns).to_numpy() if len(frame) else np.zeros(0, dtype=np.int64)
    at, held = 0, 0
    for i, s in enumerate(size):
        if held and held + s > limit:
            yield at, i
            at, held = i, 0
        held += s
    if at < len(size):
        yield at, len(size)
