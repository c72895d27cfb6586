"""Packed assets: a header, scales, an offset table and the leaves' payload words in one file.

All numbers are little-endian. After eight bytes of magic come eleven 32-bit numbers
(FIELDS), float32 scales, leaf_count + 1 word offsets and the words. The data source
"packed_asset" reads leaves in ranges; only the bytes of a range are read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from .shared import located, resolved

# Fixed values of the format: order of the header's numbers, version, leaf size and limits.
FIELDS = ("version", "width", "height", "depth", "frames", "leaf_size", "coarse_resolution", "max_coarse_keep", "leaf_count", "profile_type", "scale_count")
VERSION, LEAF_SIZE, MAX_RESOLUTION, MAX_SCALES, LAST_PROFILE = 4, 8, 8, 64, 2
HEAD = 8 + 4 * len(FIELDS)

LEAVES = "asset string, leaf_id long, word_begin long, word_end long, packed_header long, payload binary"
HEADERS = "asset string, version int, width int, height int, depth int, frames int, leaf_size int, coarse_resolution int, max_coarse_keep int, leaf_count int, profile_type int, ac_scales array<float>"


def header(path: str, magic: bytes | None = None) -> dict:
    """The checked header of a file, with its scales, the offsets' place and the payload's; reads few bytes."""
    files, inner = located(path)
    size = files.get_file_info(inner).size
    with files.open_input_file(inner) as f:
        head = f.read_at(min(HEAD, size), 0)
        if len(head) < HEAD:
            raise ValueError("packed asset ends inside its header")
        if magic is not None and head[:8] != magic:
            raise ValueError("unsupported magic")
        out = dict(zip(FIELDS, struct.unpack("<11I", head[8:]), strict=True))
        if out["version"] != VERSION:
            raise ValueError(f"unsupported version {out['version']}")
        if min(out["width"], out["height"], out["depth"], out["frames"]) == 0:
            raise ValueError("sizes and frames must not be zero")
        if out["leaf_size"] != LEAF_SIZE or not 1 <= out["coarse_resolution"] <= MAX_RESOLUTION or out["profile_type"] > LAST_PROFILE:
            raise ValueError("leaf size, resolution or profile is out of range")
        if out["max_coarse_keep"] > out["frames"] or out["scale_count"] > min(MAX_SCALES, out["max_coarse_keep"]):
            raise ValueError("scales are out of range")
        blocks = [-(-out[a] // LEAF_SIZE) for a in ("width", "height", "depth")]
        if out["leaf_count"] != int(np.prod(blocks, dtype=np.int64)):
            raise ValueError("leaf count disagrees with sizes")
        out["offsets_at"] = HEAD + 4 * out["scale_count"]
        out["payload_at"] = out["offsets_at"] + 4 * (out["leaf_count"] + 1)
        if size < out["payload_at"]:
            raise ValueError("packed asset ends inside its offsets")
        out["ac_scales"] = np.frombuffer(f.read_at(4 * out["scale_count"], HEAD), dtype="<f4").tolist()
        ends = [int(np.frombuffer(f.read_at(4, at), dtype="<u4")[0]) for at in (out["offsets_at"], out["payload_at"] - 4)]
    if ends[0] != 0 or size != out["payload_at"] + 4 * ends[1]:
        raise ValueError("file length disagrees with offsets")
    return out


@dataclass
class Leaves(InputPartition):
    path: str
    first: int
    last: int


class PackedAsset(DataSource):
    @classmethod
    def name(cls):
        return "packed_asset"

    def schema(self):
        return LEAVES

    def reader(self, schema):
        return PackedReader(self.options)


class PackedReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.magic = bytes.fromhex(options["magic"]) if "magic" in options else None
        self.step = int(options.get("leaves_per_partition", 4096))
        self.only: int | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("leaf_id",) and self.only in (None, f.value):
                self.only = f.value
            else:
                yield f

    def partitions(self):
        out = []
        for path in self.paths:
            n = header(path, self.magic)["leaf_count"]
            if self.only is None:
                out += [Leaves(path, i, min(i + self.step, n) - 1) for i in range(0, n, self.step)]
            elif 0 <= self.only < n:
                out.append(Leaves(path, self.only, self.only))
        # a reader without partitions is called once with none, so an empty range stands for it
        return out or [Leaves(self.paths[0], 0, -1)]

    def read(self, partition):
        h = header(partition.path, self.magic)
        files, inner = located(partition.path)
        with files.open_input_file(inner) as f:
            n = partition.last - partition.first + 1
            at = np.frombuffer(f.read_at(4 * (n + 1), h["offsets_at"] + 4 * partition.first), dtype="<u4").astype(np.int64)
            if (np.diff(at) <= 0).any():
                raise ValueError("offsets must grow strictly")
            for i in range(n):
                words = f.read_at(4 * int(at[i + 1] - at[i]), h["payload_at"] + 4 * int(at[i]))
                if len(words) != 4 * (at[i + 1] - at[i]):
                    raise ValueError("payload ends early")
                row = [[partition.path], [partition.first + i], [int(at[i])], [int(at[i + 1])], [struct.unpack("<I", words[:4])[0]], [words]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["asset", "leaf_id", "word_begin", "word_end", "packed_header", "payload"])


def read_leaves(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """Leaves of packed assets; a condition on leaf_id right after it reads that leaf only."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackedAsset)
    return spark.read.format("packed_asset").options(path=",".join(resolved(spark, p) for p in paths), **options).load()


def read_headers(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """One header row for each row of paths (asset): assets are looked into on the executors."""

    def look(batches):
        import pandas as pd

        names = [c.split()[0] for c in HEADERS.split(", ")[1:]]
        for pdf in batches:
            yield pd.DataFrame([{"asset": a} | {n: v for n, v in header(a).items() if n in names} for a in pdf["asset"]], columns=["asset", *names])

    home = resolved(spark, "/")[:-1]
    named = F.when(F.col("asset").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("asset")).otherwise(F.concat(F.lit(home), F.col("asset")))
    return paths.select(named.alias("asset")).mapInPandas(look, HEADERS)


def write_assets(leaves: DataFrame, folder: str, magic: bytes, told: dict) -> DataFrame:
    """Writes leaves (asset long, leaf_id long from 0 without gaps, payload binary of whole words) as packed assets; told gives the header's numbers but version, leaf size and leaf count.

    Gives (asset, path, n_bytes), one row a file. A task holds one asset's payloads.
    """
    folder = resolved(leaves.sparkSession, folder)

    def store(pdf):
        import pandas as pd

        pdf = pdf.sort_values("leaf_id")
        if pdf["leaf_id"].tolist() != list(range(len(pdf))) or any(len(p) % 4 or not len(p) for p in pdf["payload"]):
            raise ValueError("leaves must be numbered without gaps and have whole words")
        offsets = np.cumsum([0, *(len(p) // 4 for p in pdf["payload"])])
        numbers = {"version": VERSION, "leaf_size": LEAF_SIZE, "leaf_count": len(pdf), "scale_count": len(told.get("ac_scales", []))} | {k: v for k, v in told.items() if k != "ac_scales"}
        head = magic + struct.pack("<11I", *[numbers[n] for n in FIELDS]) + np.array(told.get("ac_scales", []), dtype="<f4").tobytes()
        data = head + offsets.astype("<u4").tobytes() + b"".join(pdf["payload"])
        path = f"{folder}/asset{int(pdf['asset'].iloc[0]):06d}.pack"
        files, inner = located(path)
        files.create_dir(inner.rpartition("/")[0], recursive=True)
        with files.open_output_stream(inner) as f:
            f.write(data)
        return pd.DataFrame({"asset": [int(pdf["asset"].iloc[0])], "path": [path], "n_bytes": [len(data)]})

    return leaves.select("asset", "leaf_id", "payload").groupBy("asset").applyInPandas(store, "asset long, path string, n_bytes long")
