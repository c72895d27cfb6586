"""Raw volumes: little-endian float32 values in one file, described by a JSON file beside it.

Two layouts hold the same cells: by frame (t, z, y, x from slowest to fastest) and time
fastest (z, y, x, t). The data source "raw_volume" reads either as rows (x, y, z, t, v)
in partitions of whole frames or of z-slabs; conditions on t and z are pushed down to it.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .shared import located, resolved

METADATA = (
    "grid_name string, conversion_mode string, data_type string, source_type string, width int, height int, depth int, frames int, dimensions array<int>,"
    " bbox_min array<int>, bbox_max array<int>, axis_order array<string>, frame_files array<string>, time_is_fastest_dimension boolean, data_min float, data_max float,"
    " global_min float, global_max float, voxel_size float, shell_width_voxels float, half_width_voxels float, index_to_world array<double>"
)
CELL = "x int, y int, z int, t int, v float"
#: Bytes of values that one partition holds at most, where one frame or slab is not larger.
PART_BYTES = 64 << 20


def sidecar(path: str) -> str:
    """The description that belongs to a raw file: <stem>.metadata.json."""
    stem, dot, _ = path.rpartition(".")
    return (stem if dot and "/" not in path[len(stem):] else path) + ".metadata.json"


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Descriptions as rows; named sizes fall back on `dimensions`, value bounds on the global ones. A broken file raises."""
    rows = spark.read.schema(METADATA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    sizes = {n: F.coalesce(F.col(n), F.get("dimensions", i)) for i, n in enumerate(("width", "height", "depth", "frames"))}
    bounds = {f"data_{m}": F.coalesce(F.col(f"data_{m}"), F.col(f"global_{m}")) for m in ("min", "max")}
    return rows.withColumns(sizes | bounds).withColumn("path", F.input_file_name())


@dataclass(frozen=True)
class Shape:
    """Sizes and layout of a raw file, checked."""

    width: int
    height: int
    depth: int
    frames: int
    time_fastest: bool

    @staticmethod
    def of(text: str, n_bytes: int) -> Shape:
        told = json.loads(text)
        named = [told.get(n) for n in ("width", "height", "depth", "frames")]
        listed = told.get("dimensions") or named
        if len(listed) != 4 or any(n is not None and n != m for n, m in zip(named, listed, strict=True)):
            raise ValueError(f"sizes {named} disagree with dimensions {listed}")
        if any(not isinstance(n, int) or n <= 0 for n in listed):
            raise ValueError(f"sizes must be positive: {listed}")
        if [a.upper() for a in told.get("axis_order") or "XYZT"] != list("XYZT"):
            raise ValueError("axis order must be X, Y, Z, T")
        if told.get("data_type", "float32") != "float32":
            raise ValueError("only float32 values can be read")
        low, high = told.get("bbox_min"), told.get("bbox_max")
        if (low is None) != (high is None) or (low and [h - a + 1 for a, h in zip(low, high, strict=True)] != listed[:3]):
            raise ValueError("bounding box disagrees with sizes")
        if told.get("frame_files") and len(told["frame_files"]) != listed[3]:
            raise ValueError("one frame file is needed for each frame")
        if n_bytes != 4 * int(np.prod(listed, dtype=np.int64)):
            raise ValueError(f"{n_bytes} bytes do not hold {listed} float32 values")
        return Shape(*listed, bool(told.get("time_is_fastest_dimension", False)))


@dataclass
class Range(InputPartition):
    volume: int
    first: int
    last: int


class RawVolume(DataSource):
    @classmethod
    def name(cls):
        return "raw_volume"

    def schema(self):
        return CELL

    def reader(self, schema):
        return RawReader(self.options)


class RawReader(DataSourceReader):
    """Ranges of frames, or of z where time is fastest, of one or more volumes; a partition reads its own bytes only.

    A volume's z follows on that of the one named before it if they are stacked.
    """

    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.part, self.stacked = int(options.get("part_bytes", PART_BYTES)), options.get("stacked", "false") == "true"
        told = options.get("metadata")
        self.shapes = []
        for path in self.paths:
            files, inner = located(path)
            described, described_inner = located(told or sidecar(path))
            with described.open_input_stream(described_inner) as f:
                self.shapes.append(Shape.of(f.read().decode(), files.get_file_info(inner).size))
        depths = np.cumsum([0, *(s.depth for s in self.shapes)]) if self.stacked else np.zeros(len(self.shapes) + 1, dtype=np.int64)
        self.below = depths.tolist()
        self.span = {"t": [0, max(s.frames for s in self.shapes) - 1], "z": [0, max(d + s.depth for d, s in zip(self.below, self.shapes)) - 1]}

    def pushFilters(self, filters):
        for f in filters:
            axis = ".".join(getattr(f, "attribute", ()))
            if axis in self.span and isinstance(getattr(f, "value", None), int):
                low, high = self.span[axis]
                if isinstance(f, EqualTo):
                    low, high = max(low, f.value), min(high, f.value)
                elif isinstance(f, GreaterThan):
                    low = max(low, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    low = max(low, f.value)
                elif isinstance(f, LessThan):
                    high = min(high, f.value - 1)
                elif isinstance(f, LessThanOrEqual):
                    high = min(high, f.value)
                else:
                    yield f
                    continue
                self.span[axis] = [low, high]
            else:
                yield f

    def partitions(self):
        out = []
        for n, s in enumerate(self.shapes):
            (t0, t1), (z0, z1) = self._inside(n)
            low, high = (z0, z1) if s.time_fastest else (t0, t1)
            unit = 4 * s.width * s.height * (s.frames if s.time_fastest else s.depth)
            step = max(1, self.part // unit)
            if t0 <= t1 and z0 <= z1:
                out += [Range(n, i, min(i + step - 1, high)) for i in range(low, high + 1, step)]
        # a reader without partitions is called once with none, so an empty range stands for it
        return out or [Range(0, 0, -1)]

    def _inside(self, n: int) -> tuple[tuple[int, int], tuple[int, int]]:
        """The asked frames and z of one volume, from its own corner."""
        s, (t0, t1), (z0, z1) = self.shapes[n], self.span["t"], self.span["z"]
        return (max(0, t0), min(s.frames - 1, t1)), (max(0, z0 - self.below[n]), min(s.depth - 1, z1 - self.below[n]))

    def read(self, partition):
        s, below = self.shapes[partition.volume], self.below[partition.volume]
        files, inner = located(self.paths[partition.volume])
        (t0, t1), (z0, z1) = self._inside(partition.volume)
        with files.open_input_file(inner) as f:
            for i in range(partition.first, partition.last + 1):
                if s.time_fastest:
                    shape = (1, s.height, s.width, s.frames)
                    values = _values(f, i * s.height * s.width * s.frames, shape)[..., t0 : t1 + 1]
                    z, y, x, t = (a.ravel() for a in np.indices(values.shape, dtype=np.int32))
                    z, t = z + np.int32(i), t + np.int32(t0)
                else:
                    at = (i * s.depth + z0) * s.height * s.width
                    values = _values(f, at, (1, max(z1 - z0 + 1, 0), s.height, s.width))
                    t, z, y, x = (a.ravel() for a in np.indices(values.shape, dtype=np.int32))
                    z, t = z + np.int32(z0), t + np.int32(i)
                columns = [pa.array(c) for c in (x, y, z + np.int32(below), t, values.ravel())]
                table = pa.RecordBatch.from_arrays(columns, names=list("xyztv"))
                for start in range(0, table.num_rows, 1 << 18):
                    yield table.slice(start, 1 << 18)


def _values(f, first: int, shape: tuple[int, ...]) -> np.ndarray:
    n = int(np.prod(shape, dtype=np.int64))
    data = f.read_at(4 * n, 4 * first)
    if len(data) != 4 * n:
        raise ValueError("raw file ends early")
    return np.frombuffer(data, dtype="<f4").reshape(shape)


def read_raw(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """The cells of raw files (stacked="true": one above the other); give conditions on t and z right after it, they reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawVolume)
    told = {n: resolved(spark, v) if n == "metadata" else v for n, v in options.items()}
    return spark.read.format("raw_volume").options(path=",".join(resolved(spark, p) for p in paths), **told).load()


def write_volumes(cells: DataFrame, folder: str, width: int, height: int, depth: int, frames: int, time_fastest: bool = False) -> DataFrame:
    """Writes cells (x, y, z, t, v) as raw files of depth planes each, with their descriptions beside them; absent cells are 0.

    Gives (slab, path, n_bytes, sha256, low, high), one row a file. A task holds one file's
    values, 4 * width * height * depth * frames bytes, whatever the data; of time-fastest
    files this is also the transposition.
    """
    folder = resolved(cells.sparkSession, folder)

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        slab = int(pdf["slab"].iloc[0])
        box = np.zeros((frames, depth, height, width), dtype="<f4")
        box[pdf["t"], pdf["z"] - slab * depth, pdf["y"], pdf["x"]] = pdf["v"]
        data = (box.transpose(1, 2, 3, 0) if time_fastest else box).tobytes()
        path = f"{folder}/slab{slab:06d}.raw"
        told = {"dimensions": [width, height, depth, frames], "axis_order": list("XYZT"), "time_is_fastest_dimension": time_fastest, "data_type": "float32", "global_min": float(box.min()), "global_max": float(box.max())}
        files, inner = located(path)
        files.create_dir(inner.rpartition("/")[0], recursive=True)
        for name, content in ((inner, data), (sidecar(inner), json.dumps(told).encode())):
            with files.open_output_stream(name) as f:
                f.write(content)
        return pd.DataFrame({"slab": [slab], "path": [path], "n_bytes": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()], "low": [told["global_min"]], "high": [told["global_max"]]})

    rows = cells.select("x", "y", "z", "t", "v", F.expr(f"z div {depth}").alias("slab"))
    return rows.groupBy("slab").applyInPandas(store, "slab long, path string, n_bytes long, sha256 string, low double, high double")


def write_slices(cells: DataFrame, folder: str, width: int, height: int) -> DataFrame:
    """Writes each slice (t, z) of cells (x, y, z, t, v) as its own raw file: float32 values, absent cells 0, and behind them a bit for each cell that is there.

    Two rows of one cell are an error. Gives (t, z, path, n_bytes, sha256), one row a file. A task holds one slice at a time,
    and a task that runs again writes the same bytes to the same place.
    """

    folder = resolved(cells.sparkSession, folder)

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        t, z = int(pdf["t"].iloc[0]), int(pdf["z"].iloc[0])
        at = pdf["y"].to_numpy() * width + pdf["x"].to_numpy()
        plane, held = np.zeros(height * width, dtype="<f4"), np.zeros(height * width, dtype=bool)
        plane[at], held[at] = pdf["v"].to_numpy(), True
        if held.sum() != len(at):
            raise ValueError(f"slice t={t} z={z} has a cell twice")
        data = plane.tobytes() + np.packbits(held).tobytes()
        path = f"{folder}/t{t:06d}_z{z:06d}.raw"
        files, inner = located(path)
        files.create_dir(inner.rpartition("/")[0], recursive=True)
        with files.open_output_stream(inner) as f:
            f.write(data)
        return pd.DataFrame({"t": [t], "z": [z], "path": [path], "n_bytes": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()]})

    return cells.select("x", "y", "z", "t", "v").groupBy("t", "z").applyInPandas(store, "t long, z long, path string, n_bytes long, sha256 string")


def read_slices(spark: SparkSession, folder: str, width: int, height: int) -> DataFrame:
    """The cells of a folder of slices."""

    def cells(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                n = width * height
                v = np.frombuffer(content, dtype="<f4", count=n)
                at = np.flatnonzero(np.unpackbits(np.frombuffer(content, dtype=np.uint8, offset=4 * n), count=n))
                t, z = path.rpartition("/")[2].removesuffix(".raw").split("_")
                yield pd.DataFrame({"x": at % width, "y": at // width, "z": int(z[1:]), "t": int(t[1:]), "v": v[at]})

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(cells, "x long, y long, z long, t long, v float")
