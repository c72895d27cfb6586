"""Operator 8, WARC archives as a PySpark Python data source.

The writer makes one archive a task, every record a gzip member. The reader plans one
input partition a file (.warc.gz or plain .warc), takes over predicates on record type and
other headers, parses a record's headers first and puts a payload together only if the
record passes and a column of the query needs it. Records of any type are read: the
payload of an HTTP message is its body, that of any other record its whole block.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from . import common

SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)
#: Predicates on these columns are decided from a record's headers.
HEADERS = ("record_id", "record_type", "target_uri", "warc_date", "refers_to", "payload_digest")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
#: Rows of one payload meet its first page in so many parts.
PARTS = 16


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, record_type: str, uri: str | None, digest: str, size: int, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record: response (with its payload) or revisit (HTTP headers only)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if record_type == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + " ".join(uri.split()))
    if record_type == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class WarcWriter(DataSourceWriter):
    """Rows (record_id, record_type, target_uri, refers_to, payload, payload_sha1, payload_bytes): an archive a task, renamed into place on commit.

    Digest and size are taken from a payload where they are null.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        system, base = fs.FileSystem.from_uri(self.path)
        out, name = None, None
        for row in iterator:
            if out is None:
                system.create_dir(base, recursive=True)
                name = f"{base}/.part-{uuid.uuid4().hex}.warc.gz"
                out = system.open_output_stream(name, compression=None)
            payload = bytes(row.payload) if row.payload is not None else b""
            size = len(payload) if row.payload_bytes is None else row.payload_bytes
            digest = payload_digest(payload) if row.payload_sha1 is None else base64.b32encode(bytes.fromhex(row.payload_sha1)).decode()
            made = record(row.record_id, row.record_type, row.target_uri, digest, size, payload, row.refers_to)
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.write(squeeze.compress(made) + squeeze.flush())
        if out is not None:
            out.close()
        return Written(name)

    def commit(self, messages):
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.path:
                folder, _, name = m.path.rpartition("/")
                system.move(m.path, f"{folder}/{name[1:]}")

    def abort(self, messages):
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


class _Stream:
    """The bytes of one archive, inflated where its members are gzip; what is skipped is never copied together.

    Bytes wait in a buffer with a place to read from, which is cut off only now and then,
    so any number of small reads costs what the bytes cost.
    """

    def __init__(self, source, squeezed: bool):
        self.source, self.squeezed, self.inflate, self.rest = source, squeezed, None, b""
        self.buffer, self.at = bytearray(), 0

    def _next(self) -> bytes | None:
        while True:
            raw = self.rest or self.source.read(CHUNK)
            self.rest = b""
            if not raw:
                return None
            if not self.squeezed:
                return raw
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            got = self.inflate.decompress(raw, CHUNK * 16)
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, None
            else:
                self.rest = self.inflate.unconsumed_tail
            if got:
                return got

    def _more(self) -> bool:
        got = self._next()
        if got is None:
            return False
        if self.at > CHUNK and self.at > len(self.buffer) // 2:
            del self.buffer[: self.at]
            self.at = 0
        self.buffer += got
        return True

    def until_blank(self, limit: int | None = None) -> bytes | None:
        """A header block up to its blank line; None at the end, or if there is no blank line among the next limit bytes."""
        seek = self.at
        while (found := self.buffer.find(b"\r\n\r\n", seek)) < 0:
            held = len(self.buffer) - self.at
            if (limit is not None and held >= limit) or not self._more():
                return None
            seek = max(self.at, self.at + held - 3)
        if limit is not None and found + 4 - self.at > limit:
            return None
        block, self.at = bytes(self.buffer[self.at : found]), found + 4
        return block.lstrip(b"\r\n")

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._more():
            pass
        block = bytes(self.buffer[self.at : self.at + n])
        self.at += len(block)
        return block

    def skip(self, n: int) -> None:
        while n > len(self.buffer) - self.at:
            n -= len(self.buffer) - self.at
            self.buffer, self.at = bytearray(), 0
            got = self._next()
            if got is None:
                return
            self.buffer += got
        self.at += n


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


@dataclass
class Archive(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns
        self.wanted: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.present.add(f.attribute[0])
            else:
                yield f

    def partitions(self):
        system, base = fs.FileSystem.from_uri(self.path)
        files = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return [Archive(f.path) for f in sorted(files, key=lambda f: f.path) if f.base_name.endswith((".warc.gz", ".warc")) and f.base_name[0] not in "._"]

    def read(self, partition):
        if not isinstance(partition, Archive):
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        decode = "payload" in self.columns
        with system.open_input_stream(partition.path, compression=None) as source:
            stream = _Stream(source, partition.path.endswith(".gz"))
            while (block := stream.until_blank()) is not None:
                if not block:
                    continue
                head = _fields(block)
                left = int(head.get("content-length", 0))
                row = {
                    "record_id": _bare(head.get("warc-record-id")),
                    "record_type": head.get("warc-type"),
                    "target_uri": head.get("warc-target-uri"),
                    "warc_date": head.get("warc-date"),
                    "refers_to": _bare(head.get("warc-refers-to")),
                    "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                }
                if any(row[k] not in v for k, v in self.wanted.items()) or any(row[k] is None for k in self.present):
                    stream.skip(left + 4)
                    continue
                row["payload_bytes"] = left
                # only a block of type application/http has an HTTP head of its own
                if head.get("content-type", "").lower().startswith("application/http"):
                    http = stream.until_blank(left)
                    if http is not None:
                        left -= len(http) + 4
                        told = _fields(http).get("content-length", "")
                        row["payload_bytes"] = int(told) if row["record_type"] == "revisit" and told.isdigit() else left
                if decode:
                    row["payload"] = stream.take(left)
                    stream.skip(4)
                else:
                    stream.skip(left + 4)
                yield tuple(row.get(c) for c in self.columns)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder) and df.write.format("warc").mode("append").save(folder).

    A schema with fewer columns may be given to the reader; without the column payload no
    payload is put together.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], [f.name for f in schema])

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes each row of pages (page_id, url, html) as a record.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of
    least bytes or more that with the largest page_id is response and the others revisit
    it; smaller ones are all responses. Rows that repeat the largest page_id are all
    responses; a row without page_id is one too unless another row has its payload and
    an id. Equal payloads are counted by digest before they meet the rows, and rows meet
    the first page of their payload without html and in parts, so a digest that very many
    rows share moves numbers only, to several tasks.
    """
    sha1, uri = F.sha1(F.encode("html", "UTF-8")), lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    light = rows.select("page_id", "url", sha1.alias("d"), F.octet_length("html").cast("long").alias("n")).where(f"n >= {int(least)}")
    first = light.groupBy("d").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("d", "first")
    repeated = common.written(first.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).select(F.concat_ws(":", "d", "part").alias("dp"), "first"), "payloads")
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS))
    later = common.rows_joined(light.withColumn("dp", F.concat_ws(":", "d", part)), repeated, "dp").where(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    key = lambda d: F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), d)
    later = common.written(later.select(key(F.col("d")).alias("key"), "page_id", "url", "first", "d", "n"), "revisits")
    responses = common.rows_without(rows.withColumn("key", key(sha1)), later.select("key").distinct(), "key")
    told = lambda c, kind: F.lit(c).cast(kind)
    made = responses.select(
        uri(F.col("page_id")).alias("record_id"), F.lit("response").alias("record_type"), F.col("url").alias("target_uri"), told(None, "string").alias("refers_to"),
        F.encode("html", "UTF-8").alias("payload"), told(None, "string").alias("payload_sha1"), told(None, "long").alias("payload_bytes"),
    )
    again = later.select(
        uri(F.col("page_id")).alias("record_id"), F.lit("revisit").alias("record_type"), F.col("url").alias("target_uri"), uri(F.col("first")).alias("refers_to"),
        told(None, "binary").alias("payload"), F.col("d").alias("payload_sha1"), F.col("n").alias("payload_bytes"),
    )
    made.unionByName(again).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, columns=("record_id", "record_type", "target_uri", "warc_date", "refers_to", "payload_digest", "payload_bytes", "payload")) -> DataFrame:
    kinds = dict(part.strip().split(" ") for part in SCHEMA.split(","))
    return spark.read.format("warc").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).load(path)


def resolved(spark: SparkSession, path: str) -> str:
    """The path with its file system: one without a scheme lies in Spark's default file system, as it does for Spark's own readers and writers."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path
    home = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return f"{home.rstrip('/')}{path}" if home.rstrip("/") != "file:" else f"file://{path}"


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    For responses size and digest are those of the payload that was read.
    """
    register(spark)
    path = common.new_path(spark, "warc")
    path = resolved(spark, path)
    write_pages(pages, path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1), F.lit("")).cast("long")
    whole = read_archives(spark, path).where("record_type = 'response'")
    seen = whole.select(
        number("record_id").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        _base32_sha1("payload").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    named = read_archives(spark, path, ("record_id", "record_type", "refers_to", "payload_digest", "payload_bytes")).where("record_type = 'revisit'")
    again = named.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return seen.unionByName(again)


def _base32_sha1(column: str):
    @F.pandas_udf("string")
    def digest(payload):
        return payload.map(lambda p: payload_digest(bytes(p)))

    return digest(column)
