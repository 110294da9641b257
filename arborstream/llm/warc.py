"""WARC archives as a PySpark data source.

Writing: one archive a task, each record a gzip member of its own whose header
carries the member's length, so that a reader can step over it.  Reading: file
partitions are planned on the driver, filters on the record type and other
headers are pushed down, headers are parsed first, and the payload of a record
that no filter admits, or that no column asks for, is never decoded.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import arrow_rows, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"
#: Columns that the header alone gives, and the field each is from.
HEADER_FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
ROWS_OUT = 256
#: Archives that the driver gives their names at once when a write ends.
COMMIT_THREADS = 32
_EXTRA = b"sl"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def digest_field(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def digest_hex(field: str | None) -> str | None:
    if not field:
        return None
    algorithm, _, value = field.partition(":")
    if algorithm.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(record_type: str, record_id: str, uri: str, digest: str, payload: bytes, refers_to: str | None = None, full_length: int | None = None) -> bytes:
    """One record: headers, block, two line ends."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(uri)}",
        f"WARC-Payload-Digest: {digest_field(digest)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    if full_length is not None:
        head.append(f"X-Payload-Length: {full_length}")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that says its own length in an extra field."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = _EXTRA + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Members:
    """The records of an archive: gzip members one after the other, or plain records."""

    def __init__(self, source: Any):
        self.source = source
        self.size = source.size()

    def __iter__(self) -> Iterator[tuple[dict[str, str], Any]]:
        """(header fields, function that gives the block); a block not asked for is stepped over."""
        at = 0
        while at < self.size:
            self.source.seek(at)
            start = self.source.read(1 << 14)
            if start[:2] == b"\x1f\x8b":
                at = yield from self._zipped(at, start)
            elif start.strip(b"\r\n") == b"":
                at += len(start)
            else:
                at = yield from self._plain(at, start)

    def _zipped(self, at: int, start: bytes) -> Iterator[tuple[dict[str, str], Any]]:
        length = self._own_length(start)
        inflate = zlib.decompressobj(31)
        head = bytearray()
        fed = 0

        def more(chunk: int) -> bytes:
            nonlocal fed
            self.source.seek(at + fed)
            data = start[fed:] if fed < len(start) else self.source.read(chunk)
            fed += len(data)
            return data

        pending = b""
        while b"\r\n\r\n" not in head and not inflate.eof:
            pending = pending or more(1 << 14)
            if not pending:
                raise ValueError("an archive ends within a record")
            head += inflate.decompress(pending, 1 << 12)
            pending = inflate.unconsumed_tail
        fields, begin = parse_header(bytes(head))
        content = int(fields.get("content-length", 0))

        def block() -> bytes:
            nonlocal pending
            while len(head) < begin + content and not inflate.eof:
                pending = pending or more(1 << 18)
                if not pending:
                    break
                head.extend(inflate.decompress(pending))
                pending = inflate.unconsumed_tail
            return bytes(head[begin : begin + content])

        yield fields, block
        if length:
            return at + length
        block()  # no length was written: the member's end is where its data end
        while not inflate.eof:
            pending = pending or more(1 << 18)
            if not pending:
                break
            inflate.decompress(pending)
            pending = inflate.unconsumed_tail
        return at + fed - len(inflate.unused_data)

    @staticmethod
    def _own_length(start: bytes) -> int:
        if not start[3] & 4:
            return 0
        (size,) = struct.unpack_from("<H", start, 10)
        at, end = 12, 12 + size
        while at + 4 <= end:
            (n,) = struct.unpack_from("<H", start, at + 2)
            if start[at : at + 2] == _EXTRA and n >= 4:
                return struct.unpack_from("<I", start, at + 4)[0]
            at += 4 + n
        return 0

    def _plain(self, at: int, start: bytes) -> Iterator[tuple[dict[str, str], Any]]:
        while b"\r\n\r\n" not in start:
            data = self.source.read(1 << 14)
            if not data:
                raise ValueError("an archive ends within a header")
            start += data
        fields, begin = parse_header(start)
        content = int(fields.get("content-length", 0))

        def block() -> bytes:
            self.source.seek(at + begin)
            return self.source.read(content)

        yield fields, block
        return at + begin + content + 4


def parse_header(data: bytes) -> tuple[dict[str, str], int]:
    """Fields by lower-case name, and where the block begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


@dataclass
class FilePart(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    """options: path (a folder or file), files_per_partition, payload ("false" leaves payloads undecoded)."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema_names = schema.fieldNames()
        self.path = options["path"]
        self.per = max(1, int(options.get("files_per_partition", "1")))
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.wanted: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership and presence of header columns are decided here; other filters stay with Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADER_FIELDS and isinstance(f, EqualTo):
                self.wanted.append((name, frozenset([f.value])))
            elif name in HEADER_FIELDS and isinstance(f, In):
                self.wanted.append((name, frozenset(f.value)))
            elif name in HEADER_FIELDS and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        names = sorted(f.path for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        return [FilePart(names[a : a + self.per]) for a in range(0, len(names), self.per)] or [FilePart([])]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        rows: list[tuple] = []
        for path in partition.paths:
            with fs.open_input_file(path) as source:
                for fields, block in Members(source):
                    row = self.header(fields)
                    if not all(row[n] is not None and (v is None or row[n] in v) for n, v in self.wanted):
                        continue
                    payload = block() if self.with_payload and row["record_type"] != "revisit" else None
                    rows.append(tuple(row.get(n) if n != "payload" else payload for n in self.schema_names))
                    if len(rows) >= ROWS_OUT:
                        yield self.batch(rows)
                        rows = []
        if rows:
            yield self.batch(rows)

    @staticmethod
    def header(fields: dict[str, str]) -> dict[str, Any]:
        get = fields.get
        strip = lambda x: x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x
        return {
            "record_id": strip(get("warc-record-id")),
            "record_type": get("warc-type"),
            "target_uri": get("warc-target-uri"),
            "payload_digest": digest_hex(get("warc-payload-digest")),
            "refers_to": strip(get("warc-refers-to")),
            "payload_length": int(get("x-payload-length", get("content-length", "0"))),
        }

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"payload_length": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds.get(n, pa.string())) for j, n in enumerate(self.schema_names)], names=self.schema_names)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class WarcWriter(DataSourceWriter):
    """Each task writes an archive under a name of its own; the names of failed attempts are removed or never listed."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.names = schema.fieldNames()
        self.path = options["path"]
        self.compress = options.get("compression", "gzip") == "gzip"
        fs, root = file_system(self.path)
        if overwrite and fs.get_file_info(root).type != pafs.FileType.NotFound:
            fs.delete_dir_contents(root)
        fs.create_dir(root, recursive=True)

    def write(self, rows: Iterator[Any]) -> Written:
        fs, root = file_system(self.path)
        # hidden until the commit, so that a second attempt's copy is never read
        name = f"{root}/_{uuid.uuid4().hex}.{'warc.gz' if self.compress else 'warc'}"
        out = None
        for row in rows:
            r = row.asDict()
            if out is None:
                out = fs.open_output_stream(name + ".part", compression=None)
            data = record_bytes(r["record_type"], r["record_id"], r["target_uri"] or "", r["payload_digest"], bytes(r["payload"] or b""), r["refers_to"], r["payload_length"])
            out.write(member(data) if self.compress else data)
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written]) -> None:
        fs, _ = file_system(self.path)

        def name(path: str) -> None:
            folder, _, last = path.rpartition("/")
            fs.move(path + ".part", f"{folder}/{last[1:]}")

        with ThreadPoolExecutor(COMMIT_THREADS) as pool:  # a file a task, and stores answer slowly
            list(pool.map(name, [m.path for m in messages if m and m.path]))

    def abort(self, messages: list[Written]) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            if m and m.path:
                fs.delete_file(m.path + ".part")


class WarcDataSource(DataSource):
    """format("warc"): reads and writes records of SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


RECORD_ID = "urn:page:"
LEAST_BYTES = 1000


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Records of SCHEMA, one a page: of equal payloads of `least_bytes` or more the largest id is the response."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    # only the ids and digests of payloads that stand more than once are joined back
    first = rows.where(F.col("payload_length") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("times")).where("times > 1")
    first = first.select(F.col("payload_digest").alias("d"), "first")
    told = rows.join(first, F.col("payload_digest") == F.col("d"), "left")
    again = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    return told.select(
        F.concat(F.lit(RECORD_ID), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        "payload_digest",
        F.when(again, F.concat(F.lit(RECORD_ID), F.col("first").cast("string"))).alias("refers_to"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive_and_read(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from its archives.

    The digest of a response is taken from the payload as read; a revisit
    holds no payload, and its header names the full payload's digest and
    length.  A null html is an empty payload.  Rows that repeat one id with one
    payload are all responses (a record never refers to its own id).  A null id
    reads back as null; its record is a response even where another page has
    its payload, and no revisit refers to it.  An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    register(spark)
    arrow_rows(spark, 512)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records(pages, least_bytes).write.format("warc").mode("append").save(folder)
    responses = spark.read.format("warc").load(folder).where(F.col("record_type") == "response")
    revisits = spark.read.format("warc").option("payload", "false").load(folder).where(F.col("record_type") == "revisit")
    number = lambda c: F.expr(f"try_cast(substr({c}, {len(RECORD_ID) + 1}) as long)")
    full = responses.select(
        number("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    short = revisits.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return full.unionByName(short)


