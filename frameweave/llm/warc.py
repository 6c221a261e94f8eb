"""WARC archives: a Python data source that writes and reads them.

Reading plans partitions of whole files, small ones together. Filters on ``warc_type``, ``page_id``, ``target_uri``,
``payload_digest``, ``refers_to`` and ``payload_bytes`` are taken over by the source: a record's header is parsed
first, and the payload of a record that a filter turns down, or of any record if the column isn't asked for, is
skipped without being read or decoded.

Writing: rows whose payloads are equal (by SHA-1) and of at least ``least`` bytes are one ``response`` record, that of
the largest id, and ``revisit`` records of it. What is repeated is found with ids and digests; payloads are not shuffled
unless there are more repeated ones than may be sent to all executors. Each record is a gzip member of its own, whose
extra field ``sl`` has the member's length, so that a reader inflates a header and seeks over the rest. Tasks write files
of bounded size under hidden names, and the driver gives those of the tasks that counted their own: a lost executor
leaves nothing that a reader sees.

Archives of others may be plain, compressed as a whole, or by record without that field: then what is turned down is
sought over in plain files and inflated in compressed ones. Files are not split.

Edge cases: a null payload is empty; a null id has no smaller or larger one and its row is a response unless some equal
payload has an id; rows that share the largest id are all responses; control characters and blanks in a URL are
percent-encoded, a null URL has no header; a file cut off ends with its last whole record; an empty table gives no records.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import io
import os
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ._io import small_batches, stash

SCHEMA = "page_id bigint, warc_type string, target_uri string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
#: Bytes of files that a partition reads, unless one file is larger; and of a file that is written.
PARTITION_BYTES = FILE_BYTES = 32 << 20
#: Repeated digests that are sent to all executors, some 40 bytes each.
MOST_SENT = 100_000
#: Bytes of a member that are read for its header at first.
PEEK = 1024
EOL = "\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: Column) -> Column:
    """SHA-1 in base 32, without a prefix."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """The record of every row: ``head``, up to where the payload begins, and ``payload``, null for a revisit."""
    raw = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), raw.alias("payload"), digest(raw.cast("binary")).alias("digest"), F.octet_length(raw).alias("size"))
    # only what is repeated is joined back: digests of single payloads stay where they are
    large = rows.where(F.col("size") >= least)
    again = large.groupBy("digest").agg(F.max("id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null").select("digest", "largest")
    again = stash(again, "warc-repeated")
    few = again.count() <= MOST_SENT
    joined = rows.join(F.broadcast(again) if few else again, "digest", "left")
    first = F.when((F.col("size") >= least) & F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest")), F.col("largest"))
    rows = joined.withColumn("of", first)

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL)), F.lit(""))

    def identity(of: Column) -> Column:
        h = F.md5(F.concat(F.lit("frameweave page "), F.coalesce(of.cast("string"), F.lit("null"))))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))

    revisit = F.col("of").isNotNull()
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x20]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(EOL + EOL))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    return rows.select(
        F.concat(
            F.lit(f"WARC/1.1{EOL}"),
            header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            header("WARC-Record-ID", identity(F.col("id"))),
            header("WARC-Date", F.lit(DATE)),
            header("WARC-Target-URI", uri),
            header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            header("WARC-Refers-To", F.when(revisit, identity(F.col("of")))),
            header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            header("X-Page-Id", F.col("id")),
            header("X-Refers-To-Page-Id", F.col("of")),
            header("X-Payload-Bytes", F.col("size")),
            header("Content-Type", F.lit("application/http; msgtype=response")),
            header("Content-Length", length),
            F.lit(EOL),
            http,
        ).alias("head"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str, least: int = 0, **columns: str) -> None:
    """Write the archive files of ``pages`` into the folder ``path``."""
    pages.sparkSession.dataSource.register(WarcSource)
    small_batches(pages.sparkSession)
    records(pages, least, **columns).write.format("warc").mode("append").save(path)


def member(record: bytes, level: int = 6) -> bytes:
    """``record`` as a gzip member that says how long it is."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(record) + deflate.flush()
    size = 12 + 12 + len(body) + 8  # fixed part, extra field, body, check sum and length
    sizes = (size, len(record)) if max(size, len(record)) < 1 << 32 else (0, 0)
    head = struct.pack("<4sIBBH2sHII", b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, *sizes)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Files of records; hidden until the whole table is written."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, top = _system(self.path)
        system.create_dir(top, recursive=True)
        names: list[str] = []
        with contextlib.ExitStack() as files:
            to, held = None, FILE_BYTES
            for batch in batches:
                for head, payload in zip(batch.column("head"), batch.column("payload"), strict=True):
                    if held >= FILE_BYTES:
                        files.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        to, held = files.enter_context(system.open_output_stream(f"{top}/.{names[-1]}", compression=None)), 0
                    held += to.write(member(b"".join((head.as_buffer().to_pybytes(), payload.as_buffer().to_pybytes() if payload.is_valid else b"", b"\r\n\r\n"))))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = _system(self.path)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{top}/.{name}", f"{top}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, top = _system(self.path)
        for m in messages:
            for name in m.names if m else ():
                system.delete_file(f"{top}/.{name}")


# --- reading ---


def _system(path: str):
    """The file system of ``path``, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = urllib.parse.unquote(urllib.parse.urlparse(path).path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _files(path: str) -> list[tuple[str, int]]:
    """Files below ``path`` with their sizes, but those that begin with a dot or an underscore."""
    from pyarrow import fs

    system, top = _system(path)
    info = system.get_file_info(top)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    scheme = path.partition("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and f.size and f.base_name[0] not in "._")


def _open(path: str):
    system, name = _system(path)
    return system.open_input_file(name)


class Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


Record = tuple[dict[str, str], "Callable[[], bytes | None]"]


def _fields(lines: list[bytes]) -> dict[str, str]:
    """The named fields of a header, after its first line."""
    named = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in named}


def _walk(path: str) -> Iterator[Record]:
    """The header fields of every record of a file, and a function that gives its block, or None where the file is cut off.
    What isn't asked for is passed over."""
    with _open(path) as raw:
        if not path.endswith(".gz"):
            yield from _stream(io.BufferedReader(raw, 1 << 16), raw.size())
            return
        size, at = raw.size(), 0
        while at < size:
            raw.seek(at)
            begin = raw.read(24)
            if len(begin) < 24:
                return
            length, skip = _extent(begin)
            if not length:  # the member doesn't say where it ends, and so nor do those after it
                raw.seek(at)
                with gzip.GzipFile(fileobj=raw) as stream:
                    yield from _stream(stream, None)
                return
            if at + length > size:
                return
            yield from _member(raw, at + skip, at + length)
            at += length


def _extent(begin: bytes) -> tuple[int, int]:
    """Length of a gzip member and of what stands before its body; zeros where it doesn't say."""
    if begin[:4] != b"\x1f\x8b\x08\x04":
        return 0, 0
    extra, name, _, length, _ = struct.unpack("<H2sHII", begin[10:24])
    return (length, 24) if name == b"sl" and extra == 12 and length > 32 else (0, 0)


def _member(raw, at: int, end: int) -> Iterator[Record]:
    """The record of a member whose body lies from ``at`` on: of the body no more is read than the header needs."""
    inflate, text = zlib.decompressobj(-zlib.MAX_WBITS), b""
    raw.seek(at)
    while b"\r\n\r\n" not in text and at < end:
        more = raw.read(min(PEEK, end - at))
        at += len(more)
        text += inflate.decompress(more)
    head, _, begun = text.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        return
    fields = _fields(lines[1:])

    def block() -> bytes | None:
        length = _number(fields.get("content-length")) or 0
        whole = begun + inflate.decompress(raw.read(end - at))
        return whole[:length] if len(whole) >= length else None

    yield fields, block


def _stream(stream, size: int | None) -> Iterator[Record]:
    """Records one after the other; ``size``: of a file that can be sought in, else None."""
    with contextlib.suppress(EOFError):
        while True:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line.startswith(b"WARC/"):
                return
            lines = []
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                lines.append(line)
            if not line:
                return
            fields = _fields(lines)
            length = _number(fields.get("content-length")) or 0
            asked: list[bytes] = []

            def block(length: int = length, asked: list[bytes] = asked) -> bytes | None:
                asked.append(stream.read(length))
                return asked[0] if len(asked[0]) == length else None

            if size is not None and stream.tell() + length > size:
                return
            yield fields, block
            if not asked:
                _skip(stream, length, size is not None)


def _skip(stream, length: int, seeks: bool) -> None:
    """Pass over a block: by a seek, or by inflating it in small steps."""
    if seeks:
        stream.seek(length, os.SEEK_CUR)
        return
    while length > 0 and (step := len(stream.read(min(length, 1 << 16)))):
        length -= step


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


class WarcReader(DataSourceReader):
    """Plans files, takes filters over, parses headers first."""

    def __init__(self, path: str, wanted: list[str]) -> None:
        self.path, self.wanted, self.filters = path, wanted, []

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", ())
            if len(name) == 1 and name[0] in FIELDS and name[0] != "payload" and isinstance(f, (EqualTo, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        groups: list[list[str]] = []
        held = PARTITION_BYTES
        for name, size in _files(self.path):
            if held + size > PARTITION_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(name)
            held += size
        return [Files(g) for g in groups] or [Files([])]

    def _admits(self, row: dict) -> bool:
        for f in self.filters:
            v = row[f.attribute[0]]
            ok = (
                v is None if isinstance(f, IsNull)
                else v is not None and (
                    isinstance(f, IsNotNull)
                    or (isinstance(f, EqualTo) and v == f.value)
                    or (isinstance(f, In) and v in f.value)
                    or (isinstance(f, GreaterThan) and v > f.value)
                    or (isinstance(f, GreaterThanOrEqual) and v >= f.value)
                    or (isinstance(f, LessThan) and v < f.value)
                    or (isinstance(f, LessThanOrEqual) and v <= f.value)
                )
            )
            if not ok:
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=kinds.get(n, pa.string())) for i, n in enumerate(self.wanted)], names=self.wanted)

        for name in partition.names:
            for fields, block in _walk(name):
                row = {
                    "page_id": _number(fields.get("x-page-id")), "warc_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
                    "payload_bytes": _number(fields.get("x-payload-bytes")), "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                    "refers_to": _number(fields.get("x-refers-to-page-id")), "payload": None,
                }
                if not self._admits(row):
                    continue
                if "payload" in self.wanted and row["warc_type"] != "revisit":
                    if (whole := block()) is None:
                        break
                    row["payload"] = whole.partition(b"\r\n\r\n")[2]
                    held += len(row["payload"])
                rows.append(tuple(row[n] for n in self.wanted))
                if len(rows) >= 2000 or held >= 8 << 20:
                    yield batch()
                    rows.clear()
                    held = 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """``spark.read.format("warc").schema(...).load(path)``; a schema names the columns that are wanted."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def read(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Records of the archive folder ``path``: the named columns, those that ``where`` admits.

    Spark hands filters to Python sources only if a session setting says so, and reads it whenever a plan is optimised: with
    ``where``, it stays on.
    """
    spark.dataSource.register(WarcSource)
    if where is not None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    fields = [f for f in SCHEMA.split(", ") if columns is None or f.split()[0] in columns]
    df = spark.read.format("warc").schema(", ".join(fields)).load(path)
    return df if where is None else df.where(where)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
