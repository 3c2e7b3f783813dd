"""WARC records in ZIP packages: written by tasks, read back by byte ranges.

A package holds ``archive/data.warc.gz`` (each record its own gzip member) and
``indexes/index.cdxj`` (one JSON line per record with its offset and length), both *stored*, so a
record's place in the package is the member's place plus its offset.  Packages go to a shared
folder through ``pyarrow.fs`` under names that no other attempt uses, closed once they exceed
``PACKAGE_BYTES``; a manifest that Spark commits lists the packages of the attempts that count.

The reader never extracts a package: it reads the end record (ZIP64 as well), the central
directory and the indexes by ranges, deals runs of neighbouring records out to tasks, and each task
reads its runs by range.  Every stored WARC member is read whole, gzipped or plain: index lines (JSON, with or
without a file name) only tell where records start, so records that no line names are read too, and members without
an index are one run, read through record by record.  A WARC member that the package compresses is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.llm.common import sized_broadcast, stored, table
from paraspark.session import scratch_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 64 << 20    # a package closes after the record that exceeds this
RUN_BYTES = 1 << 20         # neighbouring records that a task reads at once
INDEX_BYTES = 4 << 20       # index and directory bytes read at once
BROADCAST_ROWS = 1_000_000
_WARC, _INDEX = re.compile(r"\.warc(\.gz)?$", re.IGNORECASE), re.compile(r"^indexes/.*\.cdxj?$", re.IGNORECASE)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

Batches = Iterator[pa.RecordBatch]


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(value: str) -> str:
    """Control characters would end a header line; they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


# ---- writing -----------------------------------------------------------------------------------

def warc_record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit that refers to another record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{_header_value(record_id)}>",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header_value(uri)}")
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_header_value(refers_to)}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class _Sink:
    """What ``zipfile`` needs of a stream that cannot seek."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.write, self.flush = stream, stream.write, stream.flush


class _Package:
    def __init__(self, folder: str, name: str) -> None:
        self.uri = f"{folder}/{name}"
        filesystem, path = _open_fs(self.uri)
        filesystem.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = filesystem.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Sink(self.stream), "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, record: bytes, entry: dict) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.data.write(packed)
        self.lines.append(f"{entry['id']} {DATE[:10].replace('-', '')}000000 "
                          + json.dumps(entry | {"offset": str(self.size), "length": str(len(packed))}))
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            index.write("".join(x + "\n" for x in self.lines).encode())
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines), self.size


def write_warc(df: DataFrame, folder: str, id_col: str, uri_col: str, payload_col: str, refers_col: str,
               package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row and return the committed manifest ``(package, records, bytes)``.

    ``id`` and ``refers_to`` are strings, the payload is binary (null: empty).  A null
    ``refers_to`` makes a response; a revisit keeps its payload's digest and length, not the payload.  An empty table writes no package.
    """
    def write(batches: Batches) -> Batches:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        package, done = None, []
        for batch in batches:
            for record_id, uri, payload, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if package is None:
                    package = _Package(folder, f"{name}-{len(done):04d}.wacz")
                digest = payload_digest(payload or b"")
                package.add(warc_record(record_id, uri, payload or b"", digest, refers_to),
                            {"id": record_id, "digest": digest, "mime": "text/html", "status": "200", "filename": DATA.rpartition("/")[2]})
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        yield pa.record_batch([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()),
                               pa.array([x[2] for x in done], pa.int64())], names=["package", "records", "bytes"])

    rows = df.select(id_col, uri_col, payload_col, refers_col)
    return stored(rows.mapInArrow(write, "package string, records long, bytes long"), "warc-manifest")


# ---- reading -----------------------------------------------------------------------------------

class RangeZip:
    """The directory of a ZIP file, read by ranges: ``members`` is name -> (offset of the data, size).

    It lists what is stored; the names of compressed members are in ``compressed``.
    """

    def __init__(self, uri: str) -> None:
        filesystem, path = _open_fs(uri)
        self.file = filesystem.open_input_file(path)
        self.compressed: list[str] = []
        self.members = dict(self._stored_members(*self._directory(self.file.size())))

    def read(self, offset: int, size: int) -> bytes:
        got = self.file.read_at(size, offset)
        if len(got) != size:
            raise ValueError("the archive ends early")
        return got

    def _directory(self, size: int) -> tuple[int, int, int]:
        """(offset, size, entries) of the central directory, from the end record or its ZIP64 form."""
        tail_at = max(0, size - 22 - 65_535)
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\5\6", 0, at)      # a signature inside the comment
        if at < 0:
            raise ValueError("no end record: not a ZIP archive")
        entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            locator = self.read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            record = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
            entries, length, offset = struct.unpack_from("<QQQ", record, 32)
        return offset, length, entries

    def _stored_members(self, at: int, length: int, entries: int) -> Iterator[tuple[str, tuple[int, int]]]:
        buffer, end = b"", at + length
        for _ in range(entries):
            while len(buffer) < 46 or len(buffer) < 46 + sum(struct.unpack_from("<HHH", buffer, 28)):
                if at >= end:
                    raise ValueError("the central directory ends early")
                buffer += self.read(at, more := min(INDEX_BYTES, end - at))
                at += more
            if buffer[:4] != b"PK\1\2":
                raise ValueError("not a central directory entry")
            flags, method = struct.unpack_from("<HH", buffer, 8)
            packed, size = struct.unpack_from("<II", buffer, 20)
            n_name, n_extra, n_comment = struct.unpack_from("<HHH", buffer, 28)
            header = struct.unpack_from("<I", buffer, 42)[0]
            name = buffer[46:46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = buffer[46 + n_name:46 + n_name + n_extra]
            wide = [k for k, v in (("size", size), ("packed", packed), ("header", header)) if v == 0xFFFFFFFF]
            values = dict(zip(wide, self._zip64(extra, len(wide)), strict=True))
            size, packed, header = values.get("size", size), values.get("packed", packed), values.get("header", header)
            buffer = buffer[46 + n_name + n_extra + n_comment:]
            if method == 0:
                local = self.read(header, 30)
                yield name, (header + 30 + sum(struct.unpack_from("<HH", local, 26)), size)
            else:
                self.compressed.append(name)

    @staticmethod
    def _zip64(extra: bytes, wanted: int) -> tuple[int, ...]:
        at = 0
        while wanted and at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                return struct.unpack_from(f"<{wanted}Q", extra, at + 4)
            at += 4 + size
        if wanted:
            raise ValueError("no ZIP64 sizes")
        return ()

    def lines(self, name: str) -> Iterator[bytes]:
        """The lines of a stored member, read range by range."""
        at, size = self.members[name]
        end, rest = at + size, b""
        while at < end:
            got = self.read(at, min(INDEX_BYTES, end - at))
            at += len(got)
            *whole, rest = (rest + got).split(b"\n")
            yield from whole
        if rest:
            yield rest


def _record_starts(package: RangeZip, warcs: list[str]) -> dict[str, array]:
    """Per WARC member the offsets that the package's indexes list."""
    starts = {name: array("q") for name in warcs}
    for index in filter(_INDEX.search, package.members):
        for line in package.lines(index):
            if (at := line.find(b"{")) < 0:
                continue        # a heading, or a line of another format
            entry = json.loads(line[at:])
            if "offset" not in entry:
                continue
            file = entry.get("filename")
            names = [n for n in warcs if file is None or n == file or n.endswith("/" + file)]
            if len(names) != 1:
                raise ValueError(f"an index line of {file or 'no file'} does not tell its archive member")
            if not 0 <= int(entry["offset"]) < package.members[names[0]][1]:
                raise ValueError(f"an index line lies outside {names[0]}")
            starts[names[0]].append(int(entry["offset"]))
    return starts


def _runs(batches: Batches) -> Batches:
    """From packages to runs of neighbouring records, which cover all WARC members: ``(package, offset, length)``."""
    for batch in batches:
        for uri in batch.column("package").to_pylist():
            package = RangeZip(uri)
            if packed := [name for name in package.compressed if _WARC.search(name)]:
                raise ValueError(f"{packed[0]} is compressed in its package, so it cannot be read by ranges")
            out: list[tuple[int, int]] = []
            for name, listed in _record_starts(package, [n for n in package.members if _WARC.search(n)]).items():
                base, size = package.members[name]
                cuts = np.unique(np.append(np.frombuffer(listed, np.int64), [0, size]))
                at = 0
                while at < len(cuts) - 1:       # to the last record start within reach, a larger record by itself
                    to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + RUN_BYTES, "right")) - 1)
                    out.append((base + int(cuts[at]), int(cuts[to] - cuts[at])))
                    at = to
            yield pa.record_batch([pa.array([uri] * len(out), pa.string()), pa.array([x[0] for x in out], pa.int64()),
                                   pa.array([x[1] for x in out], pa.int64())], names=["package", "offset", "length"])


def _unpacked(package: RangeZip, offset: int, length: int) -> Iterator[bytes]:
    """The bytes of a range piece by piece, unpacked if it holds gzip members."""
    end, pending, gzipped, unpacker = offset + length, b"", None, None
    while offset < end or pending or unpacker is not None:
        if not pending and offset < end:
            pending = package.read(offset, min(RUN_BYTES, end - offset))
            offset += len(pending)
        if gzipped is None:
            gzipped = pending[:2] == b"\x1f\x8b"
        if not gzipped:
            yield pending
            pending = b""
            continue
        unpacker = unpacker or zlib.decompressobj(31)
        given, piece = len(pending), unpacker.decompress(pending, RUN_BYTES)
        yield piece
        if unpacker.eof:
            pending, unpacker = unpacker.unused_data, None
        else:
            pending = unpacker.unconsumed_tail
            if not given and not piece:
                raise ValueError("the archive ends inside a record")


def _members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The records of a stream of bytes, one held at a time."""
    buffer, size = bytearray(), 0
    for piece in pieces:
        buffer += piece
        while True:
            if not size:
                while buffer[:1] in (b"\r", b"\n"):
                    del buffer[:1]
                if buffer[:5] != b"WARC/"[:len(buffer)]:
                    raise ValueError("not a WARC record")
                head = buffer.find(b"\r\n\r\n")
                if head < 0:
                    break
                size = head + 4 + int(_headers(bytes(buffer[:head]))["content-length"])
            if len(buffer) < size:
                break
            yield bytes(buffer[:size])
            del buffer[:size]
            size = 0
    if buffer:
        raise ValueError("the archive ends inside a record")


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in raw.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode() for k, _, v in pairs if k}


def parse_record(raw: bytes) -> tuple:
    """(record id, type, target, refers to, payload or None, payload bytes, payload digest)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[:int(warc["content-length"])]
    # only HTTP messages have a head before the payload
    http, _, payload = block.partition(b"\r\n\r\n") if warc.get("content-type", "").startswith("application/http") else (b"", b"", block)
    algorithm, _, listed = warc.get("warc-payload-digest", "").partition(":")
    kind = warc["warc-type"]
    if kind == "revisit":
        size, payload, digest = int(_headers(http).get("content-length", 0)), None, listed
    else:
        size, digest = len(payload), payload_digest(payload)
        if algorithm.lower() == "sha1" and digest != listed.upper():
            raise ValueError(f"payload of {warc['warc-record-id']} does not have its digest")
    name = lambda k: warc[k].strip("<>") if k in warc else None
    return name("warc-record-id"), kind, warc.get("warc-target-uri"), name("warc-refers-to"), payload, size, digest


FIELDS = "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string"


def _records(batches: Batches) -> Batches:
    kinds = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    at, package = None, None
    for batch in batches:
        for uri, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if uri != at:
                at, package = uri, RangeZip(uri)
            rows, held = [], 0
            for raw in _members(_unpacked(package, offset, length)):
                rows.append(parse_record(raw))
                held += len(raw)
                if held > 16 * RUN_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)


def read_warc(packages: DataFrame) -> DataFrame:
    """The records of the packages named in column ``package``; revisits have a null payload."""
    spark = packages.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = packages.select("package").repartition(width).mapInArrow(_runs, "package string, offset long, length long")
    return runs.repartition(width).mapInArrow(_records, FIELDS)


# ---- the round trip ----------------------------------------------------------------------------

def archive_pages(df: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html",
                  min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row, read the packages back; one row per record.

    ``id, payload_bytes, payload_digest, record_type, refers_to, url, html``.  Of records with equal
    payloads of at least ``min_bytes`` bytes, that with the smallest id is the response, the others
    revisit it and have a null ``html``; shorter ones are all responses.  A null html is an empty
    payload.  Rows that repeat the smallest id are all responses; null ids revisit unless the whole
    group has none, then all are responses.  An empty table gives no rows; other columns are ignored.
    """
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    same = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha")
            .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("sha", "first"))
    same = stored(same, "warc-copies")
    joined = rows.join(sized_broadcast(same, same.count(), BROADCAST_ROWS), "sha", "left")

    def urn(c: str):
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))

    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    folder = scratch_dir(df.sparkSession, "warc")
    records = joined.select(urn("id").alias("record_id"), "uri", "payload", F.when(revisit, urn("first")).alias("refers_to"))
    manifest = write_warc(records, folder, "record_id", "uri", "payload", "refers_to", package_bytes)
    back = read_warc(manifest)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return back.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type",
                       number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"),
                       F.decode("payload", "UTF-8").alias("html"))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32 of a SHA-1: 40 hex digits are eight groups of five, each 20 bits, four digits
OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
 d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
 t AS (SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
              (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INTEGER, 1) FOR i IN range(32)], '') AS payload_digest,
              min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM t
"""
