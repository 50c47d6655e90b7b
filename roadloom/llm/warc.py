"""WARC records in ZIP-packaged archives, and a reader that needs no extraction.

An archive is a ZIP file of stored members: ``archive/data.warc.gz``, a gzip member for each record, and ``indexes/index.cdx``, a line
for each record with its offset and length. The reader finds the central directory from the end of the file (ZIP64 end record and
locator, 64-bit extra fields, bytes before the first member), locates the stored members through their local headers, and reads
only the index and the ranges of the records; neighbouring ranges are read together, up to READ_BYTES.

Archives lie in the shared folder, written and read through Arrow's file systems, so any store that those know serves. A task
that is tried again writes archives of other names, and only archives that finished tasks list are read.

Payloads of REVISIT_BYTES or more that are equal are written once: the response is the record of the smallest page_id, the others
are revisits that refer to it and keep its HTTP header with the full length. Rows: null html is an empty payload; a null page_id
is kept, and is a response only where no equal payload has an id; rows that repeat the response's page_id are responses, too.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import urllib.parse
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import lean, new_path, partitions, stored

REVISIT_BYTES = 100
#: Payload bytes after which a task begins its next archive.
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 4 << 20
#: Repeated payloads whose response ids may be sent to all executors (some 100 MB); beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Fixed signatures of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri)


@dataclass
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int


class ZipReader:
    """Members of a ZIP file by ranges of a random-access file (read_at(size, offset), size())."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.members = {m.name: m for m in self._central()}

    def _read(self, at: int, size: int) -> bytes:
        data = self.file.read_at(size, at)
        if len(data) < size:
            raise ValueError(f"ZIP file ends at {self.size}, wanted {size} bytes at {at}")
        return data

    def _end(self) -> tuple[int, int, int, int]:
        """(place of the end record, entries, size and offset of the central directory)."""
        tail = min(self.size, 22 + FULL16)
        data = self._read(self.size - tail, tail)
        at = len(data) - 22
        while at >= 0:
            if data[at : at + 4] == struct.pack("<I", END) and struct.unpack_from("<H", data, at + 20)[0] == len(data) - at - 22:
                break
            at -= 1
        else:
            raise ValueError("no end record: not a ZIP file")
        place = self.size - tail + at
        entries, size, offset = struct.unpack_from("<HII", data, at + 10)
        if FULL16 == entries or FULL32 in (size, offset):
            if place < 20:
                raise ValueError("no room for a ZIP64 locator")
            signature, _, end64, _ = struct.unpack("<IIQI", self._read(place - 20, 20))
            if signature != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            for candidate in (end64, place - 20 - 56):  # the second: bytes were put before the archive
                record = self._read(candidate, 56)
                if struct.unpack_from("<I", record)[0] == END64:
                    entries, size, offset = struct.unpack_from("<QQQ", record, 32)
                    return candidate, entries, size, offset
            raise ValueError("no ZIP64 end record")
        return place, entries, size, offset

    def _central(self) -> Iterator[Member]:
        place, entries, size, offset = self._end()
        start = place - size
        self.shift = start - offset  # bytes before the archive
        data, at = self._read(start, size), 0
        for _ in range(entries):
            fields = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
            if fields[0] != CENTRAL:
                raise ValueError(f"no central header at {start + at}")
            method, packed, full, names, extras, comments, header = fields[4], fields[8], fields[9], fields[10], fields[11], fields[12], fields[16]
            name = data[at + 46 : at + 46 + names].decode("utf-8" if fields[3] & 0x800 else "cp437")
            extra = data[at + 46 + names : at + 46 + names + extras]
            x = 0
            while x + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, x)
                if kind == 1:  # 64-bit values, only of the fields that are full, in this order
                    y = x + 4
                    wide = []
                    for value in (full, packed, header):
                        if value == FULL32:
                            value = struct.unpack_from("<Q", extra, y)[0]
                            y += 8
                        wide.append(value)
                    full, packed, header = wide
                x += 4 + length
            yield Member(name, method, packed, full, header + self.shift)
            at += 46 + names + extras + comments

    def stored_at(self, name: str) -> tuple[int, int]:
        """(place, size) of a stored member's bytes."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; its records can't be read by range")
        head = self._read(member.header, 30)
        if struct.unpack_from("<I", head)[0] != LOCAL:
            raise ValueError(f"no local header of {name}")
        names, extras = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + names + extras, member.size

    def read(self, name: str) -> bytes:
        return self._read(*self.stored_at(name))

    def ranges(self, name: str, spans: list[tuple[int, int]]) -> Iterator[bytes]:
        """Bytes of (offset, length) spans of a stored member; neighbours come from one read."""
        place, size = self.stored_at(name)
        i = 0
        while i < len(spans):
            j, begin, stop = i, spans[i][0], sum(spans[i])
            while j + 1 < len(spans) and spans[j + 1][0] == stop and stop - begin < READ_BYTES:
                j += 1
                stop = sum(spans[j])
            if stop > size:
                raise ValueError(f"a record ends at {stop}, {name} at {size}")
            block = self._read(place + begin, stop - begin)
            for offset, length in spans[i : j + 1]:
                yield block[offset - begin : offset - begin + length]
            i = j + 1


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit (refers_to) has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=';/?:@&=+$,#%~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    out = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(out, compresslevel=1, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one gzipped record."""
    data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def archive(records: list[bytes]) -> bytes:
    """A ZIP file of the records and their index."""
    offset, lines = 0, []
    for i, r in enumerate(records):
        lines.append(f"{i} {offset} {len(r)}\n")
        offset += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, parts in ((DATA, records), (INDEX, [x.encode() for x in lines])):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                for p in parts:
                    f.write(p)
    return out.getvalue()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        held, size, number = [], 0, 0
        attempt = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"

        def close():
            name = f"{folder}/{attempt}-{number}.wacz"
            with fs.open_output_stream(file_system(name)[1]) as f:
                f.write(archive(held))
            return pa.record_batch({"path": pa.array([name]), "n_records": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "raw", "digest", "refers_to")), strict=True):
                held.append(record(*row))
                size += len(row[2])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return run


def records_of(reader: ZipReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of all records that the archive's index lists."""
    spans = [tuple(map(int, line.split()[1:3])) for line in reader.read(INDEX).decode().splitlines()]
    for data in reader.ranges(DATA, spans):
        yield parse(data)


def _id(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return int(value) if value else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column("path").to_pylist():
            fs, path = file_system(name)
            rows = []
            with fs.open_input_file(path) as f:
                for headers, block in records_of(ZipReader(f)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).partition(":")[2])
                    revisit = headers["warc-type"] == "revisit"
                    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{headers['warc-record-id']} in {name}: its payload isn't the one written")
                    uri = headers.get("warc-target-uri")
                    rows.append((_id(headers["warc-record-id"]), urllib.parse.unquote(uri) if uri is not None else None, size, digest, headers["warc-type"], _id(headers["warc-refers-to"]) if revisit else None, None if revisit else payload))
            for i in range(0, len(rows), 1000):
                yield pa.record_batch(dict(zip(("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"), (pa.array(c, t) for c, t in zip(zip(*rows[i : i + 1000], strict=True), _TYPES, strict=True)), strict=True)))


_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages(page_id, url, html) to archives in a folder; (path, n_records) of each."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("raw"))
    base = base.withColumn("digest", F.sha2("raw", 256))
    long_ = base.where(F.length("raw") >= REVISIT_BYTES)
    leads = stored(long_.groupBy("digest").agg(F.min("page_id").alias("lead"), F.count("*").alias("c")).where("c > 1 and lead is not null").select("digest", "lead"), "leads")
    lead = F.broadcast(leads) if leads.count() <= BROADCAST_ROWS else leads
    named = base.join(lead, "digest", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("lead")), None).otherwise(F.col("lead"))
    rows = named.select("page_id", "url", "raw", "digest", refers.alias("refers_to"))
    return stored(rows.mapInArrow(lean(_write(folder)), "path string, n_records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records of archives (path)."""
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return manifest.select("path").repartition(partitions(manifest.sparkSession), "path").mapInArrow(lean(_read), kind)


def round_trip(pages: DataFrame) -> DataFrame:
    """Records of pages, written to archives in the shared folder and read back."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc")))


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(raw) AS BIGINT) AS payload_bytes, sha256(raw) AS payload_digest FROM p
), l AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND lead < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND lead < page_id THEN lead END AS refers_to
FROM l
"""
