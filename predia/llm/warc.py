"""WARC records in ZIP packages: written by tasks, read back by range without extraction.

A package holds two stored members: `archive/data.warc.gz`, one gzip member per record, and
`indexes/index.cdx`, one line per record with its place in the first. The reader takes the end
record (and its ZIP64 form), the central directory and the local headers to find the members, then
reads the index and the record ranges only. Packages are opened through pyarrow's filesystems, in
the shared folder.

Defined results: null html is an empty payload; rows repeating a page_id with one payload are each
written in the same role; a null page_id is never the smallest unless all are null; empty input
gives no package and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from predia.llm.files import make_folder, open_fs
from predia.session import cut, scratch_path

PACKAGE_BYTES = 64 << 20
INDEX_ROWS = 4096
DATA, INDEX = b"archive/data.warc.gz", b"indexes/index.cdx"
# Fixed values of the ZIP format: signatures and the limits above which ZIP64 fields are used.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(url: str | None) -> str:
    """A URL that stays on its header line."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A").strip()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    found = uri[len("<urn:page:"):-1]
    return int(found) if found else None


def record(page_id: int | None, url: str, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that keeps the HTTP head (with the payload's length) alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            f"WARC-Refers-To: {record_uri(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers, HTTP head and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def gz(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Package:
    """Writes one ZIP package as records arrive; the index is kept until the end."""

    def __init__(self, path: str, zip64: bool = False):
        self.filesystem, self.path = open_fs(path)
        self.out = self.filesystem.open_output_stream(self.path)
        self.zip64, self.at, self.lines, self.crc = zip64, 0, [], 0
        # Sizes follow in a data descriptor (flag 3), as the member is streamed.
        self._write(struct.pack("<4s5H3I2H", LOCAL, 45, 8, 0, 0, 33, 0, 0, 0, len(DATA), 0) + DATA)
        self.start = self.at

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, page_id: int | None, data: bytes) -> None:
        packed = gz(data)
        self.lines.append(f"{'' if page_id is None else page_id} {self.at - self.start} {len(packed)}")
        self.crc = zlib.crc32(packed, self.crc)
        self._write(packed)

    def close(self) -> None:
        size = self.at - self.start
        wide = self.zip64 or size >= MAX32
        self._write(struct.pack("<4sI2Q" if wide else "<4s3I", b"PK\x07\x08", self.crc, size, size))
        index, at = "\n".join(self.lines).encode(), self.at
        crc = zlib.crc32(index)
        self._write(struct.pack("<4s5H3I2H", LOCAL, 45, 0, 0, 0, 33, crc, len(index), len(index), len(INDEX), 0) + INDEX + index)
        directory = self.at
        for name, flag, crc_, length, place in ((DATA, 8, self.crc, size, 0), (INDEX, 0, crc, len(index), at)):
            big = self.zip64 or length >= MAX32 or place >= MAX32
            extra = struct.pack("<2H3Q", 1, 24, length, length, place) if big else b""
            length, place = (MAX32, MAX32) if big else (length, place)
            self._write(struct.pack("<4s6H3I5H2I", CENTRAL, 45, 45, flag, 0, 0, 33, crc_, length, length,
                                    len(name), len(extra), 0, 0, 0, 0, place) + name + extra)
        length, end = self.at - directory, self.at
        if self.zip64 or directory >= MAX32:
            self._write(struct.pack("<4sQ2H2I4Q", END64, 44, 45, 45, 0, 0, 2, 2, length, directory))
            self._write(struct.pack("<4sIQI", LOCATOR, 0, end, 1))
            self._write(struct.pack("<4s4H2IH", END, 0, 0, MAX16, MAX16, MAX32, MAX32, 0))
        else:
            self._write(struct.pack("<4s4H2IH", END, 0, 0, 2, 2, length, directory, 0))
        self.out.close()


def members(source: pa.NativeFile) -> dict[bytes, tuple[int, int]]:
    """(start, length) of every stored member, from the central directory; ZIP64 where marked."""
    size = source.size()
    tail_at = max(0, size - 22 - MAX16)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, directory = struct.unpack_from("<H2I", tail, end + 10)
    if MAX16 == count or MAX32 in (length, directory):
        mark, _, at, _ = struct.unpack("<4sIQI", source.read_at(20, tail_at + end - 20))
        if mark != LOCATOR:
            raise ValueError("no ZIP64 locator")
        head = source.read_at(56, at)
        if head[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, directory = struct.unpack_from("<3Q", head, 32)
    entries, found, at = source.read_at(length, directory), {}, 0
    for _ in range(count):
        if entries[at:at + 4] != CENTRAL:
            raise ValueError("bad central directory")
        method, = struct.unpack_from("<H", entries, at + 10)
        packed, plain, names, extras, notes = struct.unpack_from("<2I3H", entries, at + 20)
        place, = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + 46:at + 46 + names]
        extra, e = entries[at + 46 + names:at + 46 + names + extras], 0
        while e + 4 <= len(extra):
            kind, long = struct.unpack_from("<2H", extra, e)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{long // 8}Q", extra, e + 4))
                plain = wide.pop(0) if plain == MAX32 else plain
                packed = wide.pop(0) if packed == MAX32 else packed
                place = wide.pop(0) if place == MAX32 else place
            e += 4 + long
        at += 46 + names + extras + notes
        if method == 0:
            local = source.read_at(30, place)
            skip = struct.unpack_from("<2H", local, 26)
            found[name] = (place + 30 + sum(skip), packed)
    return found


def _packages(folder: str, most: int, zip64: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A lost task leaves a package that no manifest row names; names are never used twice.
        package, n, written = None, 0, []
        for batch in batches:
            for page_id, url, html, first in zip(*batch.columns):
                if package is None:
                    path = f"{folder}/{uuid.uuid4().hex}.wacz"
                    package, n = Package(path, zip64), 0
                # One row at a time is taken out of the batch, as pages can be long.
                page_id, payload, first = page_id.as_py(), html.as_py(), first.as_py()
                revisit = first is not None and page_id != first
                package.add(page_id, record(page_id, clean(url.as_py()), payload, digest(payload), first, revisit))
                n += 1
                if package.at >= most:
                    package.close()
                    written.append((path, n))
                    package = None
        if package is not None:
            package.close()
            written.append((path, n))
        yield pa.RecordBatch.from_pydict({
            "path": pa.array([w[0] for w in written], pa.string()), "n": pa.array([w[1] for w in written], pa.int64()),
        })

    return write


def write_packages(pages: DataFrame, folder: str, most: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write `pages` (page_id, url, html) as packages; (path, n) of those that count.

    Equal payloads find their smallest page by SHA-1 in a narrow aggregate; the pages then meet it
    by an equality join, which Spark splits where one payload holds many rows.
    """
    parts = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    keyed = parts.withColumn("sha", F.unhex(F.sha1("html")))
    firsts = keyed.groupBy("sha").agg(F.min("page_id").alias("first"))
    rows = keyed.join(firsts, "sha").select("page_id", "url", "html", "first")
    return cut(rows.mapInArrow(_packages(make_folder(folder), most, zip64), "path string, n long"))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            filesystem, local = open_fs(path)
            with filesystem.open_input_file(local) as source:
                found = members(source)
                (data, _), (start, length) = found[DATA], found[INDEX]
                lines = source.read_at(length, start).split(b"\n") if length else []
            for i in range(0, len(lines), INDEX_ROWS):
                places = [line.split(b" ")[1:] for line in lines[i:i + INDEX_ROWS]]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([path] * len(places)),
                    "start": pa.array([data + int(p[0]) for p in places], pa.int64()),
                    "length": pa.array([int(p[1]) for p in places], pa.int64()),
                })


def index(packages: DataFrame) -> DataFrame:
    """(path, start, length) of every record, from the packages' own directories and indexes."""
    return packages.mapInArrow(_index, "path string, start long, length long")


FIELDS = ("page_id long", "url string", "payload_bytes long", "payload_digest string", "record_type string",
          "refers_to long")
TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    path, source = None, None
    for batch in batches:
        rows = []
        for place in batch.to_pylist():
            if place["path"] != path:
                path = place["path"]
                filesystem, local = open_fs(path)
                source = filesystem.open_input_file(local)
            raw = zlib.decompress(source.read_at(place["length"], place["start"]), 31)
            fields, http, payload = parse_record(raw)
            kind, sha = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and digest(payload) != sha:
                raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
            length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            if kind == "response" and length != len(payload):
                raise ValueError(f"payload of {fields['warc-record-id']} is cut")
            refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
            row = (page_of(fields["warc-record-id"]), fields["warc-target-uri"], length, sha, kind, refers)
            rows.append((*row, payload if kind == "response" else None) if payloads else row)
        names = [f.split(" ")[0] for f in FIELDS] + ["payload"] * payloads
        types = [*TYPES, pa.binary()]
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in zip(names, columns, types)})


def read_records(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the packages; payloads of responses are checked against their digest.

    Index lines are dealt out anew in the order of their places, to as many tasks as there are
    packages; the lines are short against what they stand for, so their size says nothing.
    """
    n = max(packages.count(), 1)
    places = index(packages).repartitionByRange(n, "path", "start").sortWithinPartitions("path", "start")
    schema = ", ".join([*FIELDS, "payload binary"] if payloads else FIELDS)
    return places.mapInArrow(lambda batches: _read(batches, payloads), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as packages in the shared folder and read every record back."""
    folder = scratch_path(pages.sparkSession, "wacz")
    return read_records(write_packages(pages, folder), payloads=False).drop("url")
