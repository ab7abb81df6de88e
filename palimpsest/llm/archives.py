"""Web archives in ZIP packages: written by Spark tasks, read back by range.

A package holds a stored (not compressed) member with one gzip member per WARC
record and a stored index of them. The reader parses the end record, its ZIP64
form and the central directory, finds where stored members begin, reads the
index, and fetches records by byte range; nothing is extracted.

Files are reached through ``pyarrow.fs`` by the URI of the session's shared
folder, so they are on no executor's own disk.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import shared_folder, stage

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Payloads below this many bytes are always written in full.
LEAST = 1000
# A task begins a new package beyond so many bytes, and reads so much at once.
PACKAGE_BYTES, READ_BYTES = 256 << 20, 4 << 20

# Fixed values of the ZIP format.
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    compressed: int
    size: int
    header: int  # where the local header begins


def _range(file, at: int, n: int) -> bytes:
    file.seek(at)
    data = file.read(n)
    if len(data) != n:
        raise ValueError(f"the package ends within {n} bytes at {at}")
    return data


def directory(file, size: int) -> list[Member]:
    """Members by the central directory, ZIP64 fields resolved.

    Raises ``ValueError`` where there is no end record or a record is damaged.
    """
    tail_at = max(0, size - 22 - _FULL16)
    tail = _range(file, tail_at, size - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, begin = struct.unpack("<HII", tail[at + 10 : at + 20])
    if count == _FULL16 or length == _FULL32 or begin == _FULL32:
        locator = _range(file, tail_at + at - 20, 20)
        if locator[:4] != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        end64 = _range(file, struct.unpack("<Q", locator[8:16])[0], 56)
        if end64[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, begin = struct.unpack("<QQQ", end64[32:56])
    data, members, at = _range(file, begin, length), [], 0
    for _ in range(count):
        if data[at : at + 4] != _ENTRY:
            raise ValueError("damaged central directory")
        method = struct.unpack("<H", data[at + 10 : at + 12])[0]
        small, large, n, extra, note = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        header = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name = data[at + 46 : at + 46 + n].decode("utf-8", "replace")
        more, wide = data[at + 46 + n : at + 46 + n + extra], b""
        while len(more) >= 4:
            kind, k = struct.unpack("<HH", more[:4])
            wide = more[4 : 4 + k] if kind == 1 else wide
            more = more[4 + k :]
        # The wide fields stand only where the narrow one is full, in this order.
        fields = []
        for value in (large, small, header):
            if value == _FULL32:
                value, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
            fields.append(value)
        members.append(Member(name, method, fields[1], fields[0], fields[2]))
        at += 46 + n + extra + note
    return members


def stored_range(file, member: Member) -> tuple[int, int]:
    """First byte and length of a stored member's data."""
    if member.method:
        raise ValueError(f"{member.name} is not stored")
    local = _range(file, member.header, 30)
    if local[:4] != _LOCAL:
        raise ValueError("damaged local header")
    n, extra = struct.unpack("<HH", local[26:30])
    return member.header + 30 + n + extra, member.size


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, gzipped: a response, or a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    plain = "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return squeeze.compress(plain) + squeeze.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and body of a gzipped record."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")

    def fields(part: bytes) -> dict[str, str]:
        pairs = (x.partition(":") for x in part.decode("utf-8", "replace").split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, _, v in pairs}

    warc = fields(head)
    http, _, body = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), body


def _named(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


class _Package:
    """A package under way: records as they come, then the index, then the directory."""

    def __init__(self, store: fs.FileSystem, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        self.out = store.open_output_stream(self.path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, page: int | None, data: bytes) -> None:
        self.member.write(data)
        self.index.append(json.dumps({"page": page, "offset": self.at, "length": len(data)}))
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.path, size, len(self.index)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for each row; ``(path, size, records)`` of each package.

    Of equal payloads of at least ``LEAST`` bytes, the row with the largest key
    is the response and the others revisit it. A null payload is empty; a null
    key has no number. The table lists only what finished tasks wrote, so a
    task that runs again leaves a file that nobody reads.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    full = rows.where(F.octet_length("payload") >= LEAST)
    owners = full.groupBy(F.col("digest").alias("_digest")).agg(
        F.max("page").alias("owner"), F.count(F.lit(1)).alias("n")
    )
    # Most payloads are there once; the others' owners are a short table.
    owners = stage(owners.where((F.col("n") > 1) & F.col("owner").isNotNull()).drop("n"), "owners")
    large = F.when(F.octet_length("payload") >= LEAST, F.col("digest"))
    met = rows.join(owners, large == F.col("_digest"), "left")
    other = F.col("page").isNull() | (F.col("page") != F.col("owner"))
    met = met.select("page", "url", "payload", "digest", F.when(other, F.col("owner")).alias("owner"))
    store, _ = fs.FileSystem.from_uri(folder)
    store.create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        package, done = None, []
        for batch in batches:
            for page, link, body, digest, owner in zip(*(c for c in batch.columns)):
                package = package or _Package(store, path)
                data = record_bytes(page.as_py(), link.as_py(), body.as_py(), digest.as_py(), owner.as_py())
                package.add(page.as_py(), data)
                if package.at >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        columns = zip(*done) if done else ([], [], [])
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["path", "size", "records"])

    return stage(met.mapInArrow(write, "path string, size long, records long"), "packages")


def _spans(index: bytes, start: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Neighbouring records, as much as is read at once: first byte, length, records."""
    group: list[tuple[int, int]] = []
    for line in index.split(b"\n") if index else []:
        entry = json.loads(line)
        at, n = start + entry["offset"], entry["length"]
        if group and (at != sum(group[-1]) or at + n - group[0][0] > READ_BYTES):
            yield group[0][0], sum(group[-1]) - group[0][0], group
            group = []
        group.append((at, n))
    if group:
        yield group[0][0], sum(group[-1]) - group[0][0], group


def read_archives(packages: DataFrame, folder: str, key: str = "page_id", payloads: bool = False) -> DataFrame:
    """Records of packages: ``(key, payload_bytes, payload_digest, record_type, refers_to)``.

    A response's numbers are those of its payload as read, and have to agree
    with its headers; a revisit's are those its headers give. ``payloads`` adds
    the payload, null for revisits.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if payloads else []))
        names = ["page", "bytes", "digest", "type", "refers", *(["payload"] if payloads else [])]
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as file:
                    members = {m.name: m for m in directory(file, size)}
                    start, _ = stored_range(file, members[RECORDS])
                    index = _range(file, *stored_range(file, members[INDEX]))
                    for first, n, group in _spans(index, start):
                        data, rows = _range(file, first, n), []
                        for at, k in group:
                            warc, http, body = parse_record(data[at - first : at - first + k])
                            digest, length = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                            if warc["warc-type"] == "response" and (sha1(body).hexdigest(), len(body)) != (digest, length):
                                raise ValueError(f"{path}: payload of {warc['warc-record-id']} is damaged")
                            refers = _named(warc.get("warc-refers-to"))
                            row = (_named(warc["warc-record-id"]), length, digest, warc["warc-type"], refers)
                            rows.append(row + ((body if warc["warc-type"] == "response" else None,) if payloads else ()))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "page long, bytes long, digest string, type string, refers long" + (", payload binary" if payloads else "")
    # A task for each package: they are of bounded size.
    rows = packages.select("path", "size").repartition("path").mapInArrow(read, schema)
    return rows.select(
        F.col("page").alias(key),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").alias("refers_to"),
        *(["payload"] if payloads else []),
    )


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to packages in the shared folder and read every record back."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, key, url, html), folder, key)
