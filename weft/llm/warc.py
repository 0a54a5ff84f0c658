"""WARC records in ZIP packages: written by each task, read back by ranges without extraction.

A package is a ZIP file of stored (uncompressed) members: ``archive/data-NNNNN.warc.gz``, in which every record is a gzip
member of its own, and ``indexes/data-NNNNN.cdx`` with an offset, a length and a page id a record. The reader fetches the file's tail,
parses the end record, the ZIP64 locator and end record where they are, and the central directory (with ZIP64 extra
fields), finds a member's data behind its local header, and then reads runs of records by byte range.

Equal payloads of at least ``MIN_REVISIT`` bytes are written once, by the page with the smallest id; the other pages
write a revisit record, whose HTTP header still gives the full payload's length and whose digest is the full payload's. A null
html is an empty payload. Rows that repeat the smallest page_id with the same payload are all responses; a
null page_id never is referred to. An empty table writes no package.

Packages go to the shared folder under names of their own for every task attempt; the checkpointed list of them
names only those of attempts that succeeded, so retries and lost executors leave no half-written package in use.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, salted_join

MIN_REVISIT = 100
#: A package's WARC member is closed beyond this many bytes, and the next one begun.
MEMBER_BYTES = 64 << 20
#: Tasks that read packages.
MOST_TASKS = 20_000
#: Records next to each other are read in one range of at most about this size.
RANGE_BYTES = 4 << 20
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def filesystem(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


# Records


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. With ``refers_to``, a revisit of that page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m.group()):02X}", url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def url(self) -> str | None:
        found = self.headers.get("warc-target-uri")
        return None if found is None else re.sub(r"%([0-1][0-9A-F]|7F|25)", lambda m: chr(int(m.group(1), 16)), found)

    def number(self, name: str) -> int | None:
        return int(self.headers[name]) if name in self.headers else None


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def decode_record(raw: bytes) -> Record:
    """Parse one uncompressed record; the digest of a response's payload is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = _fields(lines[1:])
    length = int(headers["content-length"])
    block = rest[:length]
    if len(block) < length:
        raise ValueError("a WARC record is cut off")
    http_head, _, payload = block.partition(b"\r\n\r\n")
    record = Record(headers, _fields(http_head.decode().split("\r\n")[1:]), payload)
    if record.kind == "response" and headers["warc-payload-digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise ValueError("a WARC payload doesn't fit its digest")
    return record


# ZIP packages


class PackageWriter:
    """Streams records into the members of one ZIP package."""

    def __init__(self, file, member_bytes: int = MEMBER_BYTES):
        self.zip = zipfile.ZipFile(file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member_bytes, self.member, self.index, self.at, self.made = member_bytes, None, [], 0, 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.member is None:
            self.member = self.zip.open(zipfile.ZipInfo(f"archive/data-{self.made:05d}.warc.gz"), "w", force_zip64=True)
        self.member.write(record)
        self.index.append(f"{self.at} {len(record)} {'-' if page_id is None else page_id}\n")
        self.at += len(record)
        if self.at >= self.member_bytes:
            self._end()

    def _end(self) -> None:
        if self.member is not None:
            self.member.close()
            self.zip.writestr(zipfile.ZipInfo(f"indexes/data-{self.made:05d}.cdx"), "".join(self.index))
            self.member, self.index, self.at, self.made = None, [], 0, self.made + 1

    def close(self) -> int:
        self._end()
        self.zip.close()
        return self.made


@dataclass(frozen=True)
class Member:
    name: str
    size: int
    header_at: int


class PackageReader:
    """Members of a ZIP package by byte ranges. ``read_range(start, length)`` fetches bytes of the file."""

    def __init__(self, read_range, size: int):
        self.read = read_range
        self.members = {m.name: m for m in self._directory(size)}

    def _directory(self, size: int) -> list[Member]:
        tail_at = max(0, size - 65_557)
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("no end of a central directory")
        entries, length, start = struct.unpack_from("<HII", tail, at + 10)
        if (entries, length, start) != (0, 0, 0) and (entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
            locator_at = tail_at + at - 20
            locator = self.read(locator_at, 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            end64_at = struct.unpack_from("<Q", locator, 8)[0]
            end64 = self.read(end64_at, 56)
            if end64[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
            entries, length, start = struct.unpack_from("<QQQ", end64, 32)
        directory, at, found = self.read(start, length), 0, []
        for _ in range(entries):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("a broken central directory")
            method, packed, full, n, m, k, header_at = (struct.unpack_from(f, directory, at + o)[0] for f, o in (("<H", 10), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
            name = directory[at + 46 : at + 46 + n].decode()
            extra, x = directory[at + 46 + n : at + 46 + n + m], 0
            while x + 4 <= len(extra):
                tag, width = struct.unpack_from("<HH", extra, x)
                if tag == 1:
                    # In this order, and only those that don't fit into 32 bits.
                    values = iter(struct.unpack_from(f"<{width // 8}Q", extra, x + 4))
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    header_at = next(values) if header_at == 0xFFFFFFFF else header_at
                x += 4 + width
            if method != 0:
                raise ValueError(f"{name} isn't stored")
            found.append(Member(name, packed, header_at))
            at += 46 + n + m + k
        return found

    def data_at(self, member: Member) -> int:
        header = self.read(member.header_at, 30)
        if header[:4] != b"PK\3\4":
            raise ValueError("a broken local header")
        n, m = struct.unpack_from("<HH", header, 26)
        return member.header_at + 30 + n + m

    def bytes_of(self, name: str) -> bytes:
        m = self.members[name]
        return self.read(self.data_at(m), m.size)

    def index(self, number: int) -> list[tuple[int, int]]:
        """Offset and length of each record of a WARC member."""
        lines = self.bytes_of(f"indexes/data-{number:05d}.cdx").decode().split("\n")[:-1]
        return [(int(a), int(b)) for a, b, _ in (x.split(" ") for x in lines)]

    def records(self, number: int, range_bytes: int = RANGE_BYTES):
        """All records of a WARC member, read in runs."""
        base, run = self.data_at(self.members[f"archive/data-{number:05d}.warc.gz"]), []
        for entry in [*self.index(number), None]:
            if run and (entry is None or entry[0] != run[-1][0] + run[-1][1] or entry[0] + entry[1] - run[0][0] > range_bytes):
                data = self.read(base + run[0][0], run[-1][0] + run[-1][1] - run[0][0])
                for at, length in run:
                    yield decode_record(zlib.decompress(data[at - run[0][0] : at - run[0][0] + length], 31))
                run = []
            if entry is not None:
                run.append(entry)


# Distributed writing and reading


def revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Pages that revisit another: __id, __sha and the page that they refer to (``__first``)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    keyed = pages.where(F.octet_length(html) >= min_bytes).select(F.col(id_col).alias("__id"), F.sha2(html, 256).alias("__sha"))
    first = keyed.groupBy("__sha").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and __first is not null").drop("__n")
    later = salted_join(keyed, first, ["__sha"], F.col("__id"))
    return later.where(F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first"))).select("__id", "__sha", "__first").distinct()


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """Write every row as a record; returns a row a WARC member: path and member number."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("__page"), F.col(id_col).cast("string").alias("__number"), F.col(url_col).cast("string").alias("__url"), html.alias("__html"), F.sha2(html, 256).alias("__digest"))
    back = revisits(pages, id_col, html_col).hint("shuffle_hash")
    rows = rows.join(back, rows["__page"].eqNullSafe(back["__id"]) & (rows["__digest"] == back["__sha"]), "left")
    # Numbers go as text, since pandas would turn a column with nulls into floats.
    rows = rows.select("__number", "__url", "__html", "__digest", F.col("__first").cast("string"))

    def run(batches):
        task = TaskContext.get()
        fs, base = filesystem(folder)
        path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.wacz"
        stream = writer = None
        for b in batches:
            for page, url, text, digest, first in zip(*(b[c] for c in ("__number", "__url", "__html", "__digest", "__first")), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    stream = fs.open_output_stream(path)
                    writer = PackageWriter(stream, member_bytes)
                page, first = (None if x is None else int(x) for x in (page, first))
                writer.add(page, encode_record(page, url, text.encode(), digest, first))
        if writer is not None:
            made = writer.close()
            stream.close()
            yield pd.DataFrame({"path": path, "member": range(made)})

    return cut(rows.mapInPandas(run, "path string, member int"))


def read_packages(members: DataFrame, folder: str) -> DataFrame:
    """One row a record of the given WARC members (``READ``)."""

    def run(batches):
        fs, _ = filesystem(folder)
        for b in batches:
            for path, member in zip(b["path"], b["member"], strict=True):
                with fs.open_input_file(path) as file:

                    def read_range(start: int, length: int, file=file) -> bytes:
                        file.seek(start)
                        return file.read(length)

                    rows = []
                    for r in PackageReader(read_range, file.size()).records(int(member)):
                        rows.append((r.number("warc-page-id"), int(r.http["content-length"]), r.headers["warc-payload-digest"].removeprefix("sha256:"), r.kind, r.number("warc-refers-to-page-id"), r.url))
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    # As many tasks as members, which Spark would take for a small table and give to one task; of very many, several a task.
    return members.repartition(max(1, min(members.count(), MOST_TASKS))).mapInPandas(run, READ)


def _frame(rows: list) -> pd.DataFrame:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = ("Int64", "int64", "object", "object", "Int64", "object")
    return pd.DataFrame({c.split()[0]: pd.array(list(v), dtype=k) for c, v, k in zip(READ.split(", "), columns, kinds, strict=True)})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write packages to the shared folder, then read all their records back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder), folder)
