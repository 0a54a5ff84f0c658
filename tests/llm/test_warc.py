import hashlib
import io
import random
import zipfile

import pytest

from weft.llm.warc import PackageReader, PackageWriter, decode_record, encode_record, filesystem, read_packages, round_trip, write_packages


def reader(data: bytes, seen=None):
    def read(start, length):
        if seen is not None:
            seen.append(length)
        assert 0 <= start and start + length <= len(data)
        return data[start : start + length]

    return PackageReader(read, len(data))


class Unseekable(io.BytesIO):
    def seekable(self):
        return False

    def seek(self, *_):
        raise OSError

    def tell(self):
        raise OSError


def test_package_round_trip():
    rnd = random.Random(1)
    payloads = [rnd.randbytes(rnd.choice([0, 1, 50, 5000])) + b"\r\n\r\n" for _ in range(300)]
    for file in (io.BytesIO(), Unseekable()):
        writer = PackageWriter(file, member_bytes=100_000)
        for k, p in enumerate(payloads):
            writer.add(k, encode_record(k, f"http://h/{k}%\n", p, hashlib.sha256(p).hexdigest(), None))
        made = writer.close()
        assert made > 3
        data = file.getvalue()
        assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
        for size in (1, 10_000, 1 << 22):
            seen = []
            package = reader(data, seen)
            records = [r for m in range(made) for r in package.records(m, size)]
            assert [r.payload for r in records] == payloads
            assert [r.number("warc-page-id") for r in records] == list(range(300))
            assert records[3].url == "http://h/3%\n"
        assert max(seen) < len(data)


def test_zip64_directory_and_stored_only():
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        for k in range(70_000):
            z.writestr(zipfile.ZipInfo(f"m{k}"), b"ab" if k % 1000 == 0 else b"")
    package = reader(file.getvalue())
    assert len(package.members) == 70_000 and package.bytes_of("m69000") == b"ab"
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    with pytest.raises(ValueError, match="stored"):
        reader(file.getvalue())
    with pytest.raises(ValueError):
        reader(b"nothing")


def test_damage_is_seen():
    import zlib

    raw = zlib.decompress(encode_record(1, None, b"payload", hashlib.sha256(b"other").hexdigest(), None), 31)
    with pytest.raises(ValueError, match="digest"):
        decode_record(raw)
    with pytest.raises(ValueError, match="cut off"):
        decode_record(raw[:-8])


def brute(data):
    first = {}
    for p, h in data:
        if len((h or "").encode()) >= 100 and p is not None:
            first[h] = min(first.get(h, p), p)
    counts = {}
    for _, h in data:
        counts[h] = counts.get(h, 0) + 1
    out = []
    for p, h in data:
        raw = (h or "").encode()
        refers = first.get(h) if counts[h] > 1 and len(raw) >= 100 and first.get(h) != p else None
        out.append((str(p), len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", str(refers)))
    return sorted(out)


def test_round_trip(spark):
    big = 2**60
    data = [(k, f"<p>{k % 20}é</p>" * (k % 20 + 1)) for k in range(200)] + [(1000 + k, "hot " * 50) for k in range(150)]
    data += [(500, None), (501, ""), (502, None), (503, "y" * 300_000), (504, "y" * 300_000), (None, "hot " * 50), (None, "z" * 200), (None, "z" * 200), (1000, "hot " * 50), (big + 1, "hot " * 50), (999, "x" * 99), (998, "x" * 99)]
    pages = spark.createDataFrame([(p, None if p == 3 else f"http://h/{p}", h, 1, "s") for p, h in data], "page_id long, url string, html string, path int, member string")
    rows = round_trip(pages).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in rows) == brute(data)
    assert {r.page_id: r.url for r in rows}[3] is None
    assert round_trip(pages.limit(0)).count() == 0


def test_members_are_shared_files(spark, tmp_path):
    pages = spark.range(400).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(concat('<b>', id), 30) as html")
    members = write_packages(pages, f"file://{tmp_path}", member_bytes=2000)
    paths = {r.path for r in members.collect()}
    fs, _ = filesystem(f"file://{tmp_path}")
    assert members.count() > len(paths) and all(fs.get_file_info(p).size > 0 for p in paths)
    assert read_packages(members, f"file://{tmp_path}").count() == 400
