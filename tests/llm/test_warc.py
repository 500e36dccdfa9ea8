"""Archives against the pages they were made of, and against packages made by the standard library."""

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile

import pytest

from pagemill.llm import warc, zip_ranges

SCHEMA = "page_id long, url string, html string"


def _digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _brute(pages):
    top = {}
    for page_id, _, html in pages:
        if page_id is not None:
            top[html or ""] = max(top.get(html or "", page_id), page_id)
    rows = []
    for page_id, _, html in pages:
        body, first = (html or "").encode(), top.get(html or "")
        own = first is None or page_id == first
        rows.append((page_id, len(body), _digest(body), "response" if own else "revisit", None if own else first))
    return sorted(rows, key=repr)


def _read(made):
    return sorted((tuple(r) for r in made.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def _folder(tmp_path, name="packages"):
    return str(tmp_path / name)


def test_round_trip(spark, tmp_path):
    pages = [(i, f"http://h/{i}", f"<p>{i % 7} é\r\n\r\nWARC/1.1\n</p>" * (i % 5)) for i in range(200)]
    pages += [(1000 + i, "http://h/same", "common") for i in range(300)]
    made = warc.archived_pages(spark.createDataFrame(pages, SCHEMA).repartition(7), path=_folder(tmp_path))
    assert _read(made) == _brute(pages)


def test_payloads_come_back_whole(spark, tmp_path):
    pages = [(1, "http://h/a b\n", "x" * 9_000_000), (2, None, None), (3, "", "\n"), (4, "http://é/", "ü\x00\x1f")]
    df = spark.createDataFrame(pages, SCHEMA)
    warc.write_archives(warc.with_referred(df), _folder(tmp_path))
    rows = {int(r["page_id"]): r for r in warc.read_records(spark, _folder(tmp_path)).filter("page_id IS NOT NULL").collect()}
    assert {i: bytes(r["payload"]) for i, r in rows.items()} == {i: (html or "").encode() for i, _, html in pages}
    assert rows[1]["target_uri"] == "http://h/a%20b%0A" and rows[2]["target_uri"].startswith("urn:uuid:")


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    pages = [(None, "u", "a"), (None, "u", "a"), (5, "u", "b"), (None, "u", "b"), (7, "u", "c"), (7, "u", "c"), (6, None, "c"), (8, "", None), (9, "", "")]
    assert _read(warc.archived_pages(spark.createDataFrame(pages, SCHEMA), path=_folder(tmp_path))) == _brute(pages)


def test_empty_table(spark, tmp_path):
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA), path=_folder(tmp_path)).count() == 0


def test_other_columns(spark, tmp_path):
    pages = [(i, "u", str(i % 3)) for i in range(9)]
    extra = spark.createDataFrame(pages, SCHEMA).selectExpr("*", "1 AS id", "2 AS body", "3 AS key", "4 AS refers_to", "5 AS row", "6 AS path")
    assert _read(warc.archived_pages(extra, path=_folder(tmp_path))) == _brute(pages)


def test_small_payloads_are_stored_each_time(spark):
    pages = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    rows = warc.with_referred(spark.createDataFrame(pages, SCHEMA), smallest=5).collect()
    assert {r["id"]: r["refers_to"] for r in rows} == {1: None, 2: None, 3: 4, 4: None}


def test_packages_are_zip_files_with_indexes(spark, tmp_path):
    pages = [(i, f"http://h/{i}", "text " * 50) for i in range(400)]
    warc.write_archives(warc.with_referred(spark.createDataFrame(pages, SCHEMA).coalesce(2)), _folder(tmp_path), member_bytes=20_000)
    seen = 0
    for path in (tmp_path / "packages").glob("part-*"):
        with zipfile.ZipFile(path) as package:
            names = package.namelist()
            assert package.testzip() is None and len(names) > 4
            for name in names:
                if name.startswith("indexes/"):
                    data = package.read(name.replace("indexes/", "archive/").replace(".cdxj", ".warc"))
                    for line in package.read(name).decode().splitlines():
                        place = json.loads(line.split(" ", 2)[2])
                        assert data[place["offset"]:place["offset"] + place["length"]].startswith(b"WARC/1.1\r\nWARC-Type: re")
                        seen += 1
    assert seen == 400


def _record(page_id, payload):
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: response\r\nwarc-payload-digest: sha1:{_digest(payload)}\r\nContent-Type: application/http;\r\n msgtype=response\r\nPage-Id: {page_id}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _foreign(path, compressed, indexed, method=zipfile.ZIP_STORED, comment=b"", zip64=False):
    payloads = [bytes([i]) * (i * 3000) for i in range(40)]
    data, lines = b"", ["!meta {}"]
    for i, payload in enumerate(payloads):
        record = _record(i, payload)
        record = gzip.compress(record) if compressed else record
        lines.append(f'com,h)/{i} 20240101 {json.dumps({"filename": "data.warc.gz", "offset": str(len(data)), "length": str(len(record))})}')
        data += record
    with zipfile.ZipFile(path, "w") as package:
        package.writestr("datapackage.json", b"{}" * 500, zipfile.ZIP_DEFLATED)
        with package.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=zip64) as member:
            member.write(data)
        if method:
            package.writestr("archive/more.warc", data, method)
        if indexed:
            package.writestr("indexes/index.cdxj", "\n".join(lines))
        package.comment = comment
    return payloads


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("indexed", [False, True])
def test_packages_of_others(spark, tmp_path, compressed, indexed):
    payloads = _foreign(tmp_path / "a.wacz", compressed, indexed, comment=b"PK\x05\x06" + b"x" * 300, zip64=indexed)
    rows = warc.read_records(spark, str(tmp_path)).collect()
    assert {int(r["page_id"]): bytes(r["payload"]) for r in rows} == dict(enumerate(payloads))


def test_directory_is_that_of_the_library(tmp_path):
    _foreign(tmp_path / "a.zip", False, True, zip64=True)
    read_at, size = zip_ranges.opened(str(tmp_path / "a.zip"))
    with zipfile.ZipFile(tmp_path / "a.zip") as package:
        expected = package.infolist()
        listed = list(zip_ranges.members(read_at, size))
        assert [(m.name, m.size, m.crc) for m in listed] == [(i.filename, i.file_size, i.CRC) for i in expected]
        for member, info in zip(listed, expected):
            assert (member.start < 0) == (info.compress_type != 0)
            if member.start >= 0:
                assert read_at(member.start, member.size) == package.read(info)


def test_zip64_offsets_beyond_four_gigabytes():
    """A directory that lies 5 GB into a sparse file."""
    far = 5 << 30
    entry_extra = struct.pack("<HHQQQ", 1, 24, 7, 7, far)
    local = struct.pack("<IHHHHHIIIHH", zip_ranges.LOCAL, 45, 0, 0, 0, 0, 0, 7, 7, 1, 0) + b"a" + b"content"
    entry = struct.pack("<IHHHHHHIIIHHHHHII", zip_ranges.CENTRAL, 45, 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, 1, len(entry_extra), 0, 0, 0, 0, 2**32 - 1) + b"a" + entry_extra
    start = far + len(local)
    end = struct.pack("<IQHHIIQQQQ", zip_ranges.END64, 44, 45, 45, 0, 0, 1, 1, len(entry), start) + struct.pack("<IIQI", zip_ranges.LOCATOR64, 0, start + len(entry), 1)
    end += struct.pack("<IHHHHIIH", zip_ranges.END, 0, 0, 1, 1, 2**32 - 1, 2**32 - 1, 0)
    data = local + entry + end

    def read_at(offset, length):
        assert offset >= far
        return data[offset - far:offset - far + length]

    tail = zip_ranges._MOST_COMMENT + 22 - len(data)
    found = list(zip_ranges.members(lambda o, n: read_at(o, n) if o >= far else bytes(far - o) + data, far + len(data)))
    assert tail > 0 and [(m.name, m.start, m.size) for m in found] == [("a", far + 31, 7)]


def test_damage_is_an_error(spark, tmp_path):
    _foreign(tmp_path / "a.wacz", False, False, method=zipfile.ZIP_DEFLATED)
    with pytest.raises(Exception, match="compressed or encrypted"):
        warc.read_records(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="no ZIP package"):
        list(zip_ranges.members(lambda o, n: io.BytesIO(b"x" * 99).read(n), 99))
    with pytest.raises(ValueError, match="does not have its digest"):
        warc._payload(*warc._split(_record(1, b"right").replace(b"\r\n\r\nright", b"\r\n\r\nwrong")))
