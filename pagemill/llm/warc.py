"""WARC archives in ZIP packages: written by Spark, read back by ranges.

Each task writes one package, with the records of its pages in stored members
of bounded size (``archive/``), each followed by its index (``indexes/``).  A
payload that several pages share is stored once: the page with the largest id
has a response record, the others revisit it.

The reader goes from a package's directory to its members and indexes, and
from the indexes to single records, which any task can fetch by offset and
length.  Nothing is extracted, and no package is read whole.  Packages made by
others are read as well: with records that are compressed one by one, with or
without indexes, as long as the members themselves are stored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import BLOCK_BYTES, total
from pagemill.llm.zip_ranges import Member, PackageWriter, ReadAt, members, opened
from pagemill.session import work_folder, written

MEMBER_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pagemill:warc-record")
# Ranges up to this far apart are fetched by one read.
_GAP = 64 << 10
_HEAD = 16 << 10

RECORDS = "path string, offset long, length long, record_id string, record_type string, target_uri string, date string, page_id string, refers_to string, payload binary, payload_bytes long, payload_digest string"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing ---------------------------------------------------------------


def with_referred(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", smallest: int = 0) -> DataFrame:
    """``id, url, body`` of each page and ``refers_to``, the id of the page whose payload it shares, null where it has its own.

    Payloads are equal when their length and SHA-256 are.  Ids are compared as
    numbers or texts, as they are; a null id is smaller than any other.  Rows
    that share the largest id of their payload, repeated ones among them, and
    rows of a payload that has null ids only, all keep their payload.
    """
    body = F.coalesce(F.col(f"`{body_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("key"),
    )
    shared = (
        rows.filter(F.octet_length("body") >= smallest).groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).filter("n > 1 AND top IS NOT NULL").select("key", "top")
    )
    # Written, so that Spark knows its size when it chooses how to join.
    met = rows.join(written(shared, "warc-shared"), "key", "left")
    return met.select("id", "url", "body", F.when(F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def _uri(url: str) -> str:
    """A URL without characters that a header or an index line cannot hold."""
    return quote(url, safe="".join(map(chr, range(0x21, 0x7F))))


def _record_id(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, json.dumps(parts))}>"


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields if value is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_record(page_id: str | None, url: str | None, body: bytes, refers_to: str | None, date: str) -> tuple[bytes, str, str]:
    """The record of a page, its URI and its digest."""
    digest = payload_digest(body)
    kind = "response" if refers_to is None else "revisit"
    own = _record_id(page_id, digest) if refers_to is None else _record_id(page_id, digest, refers_to, url)
    uri = _uri(url) if url else own[1:-1]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Target-URI", uri), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("Page-Id", None if page_id is None else quote(page_id, safe="")),
    ]
    if refers_to is None:
        return _record(fields, head + body), uri, digest
    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("Refers-To-Page-Id", quote(refers_to, safe=""))]
    return _record(fields, head), uri, digest


def _package(pages: Iterator[tuple], date: str, member_bytes: int) -> Iterator[bytes]:
    """The rows of the package of these pages; none if there is no page."""
    package, index, name, number = PackageWriter(), [], "", 0

    def closed() -> Iterator[bytes]:
        yield package.close()
        yield package.open(f"indexes/{name}.cdxj")
        yield package.add("\n".join(index).encode())
        yield package.close()

    stamp = re.sub(r"\D", "", date)[:14]
    for page in pages:
        if not name:
            name = f"data-{number:05d}"
            yield package.open(f"archive/{name}.warc")
            about = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("warcinfo", str(number))), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            yield package.add(about[:-1])
        record, uri, digest = _page_record(*page, date)
        place = {"filename": f"archive/{name}.warc", "offset": package.at - package.start, "length": len(record), "digest": f"sha1:{digest}", "mime": "warc/revisit" if page[3] is not None else "text/html", "status": "200"}
        index.append(f"{uri} {stamp} {json.dumps(place)}")
        yield package.add(record[:-1])
        if package.at - package.start >= member_bytes:
            yield from closed()
            index, name, number = [], "", number + 1
    if name:
        yield from closed()
    if package.at:
        yield from package.end()


def _batched(rows: Iterator[tuple[bytes, ...]], names: list[str], types: list[pa.DataType], size_of) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``BLOCK_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row) + 256
        if size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def write_archives(referred: DataFrame, path: str, date: str = DATE, member_bytes: int = MEMBER_BYTES) -> None:
    """Write pages (as from :func:`with_referred`) as ZIP packages below ``path``, one for each task that has any.

    Ids are kept as text.  A null or empty URL is replaced by the record's own
    id; white space, control and non-ASCII characters of a URL are
    percent-encoded.  A row with the same id, URL and payload as another gets
    the same record id.
    """

    def write(batches):
        pages = (page for batch in batches for page in zip(*(column.to_pylist() for column in batch.columns)))
        yield from _batched(((row,) for row in _package(pages, date, member_bytes)), ["row"], [pa.binary()], lambda row: len(row[0]))

    texts = referred.select(F.col("id").cast("string"), "url", "body", F.col("refers_to").cast("string"))
    rows = texts.mapInArrow(write, "row binary").select(F.col("row").cast("string"))
    rows.write.option("lineSep", "\n").option("compression", "none").text(path)


# --- reading ---------------------------------------------------------------


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by their lower-case names; the first line is left out."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _split(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record, which may be compressed."""
    if record[:2] == b"\x1f\x8b":
        record = zlib.decompress(record, 31)
    head, gap, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head) if gap and head.startswith(b"WARC/") else {}
    size = int(fields.get("content-length", -1))
    if not 0 <= size <= len(rest):
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def _payload(fields: dict[str, str], block: bytes) -> tuple[bytes | None, int | None, str | None]:
    """Payload, its length, and its digest.  Of a revisit the payload is not here; its length and digest are those of the full one."""
    stated = fields.get("warc-payload-digest", "")
    own = stated[5:].upper() if stated.lower().startswith("sha1:") else None
    payload, length = block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        length = _fields(head).get("content-length")
    if fields.get("warc-type") == "revisit":
        return None, int(length) if length else None, own
    digest = payload_digest(payload)
    if own is not None and own != digest:
        raise ValueError(f"damaged WARC record {fields.get('warc-record-id')}: its payload does not have its digest")
    return payload, len(payload), digest


def _walk(read_at: ReadAt, member: Member) -> Iterator[tuple[int, int]]:
    """Offset and length of each record of a member without index, by headers only."""
    at, end = member.start, member.start + member.size
    while at < end:
        size = min(_HEAD, end - at)
        head = read_at(at, size)
        while b"\r\n\r\n" not in head and len(head) < end - at:
            size = min(2 * size, end - at)
            head = read_at(at, size)
        fields = _fields(head.partition(b"\r\n\r\n")[0])
        if not head.startswith(b"WARC/") or "content-length" not in fields:
            raise ValueError(f"not a WARC record: byte {at - member.start} of {member.name}")
        length = head.index(b"\r\n\r\n") + 4 + int(fields["content-length"]) + 4
        yield at, length
        at += length


def _walk_compressed(read_at: ReadAt, member: Member) -> Iterator[tuple[int, int]]:
    """The same where each record is compressed on its own: found by reading through."""
    at, end, start, unpack = member.start, member.start + member.size, member.start, zlib.decompressobj(31)
    while at < end:
        data = read_at(at, min(1 << 20, end - at))
        at += len(data)
        while data:
            unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                yield start, at - len(data) - start
                start, unpack = at - len(data), zlib.decompressobj(31)
    if start != end:
        raise ValueError(f"{member.name} ends within a record")


def _indexed(read_at: ReadAt, index: Member, by_name: dict[str, Member]) -> Iterator[tuple[str, int, int]]:
    """Member name, offset in the package and length of each record that an index names."""
    lines = read_at(index.start, index.size)
    if lines[:2] == b"\x1f\x8b":
        lines = zlib.decompress(lines, 31)
    for line in lines.splitlines():
        brace = line.find(b"{")
        if line.startswith(b"!") or brace < 0:
            continue
        place = json.loads(line[brace:])
        name = place["filename"] if place["filename"] in by_name else f"archive/{place['filename']}"
        yield name, by_name[name].start + int(place["offset"]), int(place["length"])


def record_ranges(path: str) -> Iterator[tuple[int, int]]:
    """Offset and length in a package of each record: those its indexes name, and all of members that no index names."""
    read_at, size = opened(path)
    listed = list(members(read_at, size))
    by_name = {m.name: m for m in listed if m.name.endswith((".warc", ".warc.gz"))}
    indexes = [m for m in listed if m.name.endswith((".cdxj", ".cdx", ".idx.gz", ".cdxj.gz", ".cdx.gz")) and m.size]
    for member in [*by_name.values(), *indexes]:
        if member.start < 0:
            raise ValueError(f"{member.name} in {path} is compressed or encrypted, so no range of it can be read")
    found = set()
    for index in indexes:
        for name, offset, length in _indexed(read_at, index, by_name):
            found.add(name)
            yield offset, length
    for name, member in by_name.items():
        if name not in found and member.size:
            yield from (_walk_compressed if read_at(member.start, min(2, member.size)) == b"\x1f\x8b" else _walk)(read_at, member)


def _fetched(ranges: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, bytes]]:
    """The bytes of ranges that come in order; neighbours share a read of at most ``BLOCK_BYTES``, or of one record."""
    held: list[tuple[str, int, int]] = []
    path, read_at = None, None

    def together() -> Iterator[tuple[str, int, bytes]]:
        first = held[0][1]
        data = read_at(first, max(offset + length for _, offset, length in held) - first)
        for name, offset, length in held:
            yield name, offset, data[offset - first:offset - first + length]

    for name, offset, length in ranges:
        if held and (name != path or offset + length - held[0][1] > BLOCK_BYTES or offset - held[-1][1] - held[-1][2] > _GAP):
            yield from together()
            held = []
        if name != path:
            path, read_at = name, opened(name)[0]
        held.append((name, offset, length))
    if held:
        yield from together()


def packages(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of each package below ``path``; the contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all packages below ``path``, by ranges spread over all tasks.

    ``path`` and ``offset`` say where a record lies.  ``payload`` is null for
    revisits, whose ``payload_bytes`` and ``payload_digest`` are those of the
    payload they refer to.  A payload that does not have the SHA-1 its record
    states is an error.  Files must lie where pyarrow can open them: local and
    shared folders, HDFS, S3, GCS, Azure.
    """

    def listed(batches):
        found = ((name, offset, length) for batch in batches for name in batch.column("path").to_pylist() for offset, length in record_ranges(name))
        yield from _batched(found, ["path", "offset", "length"], [pa.string(), pa.int64(), pa.int64()], lambda row: len(row[0]))

    def read(batches):
        ranges = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        yield from _batched(map(_row, _fetched(ranges)), names, types, lambda row: len(row[9] or b""))

    names = [field.split()[0] for field in RECORDS.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[field.split()[1]] for field in RECORDS.split(", ")]
    ranges = packages(spark, path).select("path").mapInArrow(listed, "path string, offset long, length long")
    # Written: the ranges are listed once, not again for the bounds of the partitions.
    ranges = written(ranges, "warc-ranges")
    # A task gets as many bytes of records as Spark gives it of any file.
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(1, -(-total(ranges, F.col("length")) // most))
    spread = ranges.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return spread.mapInArrow(read, RECORDS)


def _row(fetched: tuple[str, int, bytes]) -> tuple:
    path, offset, record = fetched
    fields, block = _split(record)
    payload, size, digest = _payload(fields, block)
    page, refers = fields.get("page-id"), fields.get("refers-to-page-id")
    return (
        path, offset, len(record), fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"),
        None if page is None else unquote(page), None if refers is None else unquote(refers), payload, size, digest,
    )


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", path: str | None = None) -> DataFrame:
    """Write the pages as archives, read them back, and give a row for each page record.

    A null body is an empty payload.  Columns besides the three are left out.
    """
    spark = pages.sparkSession
    path = path or work_folder(spark, "warc")
    write_archives(with_referred(pages, id_col, url_col, body_col), path)
    kind = pages.schema[id_col].dataType
    found = read_records(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    return found.select(
        F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )
