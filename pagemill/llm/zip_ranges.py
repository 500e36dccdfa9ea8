"""ZIP packages of stored members, written row by row and read by ranges.

Writing: a package is a sequence of rows, each followed by one line feed,
which is what Spark's text writer makes of them.  The line feeds have their
places in the format: they end a header's extra field, a WARC record, an index
line, or a comment.  So a package of any size passes through a task in pieces
and lands wherever Spark can write.

Reading: the end of the file leads to the central directory, if need be by
the ZIP64 records, and the directory to the members.  Only those ranges are
read; no member is extracted.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs

# Signatures and field limits of the ZIP format.
LOCAL, DESCRIPTOR, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x08074B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
_STREAMED, _UTF8 = 0x0008, 0x0800
_VERSION, _DATE = 45, 0x21  # ZIP64; the first day the format can name
_SPACER = 0x4C46  # an extra field of our own: its data is the line feed
_MOST_COMMENT = 65535

ReadAt = Callable[[int, int], bytes]


class PackageWriter:
    """Rows of one package.  ``at`` is the offset of the next row."""

    def __init__(self) -> None:
        self.at = 0
        self._directory: list[bytes] = []

    def _row(self, data: bytes) -> bytes:
        self.at += len(data) + 1
        return data

    def open(self, name: str) -> bytes:
        """The header of a member whose size is not known yet."""
        encoded = name.encode()
        self._name, self._header, self._crc = encoded, self.at, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0) + struct.pack("<HH", _SPACER, 1)
        row = struct.pack("<IHHHHHIIIHH", LOCAL, _VERSION, _STREAMED | _UTF8, 0, 0, _DATE, 0, FULL32, FULL32, len(encoded), len(extra) + 1)
        row = self._row(row + encoded + extra)
        self.start = self.at
        return row

    def add(self, data: bytes) -> bytes:
        """A piece of the open member, without its last line feed."""
        self._crc = zlib.crc32(b"\n", zlib.crc32(data, self._crc))
        return self._row(data)

    def close(self) -> bytes:
        """What follows the open member's data."""
        size = self.at - self.start
        extra = struct.pack("<HHQQQ", 1, 24, size, size, self._header)
        self._directory.append(
            struct.pack(
                "<IHHHHHHIIIHHHHHII", CENTRAL, _VERSION, _VERSION, _STREAMED | _UTF8, 0, 0, _DATE, self._crc, FULL32, FULL32,
                len(self._name), len(extra), 1, 0, 0, 0, FULL32,
            ) + self._name + extra
        )
        return self._row(struct.pack("<IIQQ", DESCRIPTOR, self._crc, size, size))

    def end(self) -> Iterator[bytes]:
        """The central directory; each entry's comment, and that of the package, is a line feed."""
        start, count = self.at, len(self._directory)
        for entry in self._directory:
            yield self._row(entry)
        size, at = self.at - start, self.at
        yield self._row(
            struct.pack("<IQHHIIQQQQ", END64, 44, _VERSION, _VERSION, 0, 0, count, count, size, start)
            + struct.pack("<IIQI", LOCATOR64, 0, at, 1)
            + struct.pack("<IHHHHIIH", END, 0, 0, min(count, FULL16), min(count, FULL16), FULL32, FULL32, 1)
        )


@dataclass(frozen=True)
class Member:
    """A member as the central directory has it; ``start`` is where its data begin, -1 where it is compressed or encrypted."""

    name: str
    start: int
    size: int
    crc: int


def opened(path: str) -> tuple[ReadAt, int]:
    """A reader of ranges and the size of a file, by a file system that pyarrow knows."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    file = system.open_input_file(place)

    def read_at(offset: int, length: int) -> bytes:
        file.seek(offset)
        data = file.read(length)
        if len(data) != length:
            raise ValueError(f"{path} ends before byte {offset + length}")
        return data

    return read_at, file.size()


def _end_record(read_at: ReadAt, size: int) -> tuple[int, bytes]:
    """Offset and fields of the end record: the last one whose comment ends with the file."""
    tail_size = min(size, 22 + _MOST_COMMENT)
    tail = read_at(size - tail_size, tail_size)
    found = tail.rfind(struct.pack("<I", END))
    while found >= 0:
        if found + 22 <= len(tail) and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
            return size - tail_size + found, tail[found:found + 22]
        found = tail.rfind(struct.pack("<I", END), 0, found)
    raise ValueError("no ZIP package: it has no end record")


def _directory(read_at: ReadAt, size: int) -> tuple[int, int, int]:
    """Offset, size and number of entries of the central directory."""
    at, end = _end_record(read_at, size)
    _, disk, first, here, count, length, start, _ = struct.unpack("<IHHHHIIH", end)
    if FULL16 in (disk, first, here, count) or FULL32 in (length, start):
        signature, _, at64, _ = struct.unpack("<IIQI", read_at(at - 20, 20)) if at >= 20 else (0, 0, 0, 0)
        if signature == LOCATOR64:
            signature, _, _, _, disk, first, here, count, length, start = struct.unpack("<IQHHIIQQQQ", read_at(at64, 56))
            if signature != END64:
                raise ValueError("damaged ZIP package: no ZIP64 end record where its locator points")
    if disk or first or here != count:
        raise ValueError("packages over several disks are not supported")
    return start, length, count


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """``values``, with those that did not fit taken from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return [next(wide) if v == FULL32 else v for v in values]
        at += 4 + length
    return values


def members(read_at: ReadAt, size: int) -> Iterator[Member]:
    """The members in the order of the central directory."""
    start, length, count = _directory(read_at, size)
    entries, at = read_at(start, length), 0
    for _ in range(count):
        fields = struct.unpack_from("<IHHHHHHIIIHHHHHII", entries, at)
        signature, flags, method, crc, packed, plain = fields[0], fields[3], fields[4], fields[7], fields[8], fields[9]
        name_size, extra_size, comment_size, header = fields[10], fields[11], fields[12], fields[16]
        if signature != CENTRAL:
            raise ValueError("damaged ZIP package: not a directory entry")
        name = entries[at + 46:at + 46 + name_size].decode("utf-8" if flags & _UTF8 else "cp437")
        extra = entries[at + 46 + name_size:at + 46 + name_size + extra_size]
        plain, packed, header = _wide(extra, [plain, packed, header])
        at += 46 + name_size + extra_size + comment_size
        if method or flags & 1:
            yield Member(name, -1, plain, crc)
            continue
        signature, *_, own_name, own_extra = struct.unpack("<IHHHHHIIIHH", read_at(header, 30))
        if signature != LOCAL:
            raise ValueError(f"damaged ZIP package: no header of {name}")
        yield Member(name, header + 30 + own_name + own_extra, packed, crc)
