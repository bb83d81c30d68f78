"""ZIP packages of stored members: a writer, and a reader by ranges that never extracts the package.

The reader finds the end-of-central-directory record in the file's tail, follows the ZIP64 locator where a field
overflows, parses the central directory, and places each member's data from its local header.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

END, LOCATOR, END64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    stored: int
    size: int
    header: int  # where the local header starts


def stored(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> Iterator[bytes]:
    """A package with stored members, piece by piece, so that no joined copy of it is made; ZIP64 fields where sizes
    need them, or everywhere on demand. A member's data come in pieces."""
    directory, at = [], 0
    for name, pieces in members:
        raw, length, crc = name.encode(), sum(map(len, pieces)), 0
        for x in pieces:
            crc = zlib.crc32(x, crc)
        big = zip64 or length >= FULL32 or at >= FULL32
        size = FULL32 if big else length
        extra = struct.pack("<HHQQ", 1, 16, length, length) if big else b""
        local = struct.pack("<4sHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra
        more = struct.pack("<HHQQQ", 1, 24, length, length, at) if big else b""
        directory.append(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(more), 0, 0, 0, 0, FULL32 if big else at) + raw + more)
        yield local
        yield from pieces
        at += len(local) + length
    table = b"".join(directory)
    n, big, whole = len(members), zip64 or at >= FULL32 or len(members) >= FULL16, len(table)
    if big:
        table += struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, whole, at)
        table += struct.pack("<4sIQI", LOCATOR, 0, at + len(table) - 56, 1)
    yield table
    yield struct.pack("<4sHHHHIIH", END, 0, 0, FULL16 if big else n, FULL16 if big else n, FULL32 if big else whole, FULL32 if big else at, 0)


def package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """The bytes of a package with stored members."""
    return b"".join(stored([(name, [data]) for name, data in members], zip64))


class Package:
    """read(offset, length) gives a range of the file."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}

    def _end(self) -> tuple[int, int, int]:
        """(members, bytes of the central directory, where it starts)"""
        tail = min(self.size, 22 + FULL16)
        data = self.read(self.size - tail, tail)
        at = len(data)
        while (at := data.rfind(END, 0, at)) >= 0:
            if at + 22 <= len(data) and at + 22 + struct.unpack_from("<H", data, at + 20)[0] == len(data):
                break
        if at < 0:
            raise ValueError("not a ZIP package: no end record")
        n, length, start = struct.unpack_from("<HII", data, at + 10)
        if n == FULL16 or length == FULL32 or start == FULL32:
            here = self.size - tail + at - 20
            locator = self.read(here, 20) if here >= 0 else b""
            if locator[:4] == LOCATOR:
                record = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if record[:4] != END64:
                    raise ValueError("broken ZIP64 end record")
                n, length, start = struct.unpack_from("<QQQ", record, 32)
        return n, length, start

    def _directory(self) -> list[Member]:
        n, length, start = self._end()
        data, at, out = self.read(start, length), 0, []
        for _ in range(n):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, _, _, crc, stored, size, names, extras, notes = struct.unpack_from("<HHHIIIHHH", data, at + 10)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + names].decode("utf-8", "replace")
            here, stop = at + 46 + names, at + 46 + names + extras
            while here + 4 <= stop:
                tag, width = struct.unpack_from("<HH", data, here)
                if tag == 1:
                    take = iter(struct.unpack_from(f"<{width // 8}Q", data, here + 4))
                    size = next(take) if size == FULL32 else size
                    stored = next(take) if stored == FULL32 else stored
                    header = next(take) if header == FULL32 else header
                here += 4 + width
            out.append(Member(name, method, crc, stored, size, header))
            at = stop + notes
        return out

    def start(self, member: Member) -> int:
        """Where a member's data start: its local header's own name and extra field may differ from the directory's."""
        head = self.read(member.header, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))

    def content(self, member: Member) -> bytes:
        data = self.read(self.start(member), member.stored)
        data = zlib.decompress(data, -15) if member.method == 8 else data
        if zlib.crc32(data) != member.crc:
            raise ValueError(f"{member.name}: checksum differs")
        return data
