"""Bundles of small files: tar archives (ustar) of regular files, written one after another and read by slices.

A member is found by walking the headers from the archive's start, so an archive needs no
index and its byte ranges can go to several tasks. Members that aren't regular files are passed
over. Names have at most 100 bytes; others are refused when written.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyarrow import fs

SUFFIX, BLOCK = ".tar", 512
#: Members up to this size are read whole.
SMALL = 1 << 20
#: Fields of a header: name, mode, owners, size, time, sum, type, link, magic and the rest.
_HEADER = struct.Struct("100s8s16s12s12s8sc100s8s80s155s12s")
_PLAIN = sum(b"0000644\0" + b"0000000\0" * 2 + b"00000000000\0" + b" " * 8 + b"0" + b"ustar\00000")


class BundleError(Exception):
    """An archive that breaks off or has a bad header."""


class Window:
    """A part of a file that is read by slices, as a file."""

    def __init__(self, data, start: int, length: int):
        self.data, self.start, self.length = data, start, length

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.length)
        return self.data[self.start + start : self.start + max(start, stop)]


def header(name: str, size: int) -> bytes:
    raw, digits = name.encode(), b"%011o\0" % size
    if len(raw) > 100 or size >> 33:
        raise ValueError(f"no member of a bundle: {name!r} of {size} bytes")
    total = b"%06o\0 " % (_PLAIN + sum(raw) + sum(digits))
    return _HEADER.pack(raw, b"0000644\0", b"0000000\0" * 2, digits, b"00000000000\0", total, b"0", b"", b"ustar\00000", b"", b"", b"")


def _octal(raw: bytes) -> int:
    """A number of a header: octal digits, or bytes where the first bit is set."""
    return int.from_bytes(raw[1:], "big") if raw[0] & 128 else int(raw.rstrip(b" \0") or b"0", 8)


def members(data, start: int = 0, stop: int | None = None) -> Iterator[tuple[str, bytes | Window]]:
    """Name and bytes of the members whose headers begin in a range of an archive.

    An archive is broken for the range where it is; a file may end without the two empty blocks.
    """
    at, size = 0, len(data)
    while at < size and (stop is None or at < stop):
        head = data[at : at + BLOCK]
        if not head.strip(b"\0"):
            return
        try:
            length, told = _octal(head[124:136]), _octal(head[148:156])
        except (ValueError, IndexError):
            length, told = 0, -1
        if told != sum(head) - sum(head[148:156]) + 256 or at + BLOCK + length > size:
            if at < start:
                return
            raise BundleError(f"broken archive at byte {at}")
        if at >= start and head[156:157] in (b"0", b"\0"):
            prefix = head[345:500].split(b"\0")[0] if head[257:263] == b"ustar\0" else b""
            name = b"/".join(x for x in (prefix, head[:100].split(b"\0")[0]) if x).decode("utf-8", "replace")
            inside = Window(data, at + BLOCK, length)
            yield name, inside if length > SMALL else inside[:]
        at += BLOCK + -(-length // BLOCK) * BLOCK


class Sink:
    """Writes files into a folder, which the first one makes: each by itself, or into bundles of about ``bundle_bytes``."""

    def __init__(self, store: fs.FileSystem, folder: str, bundle_bytes: int = 0):
        self.store, self.folder, self.most, self.out, self.weight, self.count = store, folder, bundle_bytes, None, 0, 0

    def __enter__(self) -> Sink:
        return self

    def __exit__(self, *_) -> None:
        self._end()

    def _end(self) -> None:
        if self.out:
            with self.out:
                self.out.write(bytes(2 * BLOCK))
        self.out, self.weight = None, 0

    def put(self, name: str, content: bytes) -> None:
        head = header(name, len(content)) if self.most else b""
        if not self.count:
            self.store.create_dir(self.folder, recursive=True)
        self.count += 1
        if not self.most:
            with self.store.open_output_stream(f"{self.folder}/{name}") as out:
                out.write(content)
            return
        if self.out is None:
            self.out = self.store.open_output_stream(f"{self.folder}/bundle-{self.count:08d}{SUFFIX}", buffer_size=1 << 20)
        self.out.write(head + content + bytes(-len(content) % BLOCK))
        self.weight += len(head) + len(content)
        if self.weight >= self.most:
            self._end()
