"""JPEG 2000 headers: size, components, alpha, colour space, ICC; no pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .tiff import TiffError as SourceError

#: Enumerated colour spaces.
SPACES = {12: "cmyk", 16: "rgb", 17: "gray", 18: "rgb"}


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, start and end of the content of each box."""
    while at + 8 <= end:
        length, kind = struct.unpack_from(">I4s", data, at)
        start = at + 8
        if length == 1 and at + 16 <= end:
            length, start = struct.unpack_from(">Q", data, start)[0], at + 16
        stop = end if length == 0 else at + length
        if stop < start or stop > end:
            raise SourceError("Decode", "bad box length")
        yield kind, start, stop
        at = stop


def info(data: bytes) -> dict:
    """width, height, components, bits, alpha, color, icc and the descriptors of decode and probe."""
    alpha, color, icc, stream = False, None, None, None
    if data[:4] == b"\xff\x4f\xff\x51":
        stream = 0
    elif data[:8] == b"\0\0\0\x0cjP  ":
        for kind, start, stop in boxes(data, 0, len(data)):
            if kind == b"jp2c" and stream is None:
                stream = start
            if kind != b"jp2h":
                continue
            for inner, a, b in boxes(data, start, stop):
                if inner == b"colr" and color is None and b - a >= 3:
                    if data[a] == 1 and b - a >= 7:
                        color = SPACES.get(struct.unpack_from(">I", data, a + 3)[0], "unknown")
                    elif data[a] == 2:
                        color, icc = "icc", data[a + 3 : b]
                elif inner == b"cdef":
                    alpha = any(struct.unpack_from(">H", data, p + 2)[0] in (1, 2) for p in range(a + 2, b - 5, 6))
    if stream is None or data[stream : stream + 4] != b"\xff\x4f\xff\x51" or len(data) < stream + 43:
        raise SourceError("Decode", "no codestream header")
    x1, y1, x0, y0 = struct.unpack_from(">4I", data, stream + 8)
    components, depth = struct.unpack_from(">HB", data, stream + 40)
    if x1 <= x0 or y1 <= y0 or not components:
        raise SourceError("Decode", "empty image")
    if color is None:
        color = "gray" if components < 3 else "rgb"
    inked = components - alpha
    if color == "gray":
        pixels = "gray_u8"
    elif color == "rgb":
        pixels = "rgba_u8" if alpha else "rgb_u8"
    elif color == "cmyk":
        pixels = "rgba_u8"
    else:
        pixels = {1: "gray_u8", 3: "rgba_u8" if alpha else "rgb_u8"}.get(inked, "rgba_u8")
    return {"width": x1 - x0, "height": y1 - y0, "components": components, "bits": (depth & 127) + 1, "alpha": alpha, "color": color, "icc": icc, "descriptor": pixels, "probe_descriptor": "rgba_u8" if alpha else "rgb_u8"}
