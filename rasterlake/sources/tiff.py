"""TIFF bytes in plain Python and numpy: directories, tags, metadata, pixels, encoding.

Nothing here knows Spark; ``operators/tiff_columns.py`` runs it over Arrow batches and
``sources/tiff_source.py`` over files, of which only slices are read. Every defect of a file
is a ``TiffError`` whose ``kind`` is a row of the error table.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Callable, Sequence

import numpy as np

from ..functions.limits import DEFAULT_LIMITS
from ..functions.pixels import COMPOSED

#: Bytes that decoding needs beside its rasters.
SCRATCH = 524288
#: Fixed values of the file format.
MAGICS = {b"II*\0": ("<", False), b"MM\0*": (">", False), b"II+\0": ("<", True), b"MM\0+": (">", True)}
CODES = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SIZES = {kind: struct.calcsize("<" + code) for kind, code in CODES.items()}
DESCRIPTIVE = (0x010D, 0x010E, 0x010F, 0x0110, 0x0131, 0x0132, 0x013B, 0x013C, 0x8298)
METHODS = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825
CHANNELS, SAMPLE_BYTES = {"gray": 1, "graya": 2, "rgb": 3, "rgba": 4}, {"u8": 1, "u16": 2, "f32": 4}

Entry = tuple[int, int, int, bytes]  # tag, field type, count, raw bytes


class TiffError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def header(data: bytes) -> tuple[str, bool, int]:
    """Byte order, whether offsets have 64 bits, first directory."""
    if len(data) < 4 and (len(data) < 2 or data[:2] in (b"II", b"MM")):
        raise TiffError("Truncated", "short header")
    if data[:4] not in MAGICS:
        raise TiffError("Decode", "no TIFF header")
    order, big = MAGICS[data[:4]]
    try:
        return order, big, struct.unpack(order + ("Q" if big else "I"), data[8:16] if big else data[4:8])[0]
    except struct.error:
        raise TiffError("Truncated", "short header") from None


def directory(data: bytes, at: int, order: str, big: bool = False) -> tuple[list[Entry], int] | None:
    """Entries at an offset and the next directory's; null when it doesn't fit the file.

    Entries of unknown types and those whose values lie outside the file are skipped.
    """
    head, size, inline = (8, 20, 8) if big else (2, 12, 4)
    wide, number = ("Q", "HHQ8s") if big else ("I", "HHI4s")
    if at <= 0 or at + head > len(data):
        return None
    count = int.from_bytes(data[at : at + head], "little" if order == "<" else "big")
    start = at + head
    end, whole = start + count * size, len(data)
    if end > whole:
        return None
    found = []
    for tag, kind, n, last in struct.iter_unpack(order + number, data[start:end]):
        if kind not in CODES:
            continue
        length = n * SIZES[kind]
        if length <= inline:
            found.append((tag, kind, n, last[:length]))
            continue
        begin = struct.unpack(order + wide, last)[0]
        if begin + length <= whole:
            found.append((tag, kind, n, data[begin : begin + length]))
    after = struct.unpack(order + wide, data[end : end + inline])[0] if end + inline <= len(data) else 0
    return found, after


def pages(data: bytes) -> list[list[Entry]]:
    """Directories of the chain up to the first bad or already seen one."""
    order, big, at = header(data)
    found, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        parsed = directory(data, at, order, big)
        if parsed is None:
            break
        found.append(parsed[0])
        at = parsed[1]
    return found


def values(entry: Entry, order: str) -> tuple:
    """Numbers of an entry; rationals are consecutive pairs."""
    _, kind, count, raw = entry
    return struct.unpack(order + CODES[kind] * count if len(CODES[kind]) > 1 else f"{order}{count}{CODES[kind]}", raw)


class Directory:
    """Typed access to the entries of one directory; the first entry of a tag counts."""

    def __init__(self, entries: list[Entry], order: str):
        self.order, self.entries, self.known = order, {}, {}
        for entry in entries:
            self.entries.setdefault(entry[0], entry)

    def many(self, tag: int) -> tuple:
        if tag not in self.known:
            self.known[tag] = values(self.entries[tag], self.order) if tag in self.entries else ()
        return self.known[tag]

    def one(self, tag: int, default=None):
        return (self.many(tag) or (default,))[0]

    def raw(self, tag: int) -> bytes | None:
        return (self.entries[tag][3] or None) if tag in self.entries else None

    def text(self, tag: int) -> str | None:
        raw = self.raw(tag)
        return raw.split(b"\0")[0].decode("utf-8", "replace") or None if raw else None

    def pair(self, tag: int) -> tuple[int, int] | None:
        found = self.many(tag)
        return tuple(found) if len(found) == 2 else None


def first_page(data: bytes) -> tuple[Directory, int, bool]:
    order, big, at = header(data)
    found = pages(data)
    if not found:
        raise TiffError("Truncated" if at else "Decode", "no directory")
    return Directory(found[0], order), len(found), big


def color_type(d: Directory) -> str:
    samples, photometric = d.one(277, 1), d.one(262)
    if photometric in (0, 1):
        return "gray" if samples == 1 else "graya" if samples == 2 and d.one(338) in (1, 2) else "multiband"
    named = {(2, 3): "rgb", (2, 4): "rgba", (3, 1): "palette", (5, 4): "cmyk", (5, 5): "cmyka", (6, 3): "ycbcr", (8, 3): "lab"}
    if photometric not in (2, 3, 5, 6, 8):
        raise TiffError("UnsupportedFeature", f"photometric interpretation {photometric}")
    return named.get((photometric, samples), "multiband")


def dots_per_inch(unit: int | None, x: tuple | None, y: tuple | None) -> tuple[float, float] | None:
    if unit not in (2, 3) or not x or not y or not x[1] or not y[1]:
        return None
    scale = 2.54 if unit == 3 else 1.0
    return x[0] / x[1] * scale, y[0] / y[1] * scale


def exif_blob(data: bytes, d: Directory, big: bool) -> bytes | None:
    """Descriptive tags and those of the EXIF directory as a TIFF of their own; GPS isn't followed."""
    entries = [d.entries[tag] for tag in DESCRIPTIVE if tag in d.entries]
    at = d.one(EXIF_POINTER) if d.entries.get(EXIF_POINTER, (0, 0))[1] in (3, 4, 13, 18) else None
    parsed = directory(data, at, d.order, big) if at else None
    entries = sorted(entries + (parsed[0] if parsed else []), key=lambda e: e[0])
    if not entries:
        return None
    return (b"II*\0" if d.order == "<" else b"MM\0*") + struct.pack(d.order + "I", 8) + pack_directory(entries, d.order, 8)


def pack_directory(entries: list[Entry], order: str, at: int, big: bool = False, after: int = 0) -> bytes:
    """Bytes of a directory that will stand at ``at``, its values behind it."""
    inline, size, head, word = (8, 20, "Q", "Q") if big else (4, 12, "H", "I")
    pool_at = at + struct.calcsize("<" + head) + size * len(entries) + inline
    rows, pool = [struct.pack(order + head, len(entries))], b""
    row, far = f"{order}HH{word}{inline}s", order + word
    for tag, kind, count, raw in entries:
        if len(raw) > inline:
            raw, pool = struct.pack(far, pool_at + len(pool)), pool + raw + b"\0" * (len(raw) % 2)
        rows.append(struct.pack(row, tag, kind, count, raw))
    return b"".join(rows) + struct.pack(order + word, after) + pool


def summary(d: Directory, count: int, big: bool) -> dict:
    """What the numbers of a file's first directory tell; ``count`` is that of its pages."""
    width, height = d.one(256), d.one(257)
    if not width or not height:
        raise TiffError("Decode", "no image size")
    return {
        "width": width, "height": height, "color": color_type(d), "bits": d.one(258, 1), "samples": d.one(277, 1), "is_float": 3 in d.many(339),
        "big": big, "page_count": count, "compression": d.one(259), "photometric": d.one(262), "orientation": d.one(274),
    }


def info(data: bytes) -> dict:
    """What a probe tells, without pixels."""
    d, count, big = first_page(data)
    found = summary(d, count, big)
    unit, x, y = d.one(296), d.pair(282), d.pair(283)
    dpi = dots_per_inch(unit, x, y)
    return found | {
        "resolution_unit": unit, "dpi_x": dpi and dpi[0], "dpi_y": dpi and dpi[1], "page_name": d.text(285),
        "icc": d.raw(34675), "xmp": d.raw(700), "iptc": d.raw(33723), "exif": exif_blob(data, d, big),
    }


#: Fixed values of LZW: the codes that clear the table and end the data, and the codes between two clears.
CLEAR, END, _AT_ONCE = 256, 257, 4096 - 258 + 1
#: Bits of the k-th code after a clear, and of all before it: one more each time the table has all but one of its codes.
_WIDTHS = np.searchsorted(np.array([511, 1023, 2047]), np.arange(_AT_ONCE) + 258 - 1, side="right") + 9
_BEFORE = np.concatenate([[0], np.cumsum(_WIDTHS)])


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """The bytes of LZW data, no more than about ``most``.

    The codes between two clears are cut out together. A new code stands for a code's bytes
    and the byte behind them, which lie together in the output.
    """
    raw, total = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64), len(data) * 8
    out, at = bytearray(), 0
    single = [bytes([i]) for i in range(256)]
    while at + 9 <= total and (most is None or len(out) < most):
        most_codes = min(_AT_ONCE, (total - at) // 9)
        places = at + _BEFORE[:most_codes]
        n = int(np.searchsorted(places + _WIDTHS[:most_codes], total, side="right"))
        places, widths = places[:n], _WIDTHS[:n]
        first = places >> 3
        window = raw[first] << 16 | raw[first + 1] << 8 | raw[first + 2]
        codes = window >> (24 - (places & 7) - widths) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if stops.size else n
        starts, sizes = [], []  # of each code's bytes in the output
        for i, code in enumerate(codes[:stop].tolist()):
            start = len(out)
            if code < 256:
                out += single[code]
                size = 1
            else:
                known = code - 258
                if known < i - 1:
                    begin, size = starts[known], sizes[known] + 1
                    out += out[begin : begin + size]
                elif known == i - 1:
                    begin, size = starts[known], sizes[known] + 1
                    out += out[begin : begin + size - 1]
                    out.append(out[begin])
                else:
                    raise TiffError("Decode", "bad LZW code")
            starts.append(start)
            sizes.append(size)
            if most is not None and len(out) >= most:
                return bytes(out)
        if stop < n and codes[stop] == END:
            break
        if not stops.size and n < _AT_ONCE:
            break
        at += int(_BEFORE[min(stop, n - 1) + 1])
    return bytes(out)


#: Codes from a clear to the next one that is written, which is among them.
_SEGMENT = 4094 - 258 + 1
#: Which of 16 bits the k-th code after a clear has.
_KEPT = np.arange(16) >= 16 - _WIDTHS[:, None]


def _lzw_codes(data: bytes) -> list[int]:
    """Codes of bytes behind the first clear, up to the end code; every ``_SEGMENT``-th is a clear."""
    codes, table, after = [], {}, 258
    find, put = table.get, codes.append
    prefix = data[0] if data else -1
    for byte in data[1:]:
        pair = prefix << 8 | byte
        known = find(pair)
        if known is not None:
            prefix = known
            continue
        put(prefix)
        table[pair] = after
        after, prefix = after + 1, byte
        if after == 4094:
            put(CLEAR)
            table.clear()
            after = 258
    if prefix >= 0:
        put(prefix)
    put(END)
    return codes


def lzw_encode(data: bytes) -> bytes:
    """LZW data of bytes; codes are packed together once all are known."""
    codes = np.array([CLEAR, *_lzw_codes(data)], ">u2")
    since = np.arange(-1, len(codes) - 1) % _SEGMENT  # of each code, the number since the last clear
    since[0] = 0
    return np.packbits(np.unpackbits(codes.view(np.uint8)).reshape(-1, 16)[_KEPT[since]]).tobytes()


def lzw_size(data: bytes) -> int:
    """Length of :func:`lzw_encode`, by the number of codes alone."""
    table, after, segments = {}, 258, 0
    put, prefix = table.setdefault, data[0] if data else -1
    for byte in data[1:]:
        known = put(prefix << 8 | byte, after)
        if known != after:
            prefix = known
            continue
        after, prefix = after + 1, byte
        if after == 4094:
            table.clear()
            after, segments = 258, segments + 1
    rest = after - 258 + (2 if data else 1)  # the codes of the table, of the last bytes, and the end code
    return -(-(9 + segments * int(_BEFORE[_SEGMENT]) + int(_BEFORE[rest])) // 8)


def packbits_decode(data: bytes, most: int | None = None) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and (most is None or len(out) < most):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 if n == 128 else 2
    return bytes(out)


RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_encode(data: bytes) -> bytes:
    """Runs of 3 to 128 bytes as pairs, what lies between as literals."""
    out, at = bytearray(), 0

    def literals(end: int) -> None:
        for start in range(at, end, 128):
            part = data[start : min(start + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in RUN.finditer(data):
        literals(run.start())
        at = run.end()
        out += bytes((257 - at + run.start(), data[run.start()]))
    literals(len(data))
    return bytes(out)


def packbits_size(data: bytes) -> int:
    """Length of :func:`packbits_encode`."""
    size, at = 0, 0
    same = (codes := np.frombuffer(data, np.uint8))[1:] == codes[:-1]
    for run in RUN.finditer(data) if (same[1:] & same[:-1]).any() else ():
        between = run.start() - at
        size, at = size + between + -(-between // 128) + 2, run.end()
    between = len(data) - at
    return size + between + -(-between // 128)


def inflate(block: bytes, method: int, want: int) -> bytes:
    if method == 1:
        out = block
    elif method == 5:
        out = lzw_decode(block, want)
    elif method in (8, 32946):
        try:
            out = zlib.decompressobj().decompress(block, want)
        except zlib.error as error:
            raise TiffError("Decode", str(error)) from None
    elif method == 32773:
        out = packbits_decode(block, want)
    else:
        raise TiffError("UnsupportedFeature", f"compression {method}")
    if len(out) < want:
        raise TiffError("Truncated", "short image data")
    return out[:want]


def _samples(raw: bytes, rows: int, across: int, samples: int, bits: int, form: int, order: str, predictor: int) -> np.ndarray:
    """One decompressed block as (rows, across, samples)."""
    if bits < 8:
        flat = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : across * samples * bits]
        weights = 1 << np.arange(bits - 1, -1, -1)
        return (flat.reshape(rows, across, samples, bits) @ weights).astype(np.uint8)
    name = {1: "u", 2: "i", 3: "f"}.get(form)
    if name is None or bits not in (8, 16, 32, 64) or (name == "f" and bits == 8):
        raise TiffError("UnsupportedFeature", f"{bits} bits of sample format {form}")
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8).reshape(rows, -1).copy()
        planes = np.cumsum(planes.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, bits // 8, across * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{bits // 8}").reshape(rows, across, samples)
    grid = np.frombuffer(raw, f"{order}{name}{bits // 8}").reshape(rows, across, samples)
    if predictor == 2:
        unsigned = np.dtype(f"u{bits // 8}")
        grid = np.cumsum(grid.astype(grid.dtype.newbyteorder("=")).view(unsigned), axis=1, dtype=unsigned).view(grid.dtype.newbyteorder("="))
    return grid


def grid_of(d: Directory) -> tuple[list[tuple[int, int, int, int, int, int, int]], dict]:
    """Strips or tiles of a page as (plane, x, y, width, height, offset, length), and how their samples are stored."""
    width, height, samples = d.one(256), d.one(257), d.one(277, 1)
    depths, forms = set(d.many(258) or (1,)), set(d.many(339) or (1,))
    if len(depths) > 1 or len(forms) > 1:
        raise TiffError("UnsupportedFeature", "samples of different formats")
    tiled, apart = 322 in d.entries, d.one(284, 1) == 2
    if tiled:
        across, down = d.one(322), d.one(323)
        offsets, lengths = d.many(324), d.many(325)
    else:
        across, down = width, min(d.one(278, height) or height, height)
        offsets, lengths = d.many(273), d.many(279)
    if not across or not down or not offsets or len(offsets) != len(lengths):
        raise TiffError("Decode", "no strips or tiles")
    each, columns, lines = (1 if apart else samples), -(-width // across), -(-height // down)
    if len(offsets) < columns * lines * (samples if apart else 1):
        raise TiffError("Decode", "missing strips or tiles")
    found = []
    for i in range(columns * lines * (samples if apart else 1)):
        plane, block = divmod(i, columns * lines)
        y, x = block // columns * down, block % columns * across
        found.append((plane, x, y, across, down if tiled else min(down, height - y), offsets[i], lengths[i]))
    return found, {"method": d.one(259, 1), "each": each, "apart": apart, "bits": depths.pop(), "form": forms.pop(), "order": d.order, "predictor": d.one(317, 1), "inverted": d.one(262) == 0, "width": width, "height": height}


def block(packed: bytes, place: tuple[int, ...], how: dict) -> np.ndarray:
    """Stored samples of one strip or tile as (rows, columns, samples), cut to the image."""
    _, x, y, across, rows, _, _ = place
    raw = inflate(packed, how["method"], rows * (-(-across * how["each"] * how["bits"] // 8)))
    got = _samples(raw, rows, across, how["each"], how["bits"], how["form"], how["order"], how["predictor"])[: how["height"] - y, : how["width"] - x]
    if how["inverted"] and got.dtype.kind == "u":
        got = ((1 << how["bits"]) - 1 - got).astype(got.dtype)
    return got


def planes(data: bytes, d: Directory) -> np.ndarray:
    """Stored samples of the first page as (height, width, samples), before conversion."""
    places, how = grid_of(d)
    out = None
    for place in places:
        plane, x, y, _, _, offset, length = place
        got = block(data[offset : offset + length], place, how)
        if len(places) == 1 and not how["apart"]:
            return got.astype(got.dtype.newbyteorder("="), copy=False)
        if out is None:
            out = np.zeros((how["height"], how["width"], d.one(277, 1)), got.dtype.newbyteorder("="))
        out[y : y + got.shape[0], x : x + got.shape[1], plane if how["apart"] else slice(None)] = got[:, :, 0] if how["apart"] else got
    return out


def _cmyk(grid: np.ndarray) -> np.ndarray:
    if grid.dtype == np.int8:
        grid = (grid.astype(np.int16) + 128).astype(np.uint8)
    if grid.dtype not in (np.uint8, np.uint16, np.float32):
        raise TiffError("UnsupportedFeature", f"CMYK of {grid.dtype}")
    most = {1: 255, 2: 65535, 4: 1}[grid.dtype.itemsize]
    if grid.dtype == np.uint8:
        light = _byte_light().take(grid[:, :, :3].astype(np.uint16) << np.uint16(8) | grid[:, :, 3:4])
    else:
        light = _light(grid[:, :, :3], grid[:, :, 3:4], most)
    alpha = grid[:, :, 4:5] if grid.shape[2] > 4 else np.full(grid.shape[:2] + (1,), most, grid.dtype)
    return np.concatenate([light, alpha], axis=2)


def _light(ink: np.ndarray, black: np.ndarray, most: int) -> np.ndarray:
    """What is left of white behind ink and black; 16 bits in double, else in float."""
    real = np.float64 if ink.dtype == np.uint16 else np.float32
    one, top = real(1), real(most)
    light = (one - ink.astype(real) / top) * (one - black.astype(real) / top)
    return (light if ink.dtype == np.float32 else np.trunc(light * top + real(0.5))).astype(ink.dtype)


@functools.cache
def _byte_light() -> np.ndarray:
    """:func:`_light` of all pairs of bytes, ink first."""
    all_ = np.arange(256, dtype=np.uint8)
    return _light(all_[:, None], all_[None, :], 255).ravel()


def _palette(indices: np.ndarray, colours: tuple, bits: int) -> np.ndarray:
    if len(colours) < 3 << bits:
        raise TiffError("Decode", "short colour map")
    table = (np.array(colours, np.uint16)[: 3 << bits].reshape(3, -1).T >> 8).astype(np.uint8)
    return table[indices[:, :, 0]]


def _convert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Samples in the output's type: u8, u16 or f32."""
    kind, size = grid.dtype.kind, grid.dtype.itemsize
    if bits < 8:
        return (grid.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    if kind == "f":
        return grid.astype(np.float32)
    if kind == "i":
        grid = grid.view(f"u{size}") ^ np.array(1 << (size * 8 - 1), f"u{size}")
    return grid if size <= 2 else (grid >> np.array(size * 8 - 16, grid.dtype)).astype(np.uint16)


#: What each orientation does to (rows, columns): transposed, columns turned round, rows turned round.
_TURNS = {2: (False, True, False), 3: (False, True, True), 4: (False, False, True), 5: (True, False, False), 6: (True, True, False), 7: (True, True, True), 8: (True, False, True)}


def turn(grid: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels (height, width, channels) with an orientation applied; tags beyond 2..8 change nothing."""
    across, columns, rows = _TURNS.get(orientation, (False, False, False))
    if across:
        grid = grid.transpose(1, 0, 2)
    return grid[:: -1 if rows else 1, :: -1 if columns else 1]


def check_limits(d: Directory, color: str, limits: dict) -> None:
    """``LimitExceeded`` before anything is allocated: sides, pixels, then peak memory."""
    width, height, bits, samples = d.one(256), d.one(257), d.one(258, 1), d.one(277, 1)
    channels = {"cmyk": 4, "cmyka": 4, "palette": 3}.get(color, samples)
    size = next(n for top, n in ((8, 1), (16, 2), (32, 4), (1 << 16, 8)) if bits <= top)
    factor = 1 if bits == 8 and color in ("gray", "graya", "rgb", "rgba") else 2
    found = {"max_width": width, "max_height": height, "max_pixels": width * height, "max_memory": width * height * channels * size * factor + SCRATCH}
    for name, value in found.items():
        if limits.get(name) is not None and value > limits[name]:
            raise TiffError("LimitExceeded", f"{name}: {value} exceeds {limits[name]}")


def check_block(across: int, down: int, how: dict, color: str, limits: dict) -> None:
    """The limits of one strip or tile that is decoded by itself: its own size counts, not the image's."""
    size = across * down * how["each"] * -(-how["bits"] // 8)
    for name, value in (("max_pixels", across * down), ("max_memory", 2 * size + SCRATCH)):
        if limits.get(name) is not None and value > limits[name]:
            raise TiffError("LimitExceeded", f"{name}: {value} exceeds {limits[name]} ({color})")


def little(grid: np.ndarray) -> bytes:
    """Samples as little-endian bytes."""
    return np.ascontiguousarray(grid.astype(grid.dtype.newbyteorder("<"))).tobytes()


def decode(data: bytes, limits: dict | None = None, orientation: int = 1, palettes: bool = True, page: Directory | None = None) -> dict:
    """First page's pixels: width, height, descriptor, little-endian bytes.

    Without ``palettes``, images of indices are an unsupported feature. ``limits`` may have max_input, max_width, max_height, max_pixels and max_memory;
    ``orientation`` is applied to the pixels, ``page`` is the first page where it has been read before.
    """
    limits = limits or {}
    if limits.get("max_input") is not None and len(data) > limits["max_input"]:
        raise TiffError("Limit", f"{len(data)} bytes of input")
    d = page or first_page(data)[0]
    if not d.one(256) or not d.one(257):
        raise TiffError("Decode", "no image size")
    color, bits = color_type(d), d.one(258, 1)
    if color == "palette" and not palettes:
        raise TiffError("UnsupportedFeature", "palette")
    check_limits(d, color, limits)
    grid = planes(data, d)
    if color == "palette":
        out = _palette(grid, d.many(320), bits)
    elif color in ("cmyk", "cmyka"):
        out = _cmyk(grid)
    else:
        out = _convert(grid, bits)[:, :, :4]
    out = turn(out, orientation)
    layout = ("gray", "graya", "rgb", "rgba")[out.shape[2] - 1]
    return {"width": out.shape[1], "height": out.shape[0], "descriptor": f"{layout}_{ {'u1': 'u8', 'u2': 'u16', 'f4': 'f32'}[out.dtype.str[1:]] }", "pixels": little(out)}


def resolved(hint: str, own: int | None, asked: int | None) -> int:
    """The orientation that a hint bakes into the pixels: none, the file's own, the asked one, or the own and then the asked one."""
    own, asked = own if own in range(1, 9) else 1, asked or 1
    return {"preserve": 1, "correct": own, "exact": asked, "both": COMPOSED[(own - 1) * 8 + asked - 1]}[hint]


def decode_job(data: bytes, limits: dict | None = None, hint: str = "preserve", asked: int | None = None, icc: bool = True, exif: bool = True, xmp: bool = True) -> dict:
    """Pixels and metadata as a decode job gives them; the orientation that is left to apply, 1 after any baking."""
    limits = DEFAULT_LIMITS | {k: v for k, v in (limits or {}).items() if v is not None}
    if limits.get("max_input") is not None and len(data) > limits["max_input"]:
        raise TiffError("Limit", f"{len(data)} bytes of input")
    d, _, big = first_page(data)
    own = d.one(274) if d.one(274) in range(1, 9) else 1
    found = decode(data, limits, resolved(hint, own, asked))
    return found | {"orientation": own if hint == "preserve" else 1, "icc": d.raw(34675) if icc else None, "exif": exif_blob(data, d, big) if exif else None, "xmp": d.raw(700) if xmp else None}


def encode_job(pixels: bytes, width: int, height: int, descriptor: str, method: str = "lzw", hpred: bool = True, big: bool = False, metadata: dict | None = None, limits: dict | None = None) -> bytes:
    """As :func:`encode`, after the limits of an encode job: pixels, width, height, memory of the raster."""
    limits = limits or {}
    layout, _, sample = descriptor.partition("_")
    size = CHANNELS.get(layout, 4) * SAMPLE_BYTES.get(sample, 4)
    for name, value in (("max_pixels", width * height), ("max_width", width), ("max_height", height), ("max_memory", width * height * size)):
        if limits.get(name) is not None and value > limits[name]:
            raise TiffError("Limit", f"{name}: {value} exceeds {limits[name]}")
    return encode(pixels, width, height, descriptor, method, hpred, big, metadata)


def _pack(method: str) -> Callable[[bytes], bytes]:
    return {"none": bytes, "lzw": lzw_encode, "deflate": lambda b: zlib.compress(b, 6), "packbits": packbits_encode}[method]


def predicted(hpred: bool, method: str, descriptor: str) -> bool:
    """Whether the predictor is used: not without compression, and not for gray with alpha."""
    return hpred and method != "none" and not descriptor.startswith("graya_")


def raw_strips(pixels: bytes, width: int, height: int, descriptor: str, method: str = "lzw", hpred: bool = True, strip_bytes: int = 1 << 16) -> tuple[list[bytes], int, bool]:
    """Strips of pixels before compression, rows a strip, and whether the predictor was used."""
    layout, _, sample = descriptor.partition("_")
    if layout not in CHANNELS or sample not in SAMPLE_BYTES or method not in METHODS:
        raise TiffError("InvalidInput", f"cannot write {descriptor} with {method}")
    samples, size = CHANNELS[layout], SAMPLE_BYTES[sample]
    if width < 1 or height < 1 or len(pixels) != width * height * samples * size:
        raise TiffError("InvalidInput", "pixels don't fit the size")
    hpred = predicted(hpred, method, descriptor)
    line = width * samples * size
    if hpred:
        grid = np.frombuffer(pixels, f"<u{size}").reshape(height, width, samples)
        moved = grid.copy()
        moved[:, 1:] -= grid[:, :-1]
        pixels = moved.tobytes()
    rows = max(1, min(height, strip_bytes // line))
    return [pixels[at : at + rows * line] for at in range(0, height * line, rows * line)], rows, hpred


def strips_of(pixels: bytes, width: int, height: int, descriptor: str, method: str = "lzw", hpred: bool = True, strip_bytes: int = 1 << 16) -> tuple[list[bytes], int, bool]:
    """Compressed strips of pixels, rows a strip, and whether the predictor was used."""
    strips, rows, hpred = raw_strips(pixels, width, height, descriptor, method, hpred, strip_bytes)
    return [*map(_pack(method), strips)], rows, hpred


def encode(pixels: bytes, width: int, height: int, descriptor: str, method: str = "lzw", hpred: bool = True, big: bool = False, metadata: dict | None = None, strip_bytes: int = 1 << 16) -> bytes:
    """Pixels of one of the twelve descriptors as a little-endian TIFF of one page.

    The predictor is off for no compression and for gray with alpha. ``metadata`` may hold
    icc, xmp, orientation and exif (a TIFF blob whose tags are dealt over the directories).
    """
    return assemble(*strips_of(pixels, width, height, descriptor, method, hpred, strip_bytes), width, height, descriptor, method, big, metadata)


@functools.lru_cache(4096)
def _frames(strips: int, descriptor: str, cells: tuple[tuple[str, bool, bool], ...]) -> list[tuple[str, bool, int, int]]:
    """(method, predictor as used, bytes beside the strips, number of the cell): the first smallest of the layouts that share their strips."""
    found: dict[tuple[str, bool], tuple[int, int]] = {}
    for i, (method, hpred, big) in enumerate(cells):
        used = predicted(hpred, method, descriptor)
        size = len(assemble([b""] * strips, 1, used, 1, 1, descriptor, method, big))
        found[method, used] = min(found.get((method, used), (size, i)), (size, i))
    return [(*key, *value) for key, value in found.items()]


#: Length of a strip's data by method; LZW and PackBits are only measured.
_MEASURES = {"none": len, "lzw": lzw_size, "deflate": lambda b: len(zlib.compress(b, 6)), "packbits": packbits_size}


def smallest(pixels: bytes, width: int, height: int, descriptor: str, cells: Sequence[tuple[str, bool, bool]]) -> tuple[int, int]:
    """Bytes and number of the first smallest file among (method, predictor, layout); no file is made."""
    raw = {hpred: raw_strips(pixels, width, height, descriptor, method, hpred)[0] for hpred, method in ((False, "none"), (True, "lzw"))}
    sizes = []
    for method, used, beside, i in _frames(len(raw[False]), descriptor, tuple(cells)):
        lengths = [*map(_MEASURES[method], raw[used])]
        sizes.append((beside + sum(lengths) + sum(n % 2 for n in lengths), i))
    return min(sizes)


def assemble(strips: list[bytes], rows: int, hpred: bool, width: int, height: int, descriptor: str, method: str, big: bool, metadata: dict | None = None) -> bytes:
    """The file of compressed strips."""
    layout, _, sample = descriptor.partition("_")
    samples, size = CHANNELS[layout], SAMPLE_BYTES[sample]
    start, offsets, body = 16 if big else 8, [], bytearray()
    for strip in strips:
        offsets.append(start + len(body))
        body += strip + b"\0" * (len(strip) % 2)
    wide, word = (16, "Q") if big else (4, "I")

    def entry(tag: int, kind: int, *numbers: int) -> Entry:
        return tag, kind, len(numbers), struct.pack(f"<{len(numbers)}{CODES[kind]}", *numbers)

    entries = [
        entry(256, 4, width), entry(257, 4, height), entry(258, 3, *[size * 8] * samples), entry(259, 3, METHODS[method]),
        entry(262, 3, 1 if samples < 3 else 2), entry(273, wide, *offsets), entry(277, 3, samples), entry(278, 4, rows),
        entry(279, wide, *map(len, strips)), entry(339, 3, *[3 if sample == "f32" else 1] * samples),
    ]
    if hpred:
        entries.append(entry(317, 3, 2))
    if samples in (2, 4):
        entries.append(entry(338, 3, 2))
    extra = metadata or {}
    for tag, name, kind in ((34675, "icc", 7), (700, "xmp", 1)):
        if extra.get(name):
            entries.append((tag, kind, len(extra[name]), bytes(extra[name])))
    if extra.get("orientation"):
        entries.append(entry(274, 3, extra["orientation"]))
    parts = decompose_exif(extra["exif"]) if extra.get("exif") else {"ifd0": [], "exif": [], "gps": []}
    entries += [e for e in parts["ifd0"] if e[0] not in {x[0] for x in entries}]
    for pointer, name in ((EXIF_POINTER, "exif"), (GPS_POINTER, "gps")):
        if parts[name]:
            at = start + len(body)
            body += pack_directory(sorted(parts[name]), "<", at, big)
            body += b"\0" * (len(body) % 2)
            entries.append(entry(pointer, wide, at))
    at = start + len(body)
    head = b"II+\0" + struct.pack("<HHQ", 8, 0, at) if big else b"II*\0" + struct.pack("<I", at)
    return head + body + pack_directory(sorted(entries), "<", at, big)


def decompose_exif(blob: bytes) -> dict[str, list[Entry]]:
    """Tags of a blob by destination (ifd0, exif, gps) in little-endian; malformed blobs give none."""
    from ..plans.dimensions import DESCRIPTIVE as TO_IFD0
    from ..plans.dimensions import STRUCTURAL

    out: dict[str, list[Entry]] = {"ifd0": [], "exif": [], "gps": []}
    if len(blob) < 8 or blob[:4] not in (b"II*\0", b"MM\0*"):
        return out
    order, _, at = header(blob)
    parsed = directory(blob, at, order)
    if parsed is None:
        return out

    def add(dest: str, e: Entry) -> None:
        code = CODES[e[1]]
        raw = e[3] if order == "<" else struct.pack("<" + code * e[2], *struct.unpack(">" + code * e[2], e[3]))
        out[dest].append((e[0], 1 if e[1] == 7 else e[1], e[2], raw))

    for e in parsed[0]:
        if e[0] in (EXIF_POINTER, GPS_POINTER):
            inner = directory(blob, values(e, order)[0], order) if e[1] in (3, 4) and e[2] else None
            for sub in inner[0] if inner else []:
                if sub[0] != 0xA005:
                    add("exif" if e[0] == EXIF_POINTER else "gps", sub)
        elif e[0] != 0xA005 and e[0] not in STRUCTURAL:
            add("ifd0" if e[0] in TO_IFD0 else "exif", e)
    return out
