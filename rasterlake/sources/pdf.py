"""PDF structure: objects (also in object streams) and the page tree; no rendering."""

from __future__ import annotations

import re
import zlib

from .tiff import TiffError as SourceError

#: Bytes of an object stream that are inflated at most; what lies behind isn't read.
MAX_STREAM = 64 << 20
WORD = re.compile(rb"[\s\0]*(?:%[^\r\n]*[\s\0]*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\s\0()<>\[\]{}/%]*|(\d+)[\s\0]+(\d+)[\s\0]+R\b|[^\s\0()<>\[\]{}/%]+)")
STREAM = re.compile(rb"\s*stream\r?\n")
OBJECT = re.compile(rb"(?<!\d)(\d+)[\s\0]+\d+[\s\0]+obj\b")


def value(data: bytes, at: int) -> tuple[object, int]:
    """The value at an offset and its end: dict, list, name (str with /), number, ('R', n) or bytes."""
    stack: list = [[]]
    while True:
        found = WORD.match(data, at)
        if not found:
            raise SourceError("Malformed", f"byte {at}")
        token, at = found[1], found.end()
        if token in (b"<<", b"["):
            stack.append([])
            continue
        if token in (b">>", b"]") and len(stack) > 1:
            items = stack.pop()
            item: object = dict(zip(items[::2], items[1::2], strict=False)) if token == b">>" else items
        elif token == b"(":
            depth, start = 1, at
            while depth and at < len(data):
                depth += (data[at] == 40) - (data[at] == 41)
                at += 2 if data[at] == 92 else 1
            item = data[start : at - 1]
        elif found[2]:
            item = ("R", int(found[2]))
        elif token[:1] == b"/":
            item = token.decode("latin-1")
        elif token[:1] == b"<":
            item = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1] + b"0" * (len(re.sub(rb"\s", b"", token)) % 2)).decode())
        else:
            try:
                item = float(token)
            except ValueError:
                item = token
        if len(stack) == 1:
            return item, at
        stack[-1].append(item)


def objects(data: bytes) -> dict[int, object]:
    """Values by object number; of several the last in the file, streams' objects first."""
    plain, packed = {}, {}
    for found in OBJECT.finditer(data):
        try:
            item, end = value(data, found.end())
        except SourceError:
            continue
        plain[int(found[1])] = item
        start = STREAM.match(data, end) if isinstance(item, dict) else None
        if not start:
            continue
        length = item.get("/Length")
        stop = start.end() + int(length) if isinstance(length, float) else data.find(b"endstream", start.end())
        item["#stream"] = start.end(), stop
        if item.get("/Type") == "/ObjStm":
            body = data[start.end() : stop]
            if item.get("/Filter") in ("/FlateDecode", ["/FlateDecode"]):
                try:
                    body = zlib.decompressobj().decompress(body, MAX_STREAM)
                except zlib.error:
                    continue
            first = int(item.get("/First", 0))
            numbers = [int(x) for x in body[:first].split()]
            for number, offset in zip(numbers[::2], numbers[1::2], strict=False):
                try:
                    packed[number] = value(body, first + offset)[0]
                except SourceError:
                    continue
    return packed | plain


def pages(data: bytes) -> list[tuple[float, float]]:
    """Width and height in points of every page in order, rotation applied."""
    return [(page["width"], page["height"]) for page in page_nodes(data)]


def page_nodes(data: bytes, contents: bool = False) -> list[dict]:
    """Pages in order: width, height (rotation applied), box, rotate and, where asked for, content.

    Inner nodes count once, so cycles end; broken references are left out; ``Encrypted`` where the
    trailer names an encryption, ``Malformed`` without a catalogue.
    """
    if not data.startswith(b"%PDF-"):
        raise SourceError("Malformed", "no PDF header")
    if re.search(rb"/Encrypt[\s\0]+\d+[\s\0]+\d+[\s\0]+R", data):
        raise SourceError("Encrypted", "encrypted")
    known = objects(data)

    def get(item: object) -> object:
        for _ in range(32):
            if not (isinstance(item, tuple) and item[0] == "R"):
                return item
            item = known.get(item[1])
        return None

    roots = [o for o in known.values() if isinstance(o, dict) and o.get("/Type") == "/Catalog"]
    if not roots:
        raise SourceError("Malformed", "no catalogue")
    found, seen = [], set()
    todo = [(roots[-1].get("/Pages"), {})]
    while todo:
        reference, above = todo.pop()
        node = get(reference)
        if not isinstance(node, dict) or ("/Kids" in node and id(node) in seen):
            continue
        own = above | {k: get(node[k]) for k in ("/MediaBox", "/CropBox", "/Rotate") if k in node}
        if "/Kids" in node:
            seen.add(id(node))
            todo += [(kid, own) for kid in reversed(get(node["/Kids"]) or [])]
            continue
        media = _box(own.get("/MediaBox"), get) or (0.0, 0.0, 612.0, 792.0)
        crop = _box(own.get("/CropBox"), get) or media
        left, low, right, high = max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])
        size = (max(right - left, 0.0), max(high - low, 0.0))
        rotate = int(own.get("/Rotate") or 0)
        width, height = size[::-1] if rotate % 180 == 90 else size
        page = {"width": width, "height": height, "box": (left, low, right, high), "rotate": rotate}
        if contents:
            page["streams"] = [x for x in _streams(node.get("/Contents"), get) if isinstance(x, dict) and "#stream" in x]
        found.append(page)
    return found


def _streams(item: object, get) -> list:
    item = get(item)
    return [get(x) for x in item] if isinstance(item, list) else [item]


def _box(item: object, get) -> tuple[float, float, float, float] | None:
    numbers = [get(x) for x in item] if isinstance(item, list) else []
    if len(numbers) != 4 or not all(isinstance(x, float) for x in numbers):
        return None
    a, b, c, d = numbers
    return min(a, c), min(b, d), max(a, c), max(b, d)
