"""SVG text: bounded decompression, minifying, intrinsic size."""

from __future__ import annotations

import gzip
import re
import zlib

from .tiff import TiffError as SourceError

TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?:[^\[\]<>\"']|\"[^\"]*\"|'[^']*'|\[.*?\])*>|<(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*>|[^<]+", re.S)
#: Elements that carry no picture, and pixels of the length units at 96 dpi.
DROPPED = {"metadata": "metadata", "desc": "descriptions", "title": "titles"}
UNITS = {"": 1.0, "px": 1.0, "in": 96.0, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "pt": 96 / 72, "pc": 16.0}
DEFAULTS = {"comments": True, "instructions": True, "metadata": True, "descriptions": True, "titles": True, "whitespace": True, "compress": False, "level": 6, "max_bytes": None}
MAX_COMPRESSION = DEFAULTS | {"compress": True, "level": 9}


def expand(data: bytes, max_bytes: int | None = None) -> bytes:
    """Plain bytes; no more than one byte beyond the limit is ever inflated."""
    if max_bytes is not None and len(data) > max_bytes:
        raise SourceError("InputSize", f"{len(data)} bytes")
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        stream = zlib.decompressobj(31)
        out = stream.decompress(data, 0 if max_bytes is None else max_bytes + 1)
    except zlib.error as error:
        raise SourceError("Parse", str(error)) from None
    if max_bytes is not None and len(out) > max_bytes:
        raise SourceError("DecompressionBomb", f"more than {max_bytes} bytes")
    if not stream.eof:
        raise SourceError("Parse", "cut gzip stream")
    return out


def _local(token: str) -> str:
    return re.match(r"</?\s*([^\s/>]*)", token)[1].rpartition(":")[2]


def minify(data: bytes, **options) -> bytes:
    """The document without what the options drop; everything else is kept as written.

    Subtrees go, self-closing elements of the same names stay. Text is trimmed at both
    ends; runs of white space inside stay.
    """
    o = DEFAULTS | options
    text = expand(data, o["max_bytes"]).decode("utf-8", "replace")
    out, open_names, skipped, at = [], [], 0, 0
    while at < len(text):
        found = TOKEN.match(text, at)
        if not found:
            raise SourceError("Parse", f"byte {len(text[:at].encode())}")
        token, start, at = found[0], at, found.end()
        if token.startswith("<!--"):
            keep = not o["comments"]
        elif token.startswith("<?"):
            keep = not o["instructions"] or re.match(r"<\?xml\s", token) is not None
        elif token.startswith("<!"):
            keep = True
        elif token.startswith("</"):
            name = token[2:-1].strip()
            if not open_names or open_names.pop() != name:
                raise SourceError("Parse", f"byte {len(text[:start].encode())}")
            keep = True
            if skipped and len(open_names) < skipped:
                skipped, keep = 0, False
        elif token.startswith("<"):
            keep = True
            if not token.endswith("/>"):
                open_names.append(re.match(r"<([^\s/>]*)", token)[1])
                if not skipped and o.get(DROPPED.get(_local(token), ""), False):
                    skipped = len(open_names)
        else:
            token, keep = token.strip(" \t\r\n") if o["whitespace"] else token, True
        if keep and not skipped:
            out.append(token)
    if open_names:
        raise SourceError("Parse", "open elements at the end")
    plain = "".join(out).encode()
    return gzip.compress(plain, o["level"], mtime=0) if o["compress"] else plain


def size(data: bytes, max_bytes: int | None = None) -> tuple[float, float]:
    """Width and height of the root: attributes, percentages of the view box, or the view box."""
    text = expand(data, max_bytes).decode("utf-8", "replace")
    root = next((t[0] for t in TOKEN.finditer(text) if re.match(r"<[A-Za-z_]", t[0])), None)
    if root is None or _local(root) != "svg":
        raise SourceError("Parse", "no svg element")
    attributes = {k: a or b for k, a, b in re.findall(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", root)}
    numbers = re.findall(r"[-+.\deE]+", attributes.get("viewBox", ""))
    box = [float(x) for x in numbers] if len(numbers) == 4 else None
    found = []
    for name, side in (("width", 2), ("height", 3)):
        match = re.fullmatch(r"\s*([-+]?[\d.]+(?:e[-+]?\d+)?)\s*(%|[a-z]*)\s*", attributes.get(name, "100%"))
        if match and match[2] in UNITS:
            found.append(float(match[1]) * UNITS[match[2]])
        elif match and match[2] == "%" and box:
            found.append(float(match[1]) / 100 * box[side])
        else:
            raise SourceError("Parse", f"no {name}")
    if not (found[0] > 0 and found[1] > 0):
        raise SourceError("Parse", "zero size")
    return found[0], found[1]
