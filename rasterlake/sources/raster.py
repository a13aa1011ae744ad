"""Rasters of SVG documents and PDF pages whose marks are solid upright rectangles.

Whatever else paints (text, paths, strokes, images, shadings, clips, slanted axes, opacity) is an
``UnsupportedFeature``, never left out in silence. Sizes are computed as columns and given.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

from . import pdf, svg
from .tiff import TiffError as SourceError
from .tiff import turn

#: Colour names.
COLOURS = {"black": "000000", "silver": "c0c0c0", "gray": "808080", "white": "ffffff", "maroon": "800000", "red": "ff0000", "purple": "800080", "fuchsia": "ff00ff", "green": "008000", "lime": "00ff00", "olive": "808000", "yellow": "ffff00", "navy": "000080", "blue": "0000ff", "teal": "008080", "aqua": "00ffff"}
Colour = tuple[float, float, float]
Box = tuple[float, float, float, float]


class Canvas:
    """Premultiplied RGBA bytes."""

    def __init__(self, width: int, height: int, background: tuple[int, int, int, int]) -> None:
        r, g, b, a = background
        self.pixels = np.empty((height, width, 4), np.uint8)
        self.pixels[:] = [(c * a + 127) // 255 for c in (r, g, b)] + [a]

    def fill(self, box: Box, colour: Colour) -> None:
        """Paint a rectangle (left, top, right, bottom); pixels that it covers in part get that part of the colour."""
        height, width = self.pixels.shape[:2]
        left, top, right, bottom = box
        x = np.arange(max(0, int(np.floor(left))), min(width, int(np.ceil(right))))
        y = np.arange(max(0, int(np.floor(top))), min(height, int(np.ceil(bottom))))
        if not x.size or not y.size:
            return
        across = np.minimum(x + 1, right) - np.maximum(x, left)
        down = np.minimum(y + 1, bottom) - np.maximum(y, top)
        share = np.outer(down, across)[:, :, None]
        part = self.pixels[y[0] : y[-1] + 1, x[0] : x[-1] + 1]
        part[:] = np.floor(part * (1 - share) + np.array([*colour, 1.0]) * 255 * share + 0.5).astype(np.uint8)

    def rgba(self) -> np.ndarray:
        """Bytes that aren't premultiplied."""
        alpha = self.pixels[:, :, 3:].astype(np.uint32)
        if (alpha == 255).all():
            return self.pixels
        plain = np.minimum(255, (self.pixels[:, :, :3] * np.uint32(255) + alpha // 2) // np.maximum(alpha, 1))
        return np.concatenate([np.where(alpha == 0, 0, plain), alpha], axis=2).astype(np.uint8)


def _colour(text: str) -> Colour | None:
    """A fill, or None for none."""
    text = text.strip().lower()
    if text == "none":
        return None
    digits = COLOURS.get(text, text.removeprefix("#") if text.startswith("#") else "")
    digits = "".join(2 * c for c in digits) if len(digits) == 3 else digits
    if not re.fullmatch("[0-9a-f]{6}", digits):
        raise SourceError("UnsupportedFeature", f"fill {text}")
    return tuple(int(digits[i : i + 2], 16) / 255 for i in (0, 2, 4))


#: Attributes that change nothing here.
_PLAIN = {"x", "y", "width", "height", "fill", "id", "viewBox", "version", "xmlns"}


def render_svg(data: bytes, width: int, height: int, background: tuple[int, int, int, int] = (0, 0, 0, 0), max_bytes: int | None = None) -> np.ndarray:
    """The document on ``width`` x ``height`` pixels (height, width, RGBA)."""
    own = svg.size(data, max_bytes)
    text = svg.expand(data, max_bytes).decode("utf-8", "replace")
    canvas, fills, skipped, axes = Canvas(width, height, background), ["black"], 0, None
    for match in svg.TOKEN.finditer(text):
        token = match[0]
        if not re.match(r"</?[A-Za-z_]", token):
            continue
        if token.startswith("</"):
            skipped = max(0, skipped - 1)
            fills = fills if skipped or len(fills) == 1 else fills[:-1]
            continue
        closed, name = token.endswith("/>"), svg._local(token)
        if skipped or name in svg.DROPPED:
            skipped += not closed
            fills = fills if closed or skipped > 1 else [*fills, fills[-1]]
            continue
        attributes = {k: a or b for k, a, b in re.findall(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", token)}
        odd = [k for k in attributes if k not in _PLAIN and not k.startswith("xmlns:")]
        if name not in ("svg", "g", "rect") or odd or (name == "svg" and axes is not None):
            raise SourceError("UnsupportedFeature", f"{name} {' '.join(odd)}".strip())
        if axes is None:
            axes = _axes(attributes.get("viewBox"), own, width, height)
        fill = attributes.get("fill", fills[-1])
        if name == "rect" and (colour := _colour(fill)) is not None:
            x, y, w, h = (_length(attributes.get(k, "0")) for k in ("x", "y", "width", "height"))
            sx, sy, dx, dy = axes
            if w > 0 and h > 0:
                canvas.fill((x * sx + dx, y * sy + dy, (x + w) * sx + dx, (y + h) * sy + dy), colour)
        if not closed:
            fills.append(fill)
    return canvas.rgba()


def _length(text: str) -> float:
    match = re.fullmatch(r"\s*([-+]?[\d.]+(?:e[-+]?\d+)?)\s*([a-z]*)\s*", text)
    if not match or match[2] not in svg.UNITS:
        raise SourceError("UnsupportedFeature", f"length {text}")
    return float(match[1]) * svg.UNITS[match[2]]


def _axes(box: str | None, own: tuple[float, float], width: int, height: int) -> tuple[float, float, float, float]:
    """Scales and shifts from user units to pixels: a view box is fitted into the middle of the document."""
    zx, zy = width / own[0], height / own[1]
    numbers = [float(x) for x in re.findall(r"[-+.\deE]+", box or "")]
    if len(numbers) != 4 or numbers[2] <= 0 or numbers[3] <= 0:
        return zx, zy, 0.0, 0.0
    scale = min(own[0] / numbers[2], own[1] / numbers[3])
    dx, dy = (own[0] - numbers[2] * scale) / 2 - numbers[0] * scale, (own[1] - numbers[3] * scale) / 2 - numbers[1] * scale
    return scale * zx, scale * zy, dx * zx, dy * zy


#: Operators of a page that paint nothing and move nothing: of strokes, which aren't painted either, and marks.
_IGNORED = {"w", "J", "j", "M", "d", "i", "ri", "G", "RG", "K", "BMC", "BDC", "EMC", "MP", "DP"}


_END = re.compile(rb"[\s\0]*(?:%[^\r\n]*[\s\0]*)*\Z")


def rectangles(content: bytes) -> list[tuple[Box, Colour]]:
    """Filled rectangles (left, low, right, high) of a page's content, in points."""
    scale, colour, kept, path, operands, out = (1.0, 1.0, 0.0, 0.0), (0.0, 0.0, 0.0), [], [], [], []
    at = 0
    while not _END.match(content, at):
        item, at = pdf.value(content, at)
        if not isinstance(item, bytes) or item[:1] in b"(<":
            operands.append(item)
            continue
        name = item.decode("latin-1")
        numbers = [x for x in operands if isinstance(x, float)]
        if name == "q":
            kept.append((scale, colour))
        elif name == "Q" and kept:
            scale, colour = kept.pop()
        elif name == "cm" and len(numbers) == 6 and numbers[1] == numbers[2] == 0:
            sx, sy, dx, dy = scale
            scale = sx * numbers[0], sy * numbers[3], sx * numbers[4] + dx, sy * numbers[5] + dy
        elif name == "re" and len(numbers) == 4:
            x, y, w, h = numbers
            sx, sy, dx, dy = scale
            xs, ys = sorted((x * sx + dx, (x + w) * sx + dx)), sorted((y * sy + dy, (y + h) * sy + dy))
            path.append((xs[0], ys[0], xs[1], ys[1]))
        elif name in ("f", "F", "f*"):
            out += [(box, colour) for box in path]
            path = []
        elif name == "n":
            path = []
        elif name in ("g", "rg", "k") and len(numbers) == {"g": 1, "rg": 3, "k": 4}[name]:
            level = [min(1.0, max(0.0, v)) for v in numbers]
            colour = tuple(level * 3) if name == "g" else tuple(level) if name == "rg" else tuple((1 - v) * (1 - level[3]) for v in level[:3])
        elif name not in _IGNORED:
            raise SourceError("UnsupportedFeature", f"operator {name}")
        operands = []
    return out


def render_page(data: bytes, page: dict, width: int, height: int, background: tuple[int, int, int, int] = (255, 255, 255, 255)) -> np.ndarray:
    """A page of :func:`pdf.page_nodes` (with contents) on ``width`` x ``height`` pixels (height, width, RGBA)."""
    turned = page["rotate"] % 360
    w, h = (height, width) if turned % 180 == 90 else (width, height)
    canvas = Canvas(w, h, background)
    left, low, right, high = page["box"]
    sx, sy = w / (right - left), h / (high - low)
    content = b"\n".join(stream(data, item) for item in page["streams"])
    for (x0, y0, x1, y1), colour in rectangles(content):
        canvas.fill(((x0 - left) * sx, (high - y1) * sy, (x1 - left) * sx, (high - y0) * sy), colour)
    return turn(canvas.rgba(), {90: 6, 180: 3, 270: 8}.get(turned, 1))


def stream(data: bytes, item: dict) -> bytes:
    """Content of a stream object, plain or deflated."""
    start, stop = item["#stream"]
    body = data[start:stop]
    filters = item.get("/Filter")
    if filters in ("/FlateDecode", ["/FlateDecode"]):
        try:
            return zlib.decompressobj().decompress(body, pdf.MAX_STREAM)
        except zlib.error as error:
            raise SourceError("Malformed", str(error)) from None
    if filters:
        raise SourceError("UnsupportedFeature", f"filter {filters}")
    return body
