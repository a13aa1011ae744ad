"""Sniffing, descriptors, limits, geometry and sample conversion as Column functions.

Widths and products are bigint, geometry is float (quotients are cast back), and each
limit function gives the name of the first violated limit or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dimensions import FNV_PRIME, FNV_START

f32 = lambda c: c.cast("float")
LARGEST = (1 << 63) - 1
#: Decode limits where none are asked for; no size limit of a side.
DEFAULT_LIMITS = {"max_pixels": 120_000_000, "max_memory": 4 << 30, "max_width": None, "max_height": None}
#: Largest buffers of a strip or tile, decoded and in between; pages of one call.
DECODE_BUFFER, MIDDLE_BUFFER, MAX_PAGES = 256 << 20, 128 << 20, 1000


def product(*factors: Column) -> Column:
    """Product of non-negative whole numbers as bigint, the largest bigint where it is larger; null with a null factor."""
    # One fold, so that each factor stands in the plan once; no factor is negative, so a product that overflows stays beyond.
    step = lambda out, factor: F.when(out.isNotNull() & factor.isNotNull(), F.coalesce(F.try_multiply(out, factor), F.lit(LARGEST)))
    return F.aggregate(F.array(*[f.cast("bigint") for f in factors]), F.lit(1).cast("bigint"), step)


def total(value: Column, more: int) -> Column:
    """``value`` and a constant, saturating as :func:`product` does."""
    return F.when(value.isNotNull(), F.coalesce(F.try_add(value, F.lit(more).cast("bigint")), F.lit(LARGEST)))


def effective_limits(asked: Column) -> Column:
    """Struct of the decode limits: those asked for (a struct whose fields may be null), else the defaults."""
    return F.struct(*[F.coalesce(asked[name].cast("bigint"), F.lit(value).cast("bigint")).alias(name) for name, value in DEFAULT_LIMITS.items()])


def tightened_buffers(max_memory: Column) -> Column:
    """Struct (decoding, intermediate): the inner buffers' sizes, tightened to a memory limit and never loosened."""
    return F.struct(F.least(F.lit(DECODE_BUFFER), max_memory).cast("bigint").alias("decoding"), F.least(F.lit(MIDDLE_BUFFER), max_memory).cast("bigint").alias("intermediate"))


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def first_violation(*checks: tuple[str, Column]) -> Column:
    """Name of the first check that holds, else null."""
    out = None
    for name, condition in checks:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out


def is_svg(content: Column) -> Column:
    """gzip, or an SVG or XML start within the first 256 bytes after BOM and white space."""
    head = F.decode(F.substring(content, 1, 256), "ISO-8859-1")
    body = F.lower(F.regexp_replace(F.regexp_replace(head, "^ï»¿", ""), r"^[ \t\n\f\r]+", ""))
    start = body.startswith("<svg") | body.startswith("<?xml") | body.startswith("<!doctype svg")
    return (F.hex(F.substring(content, 1, 2)) == "1F8B") | start | F.contains(body, F.lit("<svg"))


def is_pdf(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 5)) == "255044462D"


def is_jp2(content: Column) -> Column:
    return (F.hex(F.substring(content, 1, 8)) == "0000000C6A502020") | (F.hex(F.substring(content, 1, 4)) == "FF4FFF51")


def is_tiff(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)).isin("49492A00", "4D4D002A", "49492B00", "4D4D002B")


def sniff(content: Column) -> Column:
    """tiff, jp2, pdf, svg or null."""
    return F.when(is_tiff(content), "tiff").when(is_jp2(content), "jp2").when(is_pdf(content), "pdf").when(is_svg(content), "svg")


def dpi(unit: Column, num: Column, den: Column) -> Column:
    """Dots per inch of one axis; null unless the unit is inch (2) or centimetre (3)."""
    value = F.try_divide(num.cast("double"), den.cast("double"))
    return F.when(unit == 2, value).when(unit == 3, value * 2.54)


def output_channels(color: Column, samples: Column) -> Column:
    """Channels of the limit check."""
    return F.when(color.isin("cmyk", "cmyka"), 4).when(color == "palette", 3).when((color == "multiband") & (samples == 2), 2).otherwise(samples).cast("bigint")


def sample_bytes(bits: Column) -> Column:
    return F.when(bits <= 8, 1).when(bits <= 16, 2).when(bits <= 32, 4).otherwise(8).cast("bigint")


def peak_factor(color: Column, bits: Column) -> Column:
    return F.when((bits == 8) & color.isin("gray", "graya", "rgb", "rgba"), 1).otherwise(2).cast("bigint")


def decode_limits(w: Column, h: Column, bpp: Column, factor: Column, max_w: Column, max_h: Column, max_px: Column, max_mem: Column) -> Column:
    """TIFF decode: width, height, pixels, then peak memory of factor x output plus 512 KiB."""
    px = product(w, h)
    return first_violation(("width", w > max_w), ("height", h > max_h), ("pixels", px > max_px), ("memory", total(product(px, bpp, factor), 524288) > max_mem))


def encode_limits(w: Column, h: Column, bpp: Column, max_w: Column, max_h: Column, max_px: Column, max_mem: Column) -> Column:
    """TIFF encode: pixels, width, height, memory."""
    px = product(w, h)
    return first_violation(("pixels", px > max_px), ("width", w > max_w), ("height", h > max_h), ("memory", product(px, bpp) > max_mem))


def raster_limits(w: Column, h: Column, max_w: Column, max_h: Column, max_px: Column, max_mem: Column | None = None) -> Column:
    """SVG and JPEG 2000 output: width, height, pixels and, where given, memory of four bytes a pixel."""
    px = product(w, h)
    checks = [("width", w > max_w), ("height", h > max_h), ("pixels", px > max_px)]
    return first_violation(*checks, *([] if max_mem is None else [("memory", product(px, F.lit(4)) > max_mem)]))


def input_gate(length: Column, max_input: Column) -> Column:
    """``InputSize`` where a file is larger than allowed, else null."""
    return F.when(length > max_input, "InputSize")


def has_alpha(color: Column, samples: Column) -> Column:
    return color.isin("graya", "rgba", "cmyka") | ((color == "multiband") & samples.isin(2, 4))


def descriptor(color: Column, bits: Column, is_float: Column, samples: Column) -> Column:
    """Layout and sample type that a source decodes to."""
    bands = F.when(samples == 1, "gray").when(samples == 2, "graya").when(samples == 3, "rgb").otherwise("rgba")
    layout = F.when(color == "gray", "gray").when(color == "graya", "graya").when(color.isin("rgb", "ycbcr", "lab", "palette"), "rgb").when(color == "multiband", bands).otherwise("rgba")
    sample = F.when((bits <= 8) | (color == "palette"), "u8").when(is_float, "f32").otherwise("u16")
    return F.concat(layout, F.lit("_"), sample)


def svg_size(w: Column, h: Column, tw: Column, th: Column, fit: Column, scale: Column) -> tuple[Column, Column]:
    """Raster size; tw and th may be null. Contain and original take the smaller ratio."""
    w, h, scale = f32(w), f32(h), f32(scale)
    rx, ry = f32(f32(tw) / w), f32(f32(th) / h)
    low, high = f32(F.least(rx, ry) * scale), f32(F.greatest(rx, ry) * scale)
    both = tw.isNotNull() & th.isNotNull()
    sx = F.when(both & (fit == "fill"), f32(rx * scale)).when(both & (fit == "cover"), high).when(both, low).when(tw.isNotNull(), f32(rx * scale)).when(th.isNotNull(), f32(ry * scale)).otherwise(scale)
    sy = F.when(both & (fit == "fill"), f32(ry * scale)).otherwise(sx)
    return F.ceil(f32(w * sx)).cast("bigint"), F.ceil(f32(h * sy)).cast("bigint")


def pdf_scale(pw: Column, ph: Column, kind: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Horizontal and vertical scale of a page for render bounds; null for a page of no size."""
    over = lambda x, y: f32(F.try_divide(f32(x), f32(y)))
    x, y = over(a, pw), over(b, ph)
    sx = F.when(kind == "scale", f32(a)).when(kind == "dpi", f32(f32(a) / F.lit(72.0))).when(kind == "width", x).when(kind == "height", over(a, ph)).when(kind == "box", F.least(x, y)).otherwise(x)
    return sx, F.when(kind == "exact", y).otherwise(sx)


def pdf_size(pw: Column, ph: Column, kind: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Final raster size: exact as given, else rounded down."""
    sx, sy = pdf_scale(pw, ph, kind, a, b)
    w, h = F.floor(f32(f32(pw) * sx)), F.floor(f32(f32(ph) * sy))
    return F.when(kind == "exact", F.floor(a)).otherwise(w).cast("bigint"), F.when(kind == "exact", F.floor(b)).otherwise(h).cast("bigint")


def pdf_verdict(pw: Column, ph: Column, w: Column, h: Column, max_px: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """What is wrong with a page and its raster size, else null; ``a`` and ``b`` are what the bounds ask for."""
    asked = [x for x in (a, b) if x is not None]
    bad = (w < 1) | (h < 1) | w.isNull() | h.isNull()
    for x in asked:
        bad = bad | ~finite(x)
    return first_violation(
        ("ZeroDimensions", ~finite(pw) | ~finite(ph) | (pw <= 0) | (ph <= 0)),
        ("InvalidRenderBounds", bad),
        ("DimensionOverflow", (w > 65535) | (h > 65535)),
        ("PixelLimitExceeded", product(w, h) > max_px),
    )


def pdf_output_size(df: DataFrame, pw: Column, ph: Column, kind: Column, a: Column, b: Column, into: tuple[str, str, str] = ("out_w", "out_h", "error")) -> DataFrame:
    """``df`` with the width, height and error that are announced before rendering.

    A fitted side is as asked, exact sizes aren't checked. Each step is a column that the next
    one reads, so that generated code doesn't repeat it.
    """
    sx, sy = pdf_scale(pw, ph, kind, a, b)
    out = df.withColumns({"_kind": kind, "_pw": f32(pw), "_ph": f32(ph), "_sx": sx, "_sy": sy, "_a": a, "_b": b})
    c = F.col
    out = out.withColumns({"_w": F.when(c("_kind") == "width", f32(c("_a"))).otherwise(f32(c("_pw") * c("_sx"))), "_h": F.when(c("_kind") == "height", f32(c("_a"))).otherwise(f32(c("_ph") * c("_sy")))})
    page = ~finite(c("_pw")) | ~finite(c("_ph")) | (c("_pw") <= 0) | (c("_ph") <= 0)
    bad = (c("_kind") != "exact") & (~finite(c("_w")) | ~finite(c("_h")) | (c("_w") < 1) | (c("_h") < 1))
    out = out.withColumn(into[2], first_violation(("ZeroDimensions", page), ("InvalidRenderBounds", bad)))
    whole = lambda exact, side: F.when(c(into[2]).isNull(), F.floor(F.when(c("_kind") == "exact", c(exact)).otherwise(c(side))).cast("bigint"))
    return out.withColumns({into[0]: whole("_a", "_w"), into[1]: whole("_b", "_h")}).drop("_kind", "_pw", "_ph", "_sx", "_sy", "_a", "_b", "_w", "_h")


def too_many_pages(selected: Column, most: int = MAX_PAGES) -> Column:
    """``TooManyPages`` where more pages are asked for than one call renders, else null."""
    return F.when(F.size(selected) > most, "TooManyPages")


def page_clamp(start: Column, count: Column) -> Column:
    """The page that a job shows: the asked one, or the last."""
    return F.least(start, F.greatest(count - 1, F.lit(0)))


def page_indices(kind: Column, start: Column, end: Column, count: Column) -> Column:
    """Selected pages, or null where an index is out of range."""
    last = count - 1
    every = F.when(count > 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return (
        F.when(kind == "all", every)
        .when((kind == "single") & (start < count), F.array(start))
        .when((kind == "range") & (start < count) & (end < count), F.when(start <= end, F.sequence(start, F.greatest(start, end))).otherwise(F.array().cast("array<int>")))
        .when((kind == "list") & (start < count) & (end < count), F.array(start, end, start))
    )


def cmyk8(ink: Column, k: Column) -> Column:
    """One of red, green and blue of 8-bit CMYK, in float."""
    part = f32(F.lit(1.0).cast("float") - f32(f32(ink) / F.lit(255.0)))
    black = f32(F.lit(1.0).cast("float") - f32(f32(k) / F.lit(255.0)))
    return F.floor(f32(f32(f32(part * black) * F.lit(255.0).cast("float")) + F.lit(0.5).cast("float"))).cast("int")


def cmyk16(ink: Column, k: Column) -> Column:
    """As cmyk8 for 16 bits, in double."""
    return F.floor((1 - ink / F.lit(65535.0)) * (1 - k / F.lit(65535.0)) * 65535 + 0.5).cast("int")


def unpremultiply(c: Column, a: Column) -> Column:
    rounded = F.floor((c * 255 + F.floor(a / 2)) / F.when(a == 0, 1).otherwise(a))
    return F.when(a == 0, 0).when(a == 255, c).otherwise(F.least(F.lit(255), rounded)).cast("int")


def _upper(s: Column) -> Column:
    """How often 2^48 goes into a decimal, rounded down; exact beyond a bigint."""
    part = F.lit(1 << 48).cast("decimal(15,0)")
    # The quotient has six decimals and may have been rounded up to a whole number; Spark's div and pmod are exact but several times slower.
    times = F.floor(s / part).cast("bigint")
    return times - F.when(times.cast("decimal(20,0)") * part > s, 1).otherwise(0)


def narrow_signed(s: Column, bits: int, wide: bool = False) -> Column:
    """i8, i16, i32 and i64 as unsigned: offset by half the range; 32 and 64 bits keep their upper 16.

    With ``wide``, samples of 64 bits are a decimal, which may go beyond their range.
    """
    if bits == 64:
        return ((_upper(s) if wide else F.shiftright(s.cast("bigint"), 48)) + (1 << 15)).cast("int")
    moved = s.cast("bigint") + (1 << (bits - 1))
    return F.shiftright(moved, 16).cast("int") if bits == 32 else moved.cast("int")


def narrow_unsigned(s: Column, bits: int, wide: bool = False) -> Column:
    """The upper 16 of 32 bits, or of 64 bits held in a bigint or, with ``wide``, in a decimal."""
    return (_upper(s) if wide else F.shiftrightunsigned(s.cast("bigint"), bits - 16)).cast("int")


def fit_channels(samples: Column, channels: Column, largest: int) -> Column:
    """The first ``channels`` samples of a pixel, padded with ``largest`` (255 or 65,535)."""
    return F.slice(F.concat(samples, F.array_repeat(F.lit(largest), 4)), F.lit(1), channels)


def unpack_bits(byte: Column, bits: int) -> Column:
    """Samples of one byte, most significant first, scaled to 0..255 by integer division."""
    top = (1 << bits) - 1
    steps = range(8 - bits, -1, -bits)
    return F.array(*[F.floor(F.shiftright(byte.cast("int"), i).bitwiseAND(F.lit(top)) * 255 / F.lit(top)).cast("int") for i in steps])


def oriented(tag: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Size after orientation; tags beyond 1..8 change nothing."""
    swap = tag.isin(5, 6, 7, 8)
    return F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h)


def oriented_pixel(tag: Column, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Where pixel (x, y) of a w x h raster goes."""
    r, b = w - 1 - x, h - 1 - y
    to = {1: (x, y), 2: (r, y), 3: (r, b), 4: (x, b), 5: (y, x), 6: (b, x), 7: (b, r), 8: (y, r)}
    out = []
    for i in (0, 1):
        c = F.when(tag == 2, to[2][i])
        for k in range(3, 9):
            c = c.when(tag == k, to[k][i])
        out.append(c.otherwise(to[1][i]))
    return out[0], out[1]


#: Serial cost model (peak factor, largest factor, bytes on top, pixels a millisecond).
ESTIMATES = {"tiff_decode": (1, 2, 524288, 120000), "tiff_encode": (2, 4, 1048576, 200000), "svg": (4, 8, 16777216, 30000), "pdf": (4, 8, 16777216, 25000), "jp2": (2, 4, 8388608, 60000)}


def estimate(codec: Column, px: Column, out_bytes: Column) -> tuple[Column, Column, Column]:
    """Typical peak bytes, largest peak bytes, wall milliseconds."""
    typical = most = wall = None
    for name, (low, high, more, speed) in ESTIMATES.items():
        top = more * 2 if name in ("tiff_encode", "jp2") else more
        size = product(px, F.lit(4)) if name in ("svg", "pdf") else out_bytes
        pick = lambda c, v, name=name: F.when(codec == name, v) if c is None else c.when(codec == name, v)
        typical, most, wall = pick(typical, total(product(size, F.lit(low)), more)), pick(most, total(product(size, F.lit(high)), top)), pick(wall, F.floor(px / speed))
    return typical.cast("bigint"), most.cast("bigint"), wall.cast("bigint")


def fingerprint(*parts: Column) -> Column:
    """FNV-1a, 64 bits, of a few bytes (0 to 255) as 16 hexadecimal digits; null with a null byte."""
    whole = F.lit(str(1 << 64)).cast("decimal(20,0)")
    last = lambda h: F.pmod(h, F.lit(256).cast("decimal(20,0)"))
    mixed = lambda h, byte: h - last(h) + last(h).cast("int").bitwiseXOR(byte.cast("int")).cast("decimal(20,0)")
    step = lambda h, byte: F.pmod((mixed(h, byte) * F.lit(FNV_PRIME).cast("decimal(13,0)")).cast("decimal(38,0)"), whole).cast("decimal(20,0)")
    h = F.aggregate(F.array(*parts), F.lit(str(FNV_START)).cast("decimal(20,0)"), step)
    halves = lambda h: F.concat(*[F.lpad(F.hex(x.cast("bigint")), 8, "0") for x in (F.floor(h / F.lit(1 << 32).cast("decimal(20,0)")), F.pmod(h, F.lit(1 << 32).cast("decimal(20,0)")))])
    return F.lower(halves(h))


def packed_samples(content: Column, bits: Column, per_row: Column, rows: Column) -> Column:
    """Samples of 1 to 16 bits as an array of ints, most significant bit first; each row begins with a byte of its own.

    Samples may straddle bytes. Null where the bytes don't suffice or the depth is another.
    """
    stride = F.ceil(per_row * bits / 8)

    def sample(i: Column) -> Column:
        at = i % per_row * bits
        first = F.floor(i / per_row) * stride + F.floor(at / 8)
        window = F.rpad(F.hex(F.substr(content, (first + 1).cast("int"), F.lit(3))), 6, "0")
        kept = F.conv(window, 16, 10).cast("int").bitwiseAND(F.call_function("shiftright", F.lit((1 << 24) - 1), (at % 8).cast("int")))
        return F.call_function("shiftright", kept, (24 - at % 8 - bits).cast("int"))

    enough = bits.between(1, 16) & (per_row > 0) & (rows > 0) & (F.length(content) >= stride * rows)
    return F.when(enough, F.transform(F.sequence(F.lit(0), (per_row * rows - 1).cast("int")), sample))
