"""Info and output-info projections of the formats, and the gates of an encode job, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import limits as L
from .pixels import apply_policy, resolve_orientation


def _known(orientation: Column) -> Column:
    return F.when(orientation.between(1, 8), orientation).otherwise(1).cast("int")


def generic_info(info: Column) -> Column:
    """A TIFF probe as the struct that all formats share; IPTC isn't in it.

    Resolutions are in the file's own unit; page_count is null for a single page.
    """
    centimetres = info["resolution_unit"] == 3
    own = lambda c: F.when(centimetres, c / 2.54).otherwise(c)
    several = info["page_count"] > 1
    return F.when(
        info["width"].isNotNull(),
        F.struct(
            info["width"].cast("bigint").alias("width"),
            info["height"].cast("bigint").alias("height"),
            L.has_alpha(info["color"], info["samples"]).alias("alpha"),
            _known(info["orientation"]).alias("orientation"),
            info["bits"].alias("bit_depth"),
            info["samples"].alias("channels"),
            F.when(several, info["page_count"]).alias("page_count"),
            F.coalesce(several, F.lit(False)).alias("random_access"),
            own(info["dpi_x"]).alias("resolution_x"),
            own(info["dpi_y"]).alias("resolution_y"),
            F.when(info["dpi_x"].isNotNull(), F.when(centimetres, "cm").otherwise("inch")).alias("resolution_unit"),
            info["icc"].alias("icc"),
            info["exif"].alias("exif"),
            info["xmp"].alias("xmp"),
            F.lit(True).alias("lossless"),
        ),
    )


def job_probe(info: Column, hint: Column, asked: Column, **policy: bool) -> Column:
    """:func:`generic_info` as a job reports it: sizes after an orientation that it bakes (then 1), what the policy forbids null."""
    found = generic_info(info)
    done = resolve_orientation(hint, found["orientation"], asked)
    w, h = L.oriented(done, found["width"], found["height"])
    baked = hint != "preserve"
    found = found.withField("width", w).withField("height", h).withField("orientation", F.when(baked, 1).otherwise(found["orientation"]).cast("int"))
    return F.when(info["width"].isNotNull(), apply_policy(found, **policy))


def tiff_output_info(info: Column, hint: Column, asked: Column) -> Column:
    """Struct (width, height, descriptor, alpha, orientation): what decoding a TIFF would give, and the orientation it applies."""
    applied = resolve_orientation(hint, _known(info["orientation"]), asked)
    w, h = L.oriented(applied, info["width"], info["height"])
    kind = L.descriptor(info["color"], info["bits"], info["is_float"], info["samples"])
    return F.when(info["width"].isNotNull(), F.struct(w.cast("bigint").alias("width"), h.cast("bigint").alias("height"), kind.alias("descriptor"), L.has_alpha(info["color"], info["samples"]).alias("alpha"), applied.cast("int").alias("orientation")))


def svg_info(svg: Column, size: Column, tw: Column, th: Column, fit: Column, scale: Column) -> Column:
    """Struct of an SVG probe: ``svg`` tells whether the file was sniffed as one, ``size`` is its own size (width, height, error).

    Give a true literal as ``svg`` for the full probe, which doesn't sniff.
    """
    w, h = L.svg_size(size["width"], size["height"], tw, th, fit, scale)
    error = F.when(~svg, "NotSvg").otherwise(F.coalesce(size["error"]["kind"], F.when((w < 1) | (h < 1), "ZeroOutputDimensions")))
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(good(w).alias("width"), good(h).alias("height"), good(F.lit(True)).alias("alpha"), good(F.lit(8)).alias("bit_depth"), good(F.lit(4)).alias("channels"), good(F.lit("srgb")).alias("color"), good(F.lit("rgba_u8")).alias("descriptor"), error.alias("error"))


def pdf_probe(info: Column, length: Column, max_input: Column, max_w: Column, max_h: Column, max_px: Column) -> Column:
    """Struct of a PDF probe: the first page's points as whole numbers (0 x 0 without pages), the number of pages, the first failed check."""
    first = F.get(info["pages"], F.lit(0))
    side = lambda name: F.coalesce(F.floor(first[name]).cast("bigint"), F.lit(0).cast("bigint"))
    w, h = side("width"), side("height")
    error = F.coalesce(L.input_gate(length, max_input), info["error"]["kind"], L.raster_limits(w, h, max_w, max_h, max_px))
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(good(w).alias("width"), good(h).alias("height"), good(F.lit(True)).alias("alpha"), good(info["page_count"]).alias("page_count"), good(F.lit(True)).alias("random_access"), error.alias("error"))


def pdf_output_info(df: DataFrame, info: Column, length: Column, start: Column, kind: Column, a: Column, b: Column, max_input: Column, max_w: Column, max_h: Column, max_px: Column, into: str = "output") -> DataFrame:
    """``df`` with a struct (page, width, height, descriptor, error): the page that a job shows and its announced size."""
    c = F.col
    out = df.withColumns({"_page": L.page_clamp(start, info["page_count"]), "_length": length, "_in": max_input, "_maxw": max_w, "_maxh": max_h, "_maxp": max_px})
    out = out.withColumn("_shown", F.get(info["pages"], c("_page")))
    side = lambda name: F.coalesce(c("_shown")[name], F.lit(0.0).cast("float"))
    out = L.pdf_output_size(out, side("width"), side("height"), kind, a, b, ("_width", "_height", "_wrong"))
    error = F.coalesce(L.input_gate(c("_length"), c("_in")), info["error"]["kind"], c("_wrong"), L.raster_limits(c("_width"), c("_height"), c("_maxw"), c("_maxh"), c("_maxp")))
    out = out.withColumn("_error", error)
    good = lambda value, name: F.when(c("_error").isNull(), value).alias(name)
    made = F.struct(good(c("_page"), "page"), good(c("_width"), "width"), good(c("_height"), "height"), good(F.lit("rgba_u8"), "descriptor"), c("_error").alias("error"))
    return out.withColumn(into, made).drop("_page", "_length", "_in", "_maxw", "_maxh", "_maxp", "_shown", "_width", "_height", "_wrong", "_error")


def lower_metadata(meta: Column, icc: bool = True, exif: bool = True, xmp: bool = True, profiles: dict[tuple[int, int], bytes] | None = None) -> Column:
    """What an encode job writes of a struct (icc, exif, xmp, orientation): gates by kind; an upright image has no orientation tag.

    With ``profiles``, the struct has cicp (primaries, transfer) as well: a source without a
    profile that is described by colour codes alone gets the profile of both codes, as TIFF has no
    place for them. Codes without one, such as those of sRGB, which is what readers assume, give none:
    a profile of the same primaries and another transfer would be wrong.
    """
    gate = lambda name, allowed: (meta[name] if allowed else F.lit(None).cast("binary")).alias(name)
    own = gate("icc", icc)
    if icc and profiles:
        codes = meta["cicp"]
        made = [F.when((codes["primaries"] == p) & (codes["transfer"] == t), F.lit(profile)) for (p, t), profile in profiles.items()]
        own = F.coalesce(meta["icc"], *made).alias("icc")
    turned = F.when(meta["orientation"].between(2, 8), meta["orientation"].cast("int")).alias("orientation")
    return F.struct(own, gate("exif", exif), gate("xmp", xmp), turned)


def nothing_to_write(meta: Column) -> Column:
    """Whether lowered metadata is empty, so that a plain file is written."""
    return meta["icc"].isNull() & meta["exif"].isNull() & meta["xmp"].isNull() & meta["orientation"].isNull()


def appended(buffer: Column, encoded: Column) -> Column:
    """``encoded`` behind ``buffer``; a null buffer is empty."""
    return F.concat(F.coalesce(buffer, F.lit(b"")), encoded)


def pixel_rows(width: Column, height: Column, pixels: Column, channels: Column, sample_size: Column) -> Column:
    """Array of structs (y, row), one for each line of a raster; explode it to push rows to a sink."""
    stride = (width * channels * sample_size).cast("int")
    line = lambda y: F.struct(y.alias("y"), F.call_function("substring", pixels, y * stride + 1, stride).alias("row"))
    return F.transform(F.sequence(F.lit(0), height.cast("int") - 1), line)
