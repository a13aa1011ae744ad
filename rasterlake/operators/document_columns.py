"""SVG, PDF and JPEG 2000 operators as Column functions over Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import limits as L
from ..sources import jp2, pdf, raster, svg
from .tiff_columns import struct_udf


def minify_svg(content: Column, **options) -> Column:
    """Struct (content, error) of a minified document."""
    return struct_udf(lambda data: {"content": svg.minify(bytes(data), **options)}, "content binary")(F.struct(content))


def svg_size(content: Column, max_bytes: int | None = None) -> Column:
    """Struct (width, height, error) of a document's own size."""
    return struct_udf(lambda data: dict(zip(("width", "height"), svg.size(bytes(data), max_bytes), strict=True)), "width double, height double")(F.struct(content))


def jp2_info(content: Column) -> Column:
    """Struct of what the headers tell."""
    fields = "width bigint, height bigint, components int, bits int, alpha boolean, color string, icc binary, descriptor string, probe_descriptor string"
    return struct_udf(lambda data: jp2.info(bytes(data)), fields)(F.struct(content))


def _sizes(data: bytes) -> dict:
    found = [{"page": i, "width": w, "height": h} for i, (w, h) in enumerate(pdf.pages(data))]
    return {"page_count": len(found), "pages": found}


def pdf_info(content: Column) -> Column:
    """Struct (page_count, pages, error) of a document."""
    return struct_udf(lambda data: _sizes(bytes(data)), "page_count int, pages array<struct<page: int, width: float, height: float>>")(F.struct(content))


def pdf_pages(df: DataFrame, content: str = "content") -> DataFrame:
    """One row a page: the other columns and the struct ``page`` (page, width, height)."""
    return df.withColumn("page", F.explode(pdf_info(F.col(content))["pages"]))


RASTER = "width int, height int, descriptor string, pixels binary"


def _raster(pixels) -> dict:
    return {"width": pixels.shape[1], "height": pixels.shape[0], "descriptor": "rgba_u8", "pixels": pixels.tobytes()}


def render_svg(df: DataFrame, content: str = "content", tw: Column | None = None, th: Column | None = None, fit: str = "original", scale: float = 1.0, background: tuple[int, int, int, int] = (0, 0, 0, 0), max_px: int = L.DEFAULT_LIMITS["max_pixels"], into: str = "raster") -> DataFrame:
    """``df`` with the struct ``raster`` (width, height, descriptor, pixels, error) of each document; limits are checked before anything is painted."""
    none = F.lit(None).cast("int")
    own = df.withColumn("_size", svg_size(F.col(content)))
    w, h = L.svg_size(F.col("_size.width"), F.col("_size.height"), none if tw is None else tw, none if th is None else th, F.lit(fit), F.lit(scale))
    own = own.withColumns({"_w": w, "_h": h})
    wrong = F.coalesce("_size.error.kind", F.when((F.col("_w") < 1) | (F.col("_h") < 1), "ZeroOutputDimensions"), F.when(L.product(F.col("_w"), F.col("_h")) > max_px, "LimitExceeded"))
    own = own.withColumn("_wrong", wrong)

    def work(data, width, height, wrong) -> dict:
        if wrong:
            raise svg.SourceError(wrong, "before rendering")
        return _raster(raster.render_svg(bytes(data), int(width), int(height), background))

    made = struct_udf(work, RASTER)(F.struct(F.col(content).alias("c0"), F.col("_w").alias("c1"), F.col("_h").alias("c2"), F.col("_wrong").alias("c3")))
    return own.withColumn(into, made).drop("_size", "_w", "_h", "_wrong")


def render_pages(df: DataFrame, selection: Column, kind: Column, a: Column, b: Column, content: str = "content", background: tuple[int, int, int, int] = (255, 255, 255, 255), max_px: int = L.DEFAULT_LIMITS["max_pixels"], into: str = "raster") -> DataFrame:
    """One row a selected page: the other columns, ``page`` and the struct ``raster`` (width, height, descriptor, pixels, error).

    ``selection`` is an array of page numbers, null where one is out of range (one row with page
    null and PageOutOfRange); ``kind``, ``a`` and ``b`` are the bounds of the raster. Documents that
    can't be read, or of which more than 1,000 pages are asked for, give one such row too.
    """
    own = df.withColumns({"_info": pdf_info(F.col(content)), "_kind": kind, "_a": a, "_b": b})
    own = own.withColumn("_pages", selection)
    wrong = F.coalesce("_info.error.kind", F.when(F.col("_pages").isNull(), "PageOutOfRange"), L.too_many_pages(F.col("_pages")))
    own = own.withColumn("_wrong", wrong).withColumn("page", F.explode(F.when(F.col("_wrong").isNull(), F.col("_pages")).otherwise(F.array(F.lit(None).cast("int")))))
    own = own.withColumn("_page", F.get("_info.pages", F.col("page")))
    w, h = L.pdf_size(F.col("_page.width"), F.col("_page.height"), F.col("_kind"), F.col("_a"), F.col("_b"))
    own = own.withColumns({"_w": w, "_h": h})
    verdict = L.pdf_verdict(F.col("_page.width"), F.col("_page.height"), F.col("_w"), F.col("_h"), F.lit(max_px), F.col("_a"))
    own = own.withColumn("_wrong", F.coalesce("_wrong", verdict))
    read: dict[bytes, list] = {}

    def work(data, page, width, height, wrong) -> dict:
        if wrong:
            raise svg.SourceError(wrong, "before rendering")
        data = bytes(data)
        if data not in read:  # the pages of a document come one after another
            read.clear()
            read[data] = pdf.page_nodes(data, contents=True)
        return _raster(raster.render_page(data, read[data][int(page)], int(width), int(height), background))

    made = struct_udf(work, RASTER)(F.struct(*[F.col(x).alias(f"c{i}") for i, x in enumerate((content, "page", "_w", "_h", "_wrong"))]))
    return own.withColumn(into, made).drop("_info", "_kind", "_a", "_b", "_pages", "_wrong", "_page", "_w", "_h")
