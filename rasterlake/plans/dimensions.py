"""Small fixed tables: formats, capabilities, error categories, TIFF tags, orientation products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Format, default extension, extensions, mime type, alpha, animation, lossless, lossy, bytes needed.
FORMATS = [
    ("svg", "svg", "svg,svgz", "image/svg+xml", True, False, True, False, 256),
    ("pdf", "pdf", "pdf", "application/pdf", True, False, True, True, 10),
    ("tiff", "tiff", "tif,tiff", "image/tiff", True, False, True, True, 4),
    ("jp2", "jp2", "jp2,j2k", "image/jp2", True, False, True, True, 12),
]
FORMAT_COLUMNS = "format string, extension string, extensions string, mime string, alpha boolean, animation boolean, lossless boolean, lossy boolean, bytes_needed int"

#: Operation and its flags.
CAPABILITIES = [
    ("tiff_decode", "cheap_probe,icc,exif,xmp,stop,gray,bits16,f32,alpha,hdr,multi_image,max_pixels,max_memory"),
    ("tiff_encode", "icc,exif,xmp,stop,gray,bits16,f32,alpha,lossless,max_pixels"),
    ("svg", "cheap_probe,stop,alpha,max_pixels,max_memory,max_input"),
    ("pdf", "cheap_probe,alpha,max_pixels,max_input"),
    ("jp2", "cheap_probe,icc,gray,alpha,max_pixels,max_memory"),
]

#: Codec, variant, who is at fault, what kind.
ERRORS = [
    tuple(row.split("|"))
    for row in """
tiff|Decode|Image|Malformed
tiff|Encode|Internal|Dependency
tiff|Truncated|Image|UnexpectedEof
tiff|InvalidInput|Request|Invalid(Parameters)
tiff|UnsupportedFeature|Image|Unsupported(Feature)
tiff|Unsupported|Request|Unsupported
tiff|IntSizeOverflow|Image|Malformed
tiff|LimitExceeded|Resource|OutOfMemory
tiff|Limit|Resource|Limits
tiff|Stopped|Stopped|Stopped
tiff|Io|Io|Io
tiff|Buffer|Request|Invalid(Buffer)
svg|Parse|Image|Malformed
svg|TooManyElements|Resource|Limits(Scans)
svg|NotSvg|Image|Unsupported(Type)
svg|ZeroOutputDimensions|Request|Invalid(Parameters)
svg|AllocationFailed|Resource|OutOfMemory
svg|OutOfMemory|Resource|OutOfMemory
svg|PixelBufferMismatch|Internal|Bug
svg|Limit|Resource|Limits
svg|Unsupported|Request|Unsupported
svg|Stopped|Stopped|Stopped
svg|DecompressionBomb|Resource|Limits(DecompressionRatio)
svg|Sink|Internal|Dependency
svg|XmlWrite|Internal|Dependency
svg|Io|Io|Io
pdf|Malformed|Image|Malformed
pdf|Encrypted|Image|Unsupported(Feature)
pdf|PageOutOfRange|Request|Invalid(Parameters)
pdf|DimensionOverflow|Request|Invalid(Parameters)
pdf|InvalidRenderBounds|Request|Invalid(Parameters)
pdf|ZeroDimensions|Image|Malformed
pdf|TooManyPages|Resource|Limits(Frames)
pdf|PixelLimitExceeded|Resource|Limits(Pixels)
pdf|Buffer|Resource|OutOfMemory
pdf|Unsupported|Request|Unsupported
pdf|LimitExceeded|Resource|Limits
pdf|Sink|Io|Io
jp2|Decode(Truncated)|Image|UnexpectedEof
jp2|Decode(Format)|Image|Unsupported(Type)
jp2|Decode(Marker)|Image|Unsupported(Feature)
jp2|Decode|Image|Malformed
jp2|PixelBuffer|Internal|Bug
jp2|OutOfMemory|Resource|OutOfMemory
jp2|UnsupportedOperation|Request|Unsupported
jp2|Limit|Resource|Limits
jp2|Sink|Io|Io
""".strip().splitlines()
]

#: Codec, direction and the pixel descriptors that it takes or gives.
DESCRIPTORS = [
    ("tiff", "decode", "rgb_u8,rgba_u8,gray_u8,rgb_u16,rgba_u16,gray_u16,rgb_f32,rgba_f32,gray_f32,graya_u8,graya_u16,graya_f32"),
    ("tiff", "encode", "rgb_u8,rgba_u8,gray_u8,rgb_u16,rgba_u16,gray_u16,rgb_f32,rgba_f32,gray_f32,graya_u8,graya_u16,graya_f32"),
    ("svg", "decode", "rgba_u8"),
    ("pdf", "decode", "rgba_u8"),
    ("jp2", "decode", "rgb_u8,rgba_u8,gray_u8"),
]

#: Codec and whether its sources are known to be lossless; a quality is told by none.
SOURCES = [("tiff", True), ("jp2", False)]

#: TIFF compression, its code, and whether it is read here.
COMPRESSIONS = [("none", 1, True), ("fax", 3, False), ("fax4", 4, False), ("lzw", 5, True), ("jpeg", 7, False), ("deflate", 8, True), ("packbits", 32773, True), ("old_deflate", 32946, True), ("zstd", 50000, False), ("webp", 50001, False)]

#: Operations that a codec refuses with Unsupported.
REFUSED = [("tiff", "row_level_decode,animation_decode,animation_encode"), ("svg", "row_level_decode,animation_decode"), ("pdf", "row_level_decode,animation_decode"), ("jp2", "row_level_decode,animation_decode")]

#: Descriptive IFD0 tags, and tags that describe the stored image itself.
DESCRIPTIVE = (0x010D, 0x010E, 0x010F, 0x0110, 0x0131, 0x0132, 0x013B, 0x013C, 0x8298, 0x02BC)
STRUCTURAL = (0x0100, 0x0101, 0x0102, 0x0103, 0x0106, 0x0111, 0x0112, 0x0115, 0x0116, 0x0117, 0x011A, 0x011B, 0x011C, 0x0128)
#: Bytes of the TIFF field types 1 to 12.
FIELD_SIZES = (1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)
#: FNV-1a, 64 bits.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def small(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A literal table in the plan; ``columns`` as name and type, or names."""
    names = ", ".join(x.split()[0] for x in columns.split(", "))
    return spark.sql(f"select * from values {', '.join('(' + ', '.join(map(repr, row)) + ')' for row in rows)} as t({names})")


def formats(spark: SparkSession) -> DataFrame:
    return small(spark, FORMATS, FORMAT_COLUMNS)


def capabilities(spark: SparkSession) -> DataFrame:
    return small(spark, [(op, flag) for op, flags in CAPABILITIES for flag in flags.split(",")], "operation string, flag string")


def errors(spark: SparkSession) -> DataFrame:
    return small(spark, [(i, *row) for i, row in enumerate(ERRORS)], "variant_id int, codec string, variant string, origin string, kind string")


def descriptors(spark: SparkSession) -> DataFrame:
    return small(spark, [(c, d, x) for c, d, many in DESCRIPTORS for x in many.split(",")], "codec string, direction string, descriptor string")


def source_details(spark: SparkSession) -> DataFrame:
    """codec, lossless and quality, which is always null."""
    return small(spark, SOURCES, "codec string, lossless boolean").selectExpr("codec", "lossless", "cast(null as float) as quality")


def compressions(spark: SparkSession) -> DataFrame:
    return small(spark, COMPRESSIONS, "compression string, code int, readable boolean")


def refused_operations(spark: SparkSession) -> DataFrame:
    return small(spark, [(c, x) for c, many in REFUSED for x in many.split(",")], "codec string, operation string")


def fingerprint(*parts: int) -> str:
    """FNV-1a of a few bytes, as 16 hex digits."""
    h = FNV_START
    for part in parts:
        h = (h ^ part) * FNV_PRIME % (1 << 64)
    return f"{h:016x}"
