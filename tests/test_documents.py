"""SVG, PDF and JPEG 2000 bytes: golden values, limits, defects."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from rasterlake.functions import pixels
from rasterlake.operators import document_columns as D
from rasterlake.sources import jp2, pdf, raster, svg
from rasterlake.sources.tiff import TiffError


def test_minify():
    text = b"""<?xml version="1.0"?><!DOCTYPE svg [<!ENTITY a "b">]><?go x?>
<svg xmlns="u" a="1>2"><!-- <g> --><title/><x:desc>t<title>u</title>v</x:desc> <text> a  b <![CDATA[ <c> ]]></text>  </svg>"""
    assert svg.minify(text) == b'<?xml version="1.0"?><!DOCTYPE svg [<!ENTITY a "b">]><svg xmlns="u" a="1>2"><title/><text>a  b<![CDATA[ <c> ]]></text></svg>'
    assert svg.minify(svg.minify(text)) == svg.minify(text)
    assert gzip.decompress(svg.minify(gzip.compress(text), compress=True)) == svg.minify(text)
    assert b"<!-- <g> -->" in svg.minify(text, comments=False)
    for bad in (b"<svg>", b"<svg></g>", b"<svg", b"</svg>", b"<svg><!-- x</svg>"):
        with pytest.raises(TiffError):
            svg.minify(bad)


def test_bounded_expansion():
    bomb = gzip.compress(b"0" * 10_000_000)
    for data, limit, kind in ((bomb, 100_000, "DecompressionBomb"), (b"x" * 11, 10, "InputSize"), (bomb[:-9], None, "Parse")):
        with pytest.raises(TiffError) as error:
            svg.expand(data, limit)
        assert error.value.kind == kind
    assert svg.expand(b"") == b"" and svg.expand(bomb, 10_000_000) == b"0" * 10_000_000


def test_sizes():
    assert svg.size(b'<svg width="1in" height=\'50%\' viewBox="0 0 9 80"/>') == (96.0, 40.0)
    assert svg.size(b'<!-- <svg> --><svg viewBox="0,0,3,4"/>') == (3.0, 4.0)
    for bad in (b"<svg/>", b"<html/>", b"", b'<svg width="0" height="1"/>'):
        with pytest.raises(TiffError):
            svg.size(bad)


def test_pdf():
    first = len(b"2 0 3 50 ")
    inner = b"2 0 3 50 " + b"<</Type/Pages/Kids[3 0 R 2 0 R 9 0 R]/Count 1>>".ljust(50) + b"<</Type/Page/MediaBox[0 0 200 100]/Rotate 270/T(a\\)b)>>"
    packed = zlib.compress(inner)
    data = b"%PDF-1.5\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n5 0 obj<</Type/ObjStm/N 2/First " + str(first).encode() + b"/Filter/FlateDecode/Length " + str(len(packed)).encode() + b">>\nstream\n" + packed + b"\nendstream endobj"
    assert pdf.pages(data) == [(100.0, 200.0)]
    assert pdf.pages(b"%PDF-1.0 1 0 obj<</Type/Catalog>>endobj") == []
    for bad, kind in ((b"%PDF-1.0", "Malformed"), (b"", "Malformed"), (b"%PDF-1.0 trailer<</Encrypt 4 0 R>>", "Encrypted")):
        with pytest.raises(TiffError) as error:
            pdf.pages(bad)
        assert error.value.kind == kind


def test_jp2():
    size = bytes.fromhex("FF4FFF51002F0000") + struct.pack(">8I", 30, 20, 10, 5, 0, 0, 0, 0) + struct.pack(">HB", 4, 7) + b"\1\1"
    box = lambda kind, content: struct.pack(">I4s", 8 + len(content), kind) + content
    header = box(b"ihdr", bytes(14)) + box(b"colr", b"\2\0\0profile") + box(b"cdef", struct.pack(">H6H", 2, 0, 0, 1, 3, 1, 0))
    found = jp2.info(box(b"jP  ", bytes.fromhex("0D0A870A")) + box(b"jp2h", header) + box(b"jp2c", size))
    assert (found["width"], found["height"], found["alpha"], found["color"], found["icc"], found["descriptor"]) == (20, 15, True, "icc", b"profile", "rgba_u8")


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"<svg/>")], "id int, content binary")
    c = F.col("content")
    got = {r.id: r for r in df.select("id", D.minify_svg(c).alias("m"), D.pdf_info(c).alias("p"), D.jp2_info(c).alias("j"), D.svg_size(c).alias("s")).collect()}
    assert all(got[1][x].error is None for x in "mpjs")
    assert [got[2][x].error and got[2][x].error.kind for x in "mpjs"] == [None, "Malformed", "Decode", "Parse"]
    assert bytes(got[3].m.content) == b"<svg/>"


def test_policy_and_merge(spark):
    row = spark.sql("select named_struct('icc', X'01', 'exif', X'02', 'xmp', X'03') as i, named_struct('q', cast(null as int), 'r', 2) as o, named_struct('q', 5, 'r', 6) as b").select(pixels.apply_policy(F.col("i"), exif=False).alias("i"), pixels.merge_parameters(F.col("o"), F.col("b"), ["q", "r"]).alias("m")).first()
    assert (row.i.exif, bytes(row.i.icc), tuple(row.m)) == (None, b"\1", (5, 2))


def test_no_more_of_a_stream_than_allowed(monkeypatch):
    inner = b"2 0 3 40 " + b"<</Type/Pages/Kids[3 0 R]>>".ljust(40) + b"<</Type/Page/MediaBox[0 0 9 9]>>"
    packed = zlib.compress(inner + b" " * 1_000_000)
    data = b"%PDF-1.5\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n5 0 obj<</Type/ObjStm/N 2/First 9/Filter/FlateDecode/Length " + str(len(packed)).encode() + b">>\nstream\n" + packed + b"\nendstream endobj"
    monkeypatch.setattr(pdf, "MAX_STREAM", 200)
    assert pdf.pages(data) == [(9.0, 9.0)]


def test_limits_and_metadata_of_jobs(spark):
    from rasterlake.functions import jobs, limits

    row = spark.sql("select struct(cast(null as binary) as icc, cast(null as binary) as exif, X'01' as xmp, 1 as orientation) as m, cast(5 as bigint) as w").select(
        jobs.nothing_to_write(jobs.lower_metadata(F.col("m"))).alias("some"),
        jobs.nothing_to_write(jobs.lower_metadata(F.col("m"), xmp=False)).alias("none"),
        limits.product(F.col("w"), F.lit(None).cast("bigint")).alias("unknown"),
        limits.input_gate(F.col("w"), F.lit(4)).alias("gate"),
        limits.finite(F.lit(float("nan"))).alias("nan"),
    ).first()
    assert tuple(row) == (False, True, None, "InputSize", False)


def test_rectangles_of_svg():
    got = raster.render_svg(b'<svg width="4" height="2" viewBox="0 0 8 4"><rect width="8" height="4" fill="white"/><rect x="2" y="0" width="3" height="2" fill="#f00"/></svg>', 4, 2)
    assert got[:, :, 3].tolist() == [[255] * 4] * 2
    assert got[0].tolist() == [[255, 255, 255, 255], [255, 0, 0, 255], [255, 128, 128, 255], [255, 255, 255, 255]] and (got[1] == 255).all()
    half = raster.render_svg(b'<svg width="2" height="1"><rect width="0.5" height="1" fill="lime"/></svg>', 2, 1)
    assert half.tolist() == [[[0, 255, 0, 128], [0, 0, 0, 0]]]
    assert raster.render_svg(b'<svg width="1" height="1"/>', 3, 1, (10, 20, 30, 255)).tolist() == [[[10, 20, 30, 255]] * 3]
    middle = raster.render_svg(b'<svg width="4" height="2" viewBox="0 0 1 1"><rect width="1" height="1"/></svg>', 4, 2)
    assert middle[:, :, 3].tolist() == [[0, 255, 255, 0]] * 2  # a square box in the middle
    nested = b'<svg width="2" height="1"><g fill="none"><rect width="2" height="1"/><g fill="blue"><rect width="1" height="1"/></g><rect x="1" width="1" height="1"/></g></svg>'
    assert raster.render_svg(nested, 2, 1).tolist() == [[[0, 0, 255, 255], [0, 0, 0, 0]]]
    for bad in (b"<text/>", b'<rect rx="1"/>', b'<rect fill="url(#a)"/>', b'<g transform="scale(2)"/>', b'<rect style="fill:red"/>'):
        with pytest.raises(TiffError) as error:
            raster.render_svg(b'<svg width="1" height="1">' + bad + b"</svg>", 1, 1)
        assert error.value.kind == "UnsupportedFeature"


def test_rectangles_of_pages():
    found = raster.rectangles(b"q 2 0 0 2 10 0 cm 0.5 g 1 1 2 3 re f Q 0 1 0 0 k 5 5 -2 2 re 0 0 1 1 re f* 9 9 9 9 re n /a BMC EMC")
    assert found == [((12, 2, 16, 8), (0.5, 0.5, 0.5)), ((3, 5, 5, 7), (1, 0, 1)), ((0, 0, 1, 1), (1, 0, 1))]
    for bad in (b"BT (x) Tj ET", b"0 0 m 1 1 l S", b"1 1 0 1 0 0 cm", b"0 0 1 1 re W n", b"/x Do", b"/x gs"):
        with pytest.raises(TiffError) as error:
            raster.rectangles(bad)
        assert error.value.kind == "UnsupportedFeature"
    assert raster.rectangles(b" % nothing\n") == []


def test_pages_that_cannot_be_shown(spark):
    from rasterlake.functions import limits as L

    page = b"%PDF-1.4 1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R]/MediaBox[0 0 9 9]>>endobj 3 0 obj<</Type/Page>>endobj"
    df = spark.createDataFrame([(1, page, [0]), (2, page, [0] * 1001), (3, page, []), (4, b"x", [0]), (5, None, [0]), (6, page, None)], "id int, content binary, pages array<int>")
    got = {}
    for r in D.render_pages(df, F.col("pages"), F.lit("width"), F.lit(20.0), F.lit(0.0), max_px=400).collect():
        got.setdefault(r.id, []).append((r.page, r.raster.error and r.raster.error.kind, r.raster.width))
    assert got == {1: [(0, None, 20)], 2: [(None, "TooManyPages", None)], 4: [(None, "Malformed", None)], 5: [(0, None, None)], 6: [(None, "PageOutOfRange", None)]}
    small = D.render_pages(df.where("id = 1"), F.col("pages"), F.lit("width"), F.lit(20.0), F.lit(0.0), max_px=399).first()
    assert small.raster.error.kind == "PixelLimitExceeded" and L.MAX_PAGES == 1000
