"""Registered queries that walk bytes: files are made from columns of ``part``, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import jobs as J
from .functions import limits as L
from .functions import pixels as P
from .operators import document_columns as D
from .operators import tiff_columns as T
from .plans import variants

METHODS = ("none", "lzw", "deflate", "packbits")
KINDS = ("gray_u8", "rgb_u8", "gray_u16", "rgba_u16", "graya_u8", "rgb_f32")


#: Rows of a task that makes files or encodes pixels.
_ROWS = 20_000
#: Bytes 0, 3, 6, ... modulo 256: the pixels of every image are a run of them.
_RAMP = bytes(3 * i % 256 for i in range(256 + 13 * 7 * 12))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, w, h, method, hpred, big, orientation, descriptor, unit (bytes of a pixel), pixels of every part.

    Byte i of the pixels is (id + 3 i) % 256. A table of short rows is few files, so rows are
    dealt anew, before they have pixels: work on these goes to all cores.
    """
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = parts.selectExpr(
        "p_partkey as id", "cast(p_size % 13 + 1 as int) as w", "cast(p_partkey % 7 + 1 as int) as h", "cast(p_partkey % 8 + 1 as int) as orientation",
        f"element_at(array{METHODS}, cast(p_partkey % 4 as int) + 1) as method", "p_partkey % 3 = 0 as hpred", "p_partkey % 5 = 0 as big",
        f"element_at(array{KINDS}, cast(p_partkey div 7 % 6 as int) + 1) as descriptor", "element_at(array(1, 3, 2, 8, 2, 12), cast(p_partkey div 7 % 6 as int) + 1) as unit",
    )
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, parts.count() // _ROWS), "id")
    # 3 * 171 is 1 modulo 256, so the byte 171 id begins the run.
    return rows.withColumn("pixels", F.substr(F.lit(_RAMP), (F.col("id") * 171 % 256 + 1).cast("int"), F.col("w") * F.col("h") * F.col("unit")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    made = T.encode_tiff(F.col("pixels"), F.col("w"), F.col("h"), F.col("descriptor"), F.col("method"), F.col("hpred"), F.col("big"), F.col("orientation"))
    return images.select("id", made["content"].alias("content"))


_SQL = "with t as (select p_partkey as id, cast(p_size % 13 + 1 as int) as w, cast(p_partkey % 7 + 1 as int) as h, cast(p_partkey % 8 + 1 as int) as orientation, cast(p_partkey % 4 as int) as m, p_partkey % 3 = 0 as hpred, p_partkey % 5 = 0 as big, cast(p_partkey // 7 % 6 as int) as d, ['gray_u8', 'rgb_u8', 'gray_u16', 'rgba_u16', 'graya_u8', 'rgb_f32'][d + 1] as descriptor, [1, 3, 2, 8, 2, 12][d + 1] as unit, [1, 3, 1, 4, 2, 3][d + 1] as samples, d in (3, 4) as alpha from part)"


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of every file, by all methods, predictors and both layouts."""
    found = T.tiff_pixels(F.col("content"))
    return _files(spark, sf_dir).select("id", found.alias("p")).select("id", "p.width", "p.height", "p.descriptor", F.hex("p.pixels").alias("pixels"), F.col("p.error.kind").alias("error"))


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a probe tells; every 11th file is cut behind its header, every 13th is null (numbers 0)."""
    content = F.when(F.col("id") % 13 == 0, None).when(F.col("id") % 11 == 0, F.substring("content", 1, 8)).otherwise(F.col("content"))
    found = _files(spark, sf_dir).select("id", T.tiff_info(content).alias("i"))
    numbers = [F.coalesce(f"i.{x}", F.lit(0)).alias(x) for x in ("width", "height", "bits", "samples", "page_count", "compression", "orientation")]
    return found.select("id", "i.color", *numbers, F.coalesce("i.big", F.lit(False)).alias("big"), F.col("i.error.kind").alias("error"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of every file."""
    found = T.tiff_tags(_files(spark, sf_dir)).select("id", "tag.*")
    return found.groupBy("id").agg(F.count("*").alias("n_tags"), F.max(F.col("dest") == "ifd0").alias("ifd0"), F.max((F.col("tag") == 317)).alias("predicted"), F.min(F.when(F.col("tag") == 274, F.hex(F.substring("raw", 1, 1)))).alias("orientation"))


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest lossless variant of every image."""
    images = _images(spark, sf_dir).select("id", "pixels", F.col("w").alias("width"), F.col("h").alias("height"), "descriptor")
    return T.best_variant(images, variants.plan(spark), "id")


_GONE = "id % 13 = 0 or id % 11 = 0"
QUERIES = {"x1_tiff_roundtrip": roundtrip, "p1_tiff_probe": probe, "p11_tiff_tags": tags, "w10_best_variant": best}
ORACLES = {
    "x1_tiff_roundtrip": f"{_SQL} select id, w as width, h as height, descriptor, array_to_string([format('{{:02X}}', (id + 3 * i) % 256) for i in range(w * h * unit)], '') as pixels, cast(null as varchar) as error from t",
    "p1_tiff_probe": f"{_SQL} select id, " + ", ".join(f"case when {_GONE} then {'null' if k == 'color' else 'false' if k == 'big' else 0} else {v} end as {k}" for k, v in {"width": "w", "height": "h", "color": "split_part(descriptor, '_', 1)", "bits": "[8, 8, 16, 16, 8, 32][d + 1]", "samples": "samples", "big": "big", "page_count": "1", "compression": "[1, 5, 8, 32773][m + 1]", "orientation": "orientation"}.items()) + ", case when id % 13 > 0 and id % 11 = 0 then 'Truncated' end as error from t",
    "p11_tiff_tags": f"{_SQL} select id, cast(11 + (hpred and m > 0 and d <> 4)::int + alpha::int as bigint) as n_tags, true as ifd0, hpred and m > 0 and d <> 4 as predicted, format('{{:02X}}', orientation) as orientation from t",
}


def minified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minified SVG text and its size; every 9th document breaks off."""
    body = F.concat(F.lit('<?xml version="1.0"?><?x y?><svg width="'), "p_size", F.lit('" viewBox="0 0 3 40"><!-- > --><title>a<b/></title><desc/><text> '), "p_name", F.when(F.col("p_partkey") % 9 == 0, "").otherwise(" </text></svg>"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.encode(body, "UTF-8").alias("content"))
    found = rows.select("id", D.minify_svg(F.col("content")).alias("m"), D.svg_size(F.col("content")).alias("s"))
    return found.select("id", F.decode("m.content", "UTF-8").alias("text"), F.col("m.error.kind").alias("error"), "s.width", "s.height")


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sizes: an inherited box, a rotated page and one with its own crop box."""
    text = "concat('%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R 4 0 R 5 0 R] /MediaBox [0 0 ', p_size + 100, ' 300]>> endobj\n3 0 obj <</Type /Page>> endobj\n4 0 obj <</Type /Page /Rotate 90>> endobj\n5 0 obj <</Type /Page /CropBox [10 20 60.5 ', p_size + 30, ']>> endobj\n')"
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as id", f"encode({text}, 'UTF-8') as content")
    return D.pdf_pages(rows).select("id", "page.page", F.col("page.width").cast("double").alias("width"), F.col("page.height").cast("double").alias("height"))


def jp2_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codestream headers of every part; every 7th is cut."""
    number = lambda c: F.lpad(F.hex(F.col(c)), 8, "0")
    head = F.concat(F.lit("FF4FFF51002F0000"), number("p_size"), number("p_partkey"), F.lit("0" * 16 + "0" * 32), F.lpad(F.hex(F.col("p_partkey") % 4 + 1), 4, "0"), F.lit("070101"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.unhex(F.when(F.col("p_partkey") % 7 == 0, F.substring(head, 1, 40)).otherwise(head)).alias("content"))
    return rows.select("id", D.jp2_info(F.col("content")).alias("i")).select("id", *[F.coalesce(f"i.{x}", F.lit(0)).alias(x) for x in ("width", "height", "components", "bits")], "i.color", "i.descriptor", "i.probe_descriptor", F.col("i.error.kind").alias("error"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved planes; every 5th pixel list is short."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as id", "array(p_size, p_partkey % 7) as r", "array(1, p_size) as g", "if(p_partkey % 5 = 0, array(9), array(9, p_size)) as b")
    mixed = P.interleave([F.col(x).cast("array<bigint>") for x in "rgb"], F.lit(2))
    return rows.select("id", F.array_join(mixed.cast("array<string>"), ",").alias("samples"))


def palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of indices of two bits; index 4 is beyond the map and every 3rd map is short."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as id", "cast(p_partkey % 5 as int) as i", "transform(sequence(0, if(p_partkey % 3 = 0, 9, 11)), x -> cast((x * 5 + p_size % 200) * 256 + 77 as int)) as colours")
    return rows.select("id", F.array_join(P.palette(F.col("colours"), F.col("i"), F.lit(2)).cast("array<string>"), ",").alias("rgb"))


def orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each orientation hint resolves to."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id as id", "cast(event_id % 10 as int) as own", "cast(user_id % 8 + 1 as int) as asked", "element_at(array('preserve', 'correct', 'exact', 'both'), cast(event_id % 4 as int) + 1) as hint")
    return rows.select("id", P.resolve_orientation(F.col("hint"), F.col("own"), F.col("asked")).alias("orientation"))


def _composed() -> str:
    """Orientation pairs by products of 2 x 2 matrices, apart from the operator's own rule."""
    #: What each tag does to (x, y) about the centre.
    turns = [(1, 0, 0, 1), (-1, 0, 0, 1), (-1, 0, 0, -1), (1, 0, 0, -1), (0, 1, 1, 0), (0, -1, 1, 0), (0, -1, -1, 0), (0, 1, -1, 0)]
    product = lambda m, n: (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3])
    return "[" + ", ".join(str(turns.index(product(then, first)) + 1) for first in turns for then in turns) + "]"


_HINTS = "element_at(array('preserve', 'correct', 'exact', 'both'), cast(id % 4 as int) + 1)"
_TURNED = f"cast(case id % 4 when 0 then 1 when 1 then orientation when 2 then id % 7 + 1 else {_composed()}[cast((orientation - 1) * 8 + id % 7 + 1 as int)] end as int)"


def _hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).withColumn("hint", F.expr(_HINTS)).withColumn("asked", (F.col("id") % 7 + 1).cast("int"))


def generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared info of every file."""
    found = _files(spark, sf_dir).select("id", J.generic_info(T.tiff_info(F.col("content"))).alias("i"))
    return found.select("id", "i.width", "i.height", "i.alpha", "i.orientation", "i.bit_depth", "i.channels", F.coalesce("i.page_count", F.lit(0)).alias("page_count"), "i.random_access", "i.lossless")


def job_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and orientation as a job's probe reports them."""
    found = _hinted(spark, sf_dir).select("id", J.job_probe(T.tiff_info(F.col("content")), F.col("hint"), F.col("asked"), exif=False).alias("i"))
    return found.select("id", "i.width", "i.height", "i.orientation", F.col("i.exif").isNull().alias("no_exif"))


def output_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decoding would give."""
    found = _hinted(spark, sf_dir).select("id", J.tiff_output_info(T.tiff_info(F.col("content")), F.col("hint"), F.col("asked")).alias("o"))
    return found.select("id", "o.*")


def decode_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels under limits, with the orientation that the hint asks for; images of more than 60 pixels are refused."""
    found = _hinted(spark, sf_dir).select("id", T.tiff_decode(F.col("content"), {"max_pixels": 60}, F.col("hint"), F.col("asked")).alias("p"))
    return found.select("id", *[F.coalesce(f"p.{x}", F.lit(0)).alias(x) for x in ("width", "height", "orientation")], F.hex("p.pixels").alias("pixels"), F.col("p.error.kind").alias("error"))


def encode_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files under the limits and metadata gates of an encode job, probed again: profiles are not to be embedded."""
    images = _images(spark, sf_dir)
    meta = F.struct(F.lit(b"profile").alias("icc"), F.lit(None).cast("binary").alias("exif"), F.when(F.col("id") % 2 == 0, F.lit(b"<x/>")).alias("xmp"), F.when(F.col("id") % 3 == 0, F.col("orientation")).alias("orientation"))
    rows = images.withColumn("m", J.lower_metadata(meta, icc=False))
    made = T.encode_tiff(*[F.col(x) for x in ("pixels", "w", "h", "descriptor", "method", "hpred", "big", "m.orientation", "m.icc", "m.xmp", "m.exif")], limits={"max_pixels": 60, "max_width": 12, "max_memory": 300})
    rows = rows.select("id", "m", made.alias("f")).select("id", J.nothing_to_write(F.col("m")).alias("plain"), F.col("f.error.kind").alias("error"), T.tiff_info(F.col("f.content")).alias("i"))
    return rows.select("id", "plain", "error", F.coalesce("i.orientation", F.lit(0)).alias("orientation"), F.col("i.icc").isNotNull().alias("icc"), F.col("i.xmp").isNotNull().alias("xmp"))


def pixel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every image as a row."""
    images = _images(spark, sf_dir)
    return images.select("id", F.explode(J.pixel_rows(F.col("w"), F.col("h"), F.col("pixels"), F.lit(1), F.col("unit"))).alias("r")).select("id", "r.y", F.hex(J.appended(F.when(F.col("id") % 2 == 0, F.lit(b"!")), F.col("r.row"))).alias("row"))


def _pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, info and the length of PDFs of three pages; every 9th isn't one."""
    text = "concat(if(p_partkey % 9 = 0, '%PS', '%PDF-1.4'), '\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R 4 0 R 5 0 R]>> endobj\n3 0 obj <</Type /Page /MediaBox [0 0 ', p_size + 100, '.75 300]>> endobj\n4 0 obj <</Type /Page /MediaBox [0 0 300 200]>> endobj\n5 0 obj <</Type /Page /MediaBox [0 0 0 200]>> endobj\n')"
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as id", f"encode({text}, 'UTF-8') as content")
    return rows.select("id", D.pdf_info(F.col("content")).alias("info"), F.length("content").alias("length"), F.when(F.col("id") % 13 == 0, 10).alias("max_input"))


def pdf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pdfs(spark, sf_dir).select("id", J.pdf_probe(F.col("info"), F.col("length"), F.col("max_input"), F.lit(140), F.lit(None).cast("int"), F.lit(40000)).alias("p"))
    return found.select("id", *[F.coalesce(f"p.{x}", F.lit(0)).alias(x) for x in ("width", "height", "page_count")], "p.error")


def pdf_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("element_at(array('scale', 'width', 'height', 'exact'), cast(id % 4 as int) + 1)")
    a = F.expr("element_at(array(1.5D, 100D, 80D, 30D), cast(id % 4 as int) + 1)")
    none = F.lit(None).cast("int")
    found = J.pdf_output_info(_pdfs(spark, sf_dir), F.col("info"), F.col("length"), (F.col("id") % 5).cast("int"), kind, a, F.lit(40.0), F.col("max_input"), F.lit(200), none, none, "p")
    return found.select("id", *[F.coalesce(f"p.{x}", F.lit(0)).alias(x) for x in ("page", "width", "height")], "p.error")


def svg_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes with and without sniffing; every 5th document lacks the mark, every 7th has no size."""
    body = F.concat(F.when(F.col("p_partkey") % 5 == 0, "<!-- " + "x" * 300 + " -->").otherwise(""), F.lit('<svg width="'), F.when(F.col("p_partkey") % 7 == 0, "0").otherwise(F.col("p_size")), F.lit('" height="30"/>'))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.encode(body, "UTF-8").alias("content"))
    rows = rows.select("id", L.is_svg(F.col("content")).alias("svg"), D.svg_size(F.col("content")).alias("s"))
    none = F.lit(None).cast("int")
    info = lambda svg: J.svg_info(svg, F.col("s"), none, none, F.lit("original"), F.lit(0.5))
    found = rows.select("id", info(F.col("svg")).alias("quick"), info(F.lit(True)).alias("full"))
    return found.select("id", *[F.coalesce(f"{x}.{y}", F.lit(0)).alias(f"{x}_{y}") for x in ("quick", "full") for y in ("width", "height", "channels")], "full.descriptor", F.col("quick.error").alias("quick_error"), F.col("full.error").alias("full_error"))


def svg_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle on nothing, one pixel from the edges; every 9th document has a circle, every 11th is too large."""
    body = F.expr("""concat('<svg width="', p_size % 7 + 3, '" height="', if(p_partkey % 11 = 0, 900, p_partkey % 5 + 3), '"><g fill="#0a141e"><title>t</title><rect x="1" y="1" width="', p_size % 7 + 1, '" height="', p_partkey % 5 + 1, '"/>', if(p_partkey % 9 = 0, '<circle/>', ''), '</g></svg>')""")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.encode(body, "UTF-8").alias("content"))
    found = D.render_svg(rows, max_px=1000)
    return found.select("id", F.coalesce("raster.width", F.lit(0)).alias("width"), F.coalesce("raster.height", F.lit(0)).alias("height"), F.hex("raster.pixels").alias("pixels"), F.col("raster.error.kind").alias("error"))


def pdf_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a blue rectangle on white, the second one turned; every 7th document asks for a page that isn't there."""
    text = "concat('%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R 4 0 R] /Contents 5 0 R /MediaBox [0 0 ', p_size % 5 + 5, ' 12]>> endobj\n3 0 obj <</Type /Page /Contents 5 0 R>> endobj\n4 0 obj <</Type /Page /Rotate 90 /Contents [5 0 R]>> endobj\n5 0 obj <</Length 32>>\nstream\nq 0 0 1 rg 1 2 3 4 re f Q % blue\nendstream endobj\n')"
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as id", f"encode({text}, 'UTF-8') as content", "if(p_partkey % 7 = 0, 'single', 'all') as kind", "cast(2 as int) as start")
    found = D.render_pages(rows, L.page_indices(F.col("kind"), F.col("start"), F.col("start"), F.lit(2)), F.lit("scale"), F.lit(1.0), F.lit(0.0))
    return found.select("id", F.coalesce("page", F.lit(-1)).alias("page"), F.coalesce("raster.width", F.lit(0)).alias("width"), F.coalesce("raster.height", F.lit(0)).alias("height"), F.hex("raster.pixels").alias("pixels"), F.col("raster.error.kind").alias("error"))


def sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of files by their first bytes, one in sixteen each."""
    #: Starts of files.
    starts = "49492A0008, 4D4D002A00, 49492B0008, 4D4D002B00, 4949002A00, 0000000C6A5020200D0A870A, FF4FFF5100, 255044462D, 1F8B0800, EFBBBF3C737667, EFBBBF0A3C3F786D6C, EFBBBF, 3C21444F435459504520535647, 0000000C6A502020, 00, 494900".split(", ")
    content = F.unhex(F.element_at(F.array(*[F.lit(x) for x in starts]), (F.col("p_partkey") % 16 + 1).cast("int")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), L.sniff(content).alias("format"))


QUERIES |= {"v1_svg_minify": minified, "p25_pdf_pages": pdf_pages, "p28_jp2_headers": jp2_headers, "x6_interleave": planes, "x21_palette": palettes, "x34_orientation_hints": orientations}
ORACLES |= {
    "v1_svg_minify": "select p_partkey as id, case when p_partkey % 9 > 0 then '<?xml version=\"1.0\"?><svg width=\"' || p_size || '\" viewBox=\"0 0 3 40\"><desc/><text>' || trim(p_name) || '</text></svg>' end as text, case when p_partkey % 9 = 0 then 'Parse' end as error, cast(p_size as double) as width, cast(40 as double) as height from part",
    "p25_pdf_pages": "select p_partkey as id, cast(page as int) as page, cast([p_size + 100, 300, 50.5][page + 1] as double) as width, cast([300, p_size + 100, p_size + 10][page + 1] as double) as height from part, range(3) r(page)",
    "p28_jp2_headers": "with t as (select p_partkey as id, p_size as s, cast(p_partkey % 4 + 1 as int) as n, p_partkey % 7 = 0 as cut from part) select id, case when not cut then cast(s as bigint) else 0 end as width, case when not cut then cast(id as bigint) else 0 end as height, case when not cut then n else 0 end as components, case when not cut then 8 else 0 end as bits, case when not cut then case when n < 3 then 'gray' else 'rgb' end end as color, case when not cut then case when n < 3 then 'gray_u8' else 'rgb_u8' end end as descriptor, case when not cut then 'rgb_u8' end as probe_descriptor, case when cut then 'Decode' end as error from t",
    "x6_interleave": "select p_partkey as id, case when p_partkey % 5 = 0 then concat_ws(',', p_size, p_partkey % 7, 1, p_size, 9) else concat_ws(',', p_size, 1, 9, p_partkey % 7, p_size, p_size) end as samples from part",
    "x21_palette": "select p_partkey as id, case when p_partkey % 3 > 0 and p_partkey % 5 < 4 then concat_ws(',', p_partkey % 5 * 5 + p_size % 200, (p_partkey % 5 + 4) * 5 + p_size % 200, (p_partkey % 5 + 8) * 5 + p_size % 200) end as rgb from part",
    "x34_orientation_hints": f"with t as (select event_id as id, case when event_id % 10 between 1 and 8 then event_id % 10 else 1 end as own, user_id % 8 + 1 as asked, event_id % 4 as hint from events) select id, cast(case hint when 0 then 1 when 1 then own when 2 then asked else {_composed()}[cast((own - 1) * 8 + asked as int)] end as int) as orientation from t",
}

QUERIES |= {"s1_sniff_bytes": sniffed, "p16_generic_info": generic, "p17_job_probe": job_probe, "p18_output_info": output_info, "x37_decode_job": decode_job, "e13_encode_job": encode_job, "s16_pixel_rows": pixel_rows, "p26_pdf_probe": pdf_probe, "p27_pdf_output_info": pdf_output, "p19_svg_probe": svg_probe, "x31_svg_raster": svg_raster, "x33_pdf_raster": pdf_raster}
_PROBED = f"{_SQL}, u as (select *, {_TURNED} as turned, id % 4 > 0 as baked from t), v as (select *, case when turned > 4 then h else w end as ow, case when turned > 4 then w else h end as oh from u)"
#: Where a pixel (x, y) of the turned image comes from, as its number in the stored one.
_FROM = "case turned when 1 then y * w + x when 2 then y * w + w - 1 - x when 3 then (h - 1 - y) * w + w - 1 - x when 4 then (h - 1 - y) * w + x when 5 then x * w + y when 6 then (h - 1 - x) * w + y when 7 then (h - 1 - x) * w + w - 1 - y else x * w + w - 1 - y end"
ORACLES |= {
    "s1_sniff_bytes": "select p_partkey as id, ['tiff', 'tiff', 'tiff', 'tiff', null, 'jp2', 'jp2', 'pdf', 'svg', 'svg', 'svg', null, 'svg', 'jp2', null, null][p_partkey % 16 + 1] as format from part",
    "p16_generic_info": f"{_SQL} select id, cast(w as bigint) as width, cast(h as bigint) as height, alpha, orientation, [8, 8, 16, 16, 8, 32][d + 1] as bit_depth, samples as channels, 0 as page_count, false as random_access, true as lossless from t",
    "p17_job_probe": f"{_PROBED} select id, cast(ow as bigint) as width, cast(oh as bigint) as height, case when baked then 1 else orientation end as orientation, true as no_exif from v",
    "p18_output_info": f"{_PROBED} select id, cast(ow as bigint) as width, cast(oh as bigint) as height, descriptor, alpha, turned as orientation from v",
    "x37_decode_job": f"""{_PROBED}, p as (select id, i, i // unit % ow as x, i // unit // ow as y, i % unit as k, v.* exclude (id) from v, range(13 * 7 * 12) r(i) where i < w * h * unit),
q as (select id, string_agg(format('{{:02X}}', cast((id + 3 * (({_FROM}) * unit + k)) % 256 as int)), '' order by i) as hex from p group by id)
select id, case when good then ow else 0 end as width, case when good then oh else 0 end as height, case when not good then 0 when baked then 1 else orientation end as orientation, case when good then hex end as pixels, case when not good then 'LimitExceeded' end as error
from (select *, w * h <= 60 as good from v join q using (id))""",
    "e13_encode_job": f"{_SQL} select id, id % 2 > 0 and (id % 3 > 0 or orientation = 1) as plain, case when bad then 'Limit' end as error, case when not bad and id % 3 = 0 and orientation > 1 then orientation else 0 end as orientation, false as icc, not bad and id % 2 = 0 as xmp from (select *, w * h > 60 or w > 12 or w * h * unit > 300 as bad from t)",
    "s16_pixel_rows": f"{_SQL} select id, cast(y as int) as y, case when id % 2 = 0 then '21' else '' end || array_to_string([format('{{:02X}}', (id + 3 * (y * w * unit + i)) % 256) for i in range(w * unit)], '') as row from t, range(7) r(y) where y < h",
    "p26_pdf_probe": "select id, case when error is null then cast(s + 100 as bigint) else 0 end as width, case when error is null then cast(300 as bigint) else 0 end as height, case when error is null then 3 else 0 end as page_count, error from (select p_partkey as id, p_size as s, case when p_partkey % 13 = 0 then 'InputSize' when p_partkey % 9 = 0 then 'Malformed' when p_size + 100 > 140 then 'width' when (p_size + 100) * 300 > 40000 then 'pixels' end as error from part)",
    "p27_pdf_output_info": """with t as (select p_partkey as id, p_size + 100.75 as w0, cast(least(p_partkey % 5, 2) as int) as page, p_partkey % 4 as k from part),
u as (select *, case page when 0 then w0 when 1 then 300 else 0 end::float as pw, case page when 1 then 200 when 0 then 300 else 200 end::float as ph from t),
v as (select *, case when pw > 0 then cast(case k when 0 then floor(pw * 1.5::float) when 1 then 100 when 2 then floor(pw * (80::float / ph)) else 30 end as bigint) end as w, case when pw > 0 then cast(case k when 0 then floor(ph * 1.5::float) when 1 then floor(ph * (100::float / pw)) when 2 then 80 else 40 end as bigint) end as h from u),
x as (select *, case when id % 13 = 0 then 'InputSize' when id % 9 = 0 then 'Malformed' when page = 2 then 'ZeroDimensions' when w > 200 then 'width' end as error from v)
select id, case when error is null then page else 0 end as page, case when error is null then w else 0 end as width, case when error is null then h else 0 end as height, error from x""",
    "p19_svg_probe": """with t as (select p_partkey as id, case when p_partkey % 7 = 0 then 'Parse' end as bad, case when p_partkey % 5 = 0 then 'NotSvg' when p_partkey % 7 = 0 then 'Parse' end as quick, cast(ceil(p_size / 2.0) as bigint) as w from part)
select id, case when quick is null then w else 0 end as quick_width, case when quick is null then cast(15 as bigint) else 0 end as quick_height, case when quick is null then 4 else 0 end as quick_channels, case when bad is null then w else 0 end as full_width, case when bad is null then cast(15 as bigint) else 0 end as full_height, case when bad is null then 4 else 0 end as full_channels, case when bad is null then 'rgba_u8' end as descriptor, quick as quick_error, bad as full_error from t""",
    "x31_svg_raster": """with t as (select p_partkey as id, cast(p_size % 7 + 3 as int) as w, cast(p_partkey % 5 + 3 as int) as h, case when p_partkey % 11 = 0 then 'LimitExceeded' when p_partkey % 9 = 0 then 'UnsupportedFeature' end as error from part)
select id, case when error is null then w else 0 end as width, case when error is null then h else 0 end as height, case when error is null then array_to_string([case when i % w between 1 and w - 2 and i // w between 1 and h - 2 then '0A141EFF' else '00000000' end for i in range(w * h)], '') end as pixels, error from t""",
    "x33_pdf_raster": """with t as (select p_partkey as id, cast(p_size % 5 + 5 as int) as s, p_partkey % 7 = 0 as bad from part), p as (select *, cast(case when bad then -1 else n end as int) as page from t, range(2) r(n) where not bad or n = 0)
select id, page, case when bad then 0 when page = 0 then s else 12 end as width, case when bad then 0 when page = 0 then 12 else s end as height,
  case when page = 0 then array_to_string([case when i % s between 1 and 3 and i // s between 6 and 9 then '0000FFFF' else 'FFFFFFFF' end for i in range(s * 12)], '')
    when page = 1 then array_to_string([case when i // 12 between 1 and 3 and 11 - i % 12 between 6 and 9 then '0000FFFF' else 'FFFFFFFF' end for i in range(s * 12)], '') end as pixels,
  case when bad then 'PageOutOfRange' end as error from p""",
}
