"""Registered queries of directories, the TIFF data source and rasters of blocks, over files and pixels made from ``part``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import assets
from .functions import jobs as J
from .functions import limits as L
from .functions import tags as T
from .operators import balance as B
from .operators import directories as D
from .operators import markup as M
from .operators import rasters as R
from .session import Tables, settled
from .sources import tiff_source

c = F.col


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, and the layout of its file: byte order, offsets of 32 or 64 bits."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(c("p_partkey").alias("id"), "p_name", "p_brand", "p_type", "p_size", (c("p_partkey") % 2 == 0).alias("little"), (c("p_partkey") % 3 == 0).alias("big"))


def _word(value: Column) -> Column:
    return F.when(c("big"), T.as_hex(value, 8, c("little"))).otherwise(T.as_hex(value, 4, c("little")))


def _magic() -> Column:
    """Digits of a header, up to the first offset."""
    return F.when(c("big"), F.when(c("little"), "49492B0008000000").otherwise("4D4D002B00080000")).when(c("little"), "49492A00").otherwise("4D4D002A")


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one to four pages, each with its number as width; every fifth file's last page leads back to its first."""
    rows = _part(spark, sf_dir).withColumn("pages", (c("id") % 4 + 1).cast("int"))
    size, start = F.when(c("big"), 36).otherwise(18), F.when(c("big"), 16).otherwise(8)
    after = lambda p: F.when(p < c("pages") - 1, start + (p + 1) * size).when(c("id") % 5 == 0, start).otherwise(0)
    count = F.when(c("big"), T.as_hex(F.lit(1), 8, c("little"))).otherwise(T.as_hex(F.lit(1), 2, c("little")))
    page = lambda p: F.concat(count, T.as_hex(F.lit(256), 2, c("little")), T.as_hex(F.lit(4), 2, c("little")), _word(F.lit(1)), F.rpad(T.as_hex(c("id") + p, 4, c("little")), F.when(c("big"), 16).otherwise(8), F.lit("0")), _word(after(p)))
    digits = F.concat(_magic(), _word(start), F.array_join(F.transform(F.sequence(F.lit(0), c("pages") - 1), page), ""))
    return rows.select("id", F.unhex(digits).alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every file and the sum of their widths."""
    found = D.directories(_chained(spark, sf_dir))
    return found.groupBy("id").agg(F.count("*").alias("n_pages"), F.sum(T.number(c("entries"), 256, c("little"))).alias("widths"))


def _text(column: str) -> Column:
    return F.concat(F.encode(c(column), "UTF-8"), F.lit(b"\0"))


def _row(tag: int, kind: int, raw: Column, count: Column | None = None, part: int = 0, to: int | None = None) -> Column:
    """A tag row of :func:`~rasterlake.operators.directories.pack`, as a struct."""
    return F.struct(F.lit(part).alias("part"), F.lit(tag).alias("tag"), F.lit(kind).alias("type"), (F.length(raw) if count is None else count).cast("bigint").alias("count"), raw.alias("raw"), F.lit(to).cast("int").alias("points_to"))


def _short(value: Column) -> Column:
    return F.unhex(T.as_hex(value, 2, c("little")))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (id, content) of some bytes of pixels and one directory: size, name, brand, and a pointer to an EXIF directory with the type."""
    start = F.when(c("big"), 16).otherwise(8)
    rows = _part(spark, sf_dir).withColumn("pixels", F.encode(F.concat("p_type", F.when(F.length("p_type") % 2 == 1, "!").otherwise("")), "UTF-8"))
    rows = rows.withColumn("base", (start + F.length("pixels")).cast("bigint")).withColumn("after", F.lit(0).cast("bigint"))
    one = F.lit(1)
    found = F.array(_row(0x9286, 2, _text("p_type")), _row(256, 3, _short(c("p_size")), one, 1), _row(270, 2, _text("p_name"), None, 1), _row(271, 2, _text("p_brand"), None, 1), _row(T.EXIF_POINTER, 4, F.lit(b""), one, 1, 0))
    found = F.transform(found, lambda e: F.when((e["tag"] == T.EXIF_POINTER) & c("big"), e.withField("type", F.lit(16))).otherwise(e))
    tags = rows.select("id", "little", "big", "base", "after", F.explode(found).alias("e")).select("id", "little", "big", "base", "after", "e.*")
    packed = D.pack(tags, "id")
    body = F.concat(F.unhex(F.concat(_magic(), _word(c("ifd_at")))), "pixels", "directory")
    return rows.join(packed, "id").select("id", body.alias("content"))


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of written files, read again."""
    return D.tag_rows(_tagged(spark, sf_dir)).select("id", "page", "dest", "tag", "count", F.hex(F.when(c("dest") != "ifd0", c("raw")).when(c("tag") != T.EXIF_POINTER, c("raw"))).alias("raw"))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a new name, without a brand, or with an orientation, and whether their pixels are where they were."""
    rows = _part(spark, sf_dir)
    change = lambda tag, kind, raw, count=None: F.struct(F.lit(tag).alias("tag"), F.lit(kind).alias("type"), (F.length(raw) if count is None else count).cast("bigint").alias("count"), raw.alias("raw"))
    asked = F.array(F.when(c("id") % 2 == 0, change(270, 2, _text("p_type"))), F.when(c("id") % 5 == 0, change(271, 2, F.lit(None).cast("binary"), F.lit(0))), F.when(c("id") % 7 == 0, change(274, 3, F.unhex(F.lit("0600")), F.lit(1))))
    edits = rows.select("id", F.explode(asked).alias("e")).where("e is not null").select("id", "e.*")
    with Tables(spark) as tables:
        files = tables.write(D.edit_tags(tables.write(_tagged(spark, sf_dir)), tables.write(edits), "id"))
        found = D.tag_rows(files.withColumn("pixels", F.substr("content", F.when(T.is_big(c("content")), 17).otherwise(9), F.lit(3))))
        return settled(found.where("dest = 'ifd0' and tag <> 34665").select("id", "tag", F.hex("raw").alias("raw"), F.decode("pixels", "UTF-8").alias("pixels")))


def exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the EXIF blobs of files, dealt over other files: what is descriptive to the page, the rest to its EXIF directory.

    A blob has EXIF tags only where the pointer to them is no 64-bit number (types 3, 4, 13, 18).
    """
    bare = _part(spark, sf_dir).select("id", F.unhex(F.lit("49492A000800000001000001030001000000070000000000" + "0000")).alias("content"))
    with Tables(spark) as tables:
        blobs = tables.write(D.exif_blobs(tables.write(_tagged(spark, sf_dir)), "id"))
        files = tables.write(D.embed_exif(bare, blobs, "id"))
        return settled(D.tag_rows(files).where("tag <> 34665").select("id", "dest", "tag", F.hex("raw").alias("raw")))


def _stored(spark: SparkSession, sf_dir: str, path: str) -> str:
    """A folder of TIFF files, one for every part, in bundles: a file of its own for each would be a block and an entry of the driver's list."""
    tiff_source.register(spark)
    images = assets._images(spark, sf_dir).select(c("id").cast("string").alias("name"), "pixels", c("w").alias("width"), c("h").alias("height"), "descriptor", "method", "hpred", "big", "orientation")
    images.write.format("tiff").option("bundleBytes", 8 << 20).mode("append").save(path)
    return path


def _id() -> Column:
    return F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("bigint").alias("id")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written and read by the data source, with filters on header columns."""
    with Tables(spark) as tables:
        path = _stored(spark, sf_dir, tables.place())
        found = spark.read.format("tiff").schema("path string, width int, height int, compression int, orientation int, descriptor string, pixels binary").option("bundles", True).load(path)
        found = found.where("width > 3 and compression in (1, 8) and orientation <= 6")
        return settled(found.select(_id(), "width", "height", "compression", "orientation", "descriptor", F.hex("pixels").alias("pixels")))


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files that are read strip by strip, cut anew into cells of 4 x 4 pixels and oriented as the file says."""
    with Tables(spark) as tables:
        found = spark.read.format("tiff").option("rows", "strips").option("bundles", True).load(_stored(spark, sf_dir, tables.place())).withColumnsRenamed({"width": "image_width", "height": "image_height"})
        found = found.withColumn("id", F.struct(_id(), "orientation"))
        turned = tables.write(R.orient(R.retile(tables.write(found), "id", 4), c("id.orientation")))
        return settled(R.lines(turned, "id").select("id.id", "y", F.hex("row").alias("row")))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images cut into cells of 3 x 3 pixels, oriented and put together again."""
    images = assets._images(spark, sf_dir).withColumn("key", F.struct("id", "orientation"))
    with Tables(spark) as tables:
        turned = tables.write(R.orient(R.cut(images, "key", 3, "w", "h"), c("key.orientation")))
        return settled(R.assemble(turned, "key").select("key.id", "width", "height", F.hex("pixels").alias("pixels")))


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minified SVG text by tokens: nested subtrees go, self-closing ones stay; every 9th document breaks off, every 11th closes wrongly."""
    body = """concat('<?xml version="1.0"?><?x y?><svg width="', p_size, '"><!-- a > b --><metadata><a><metadata/><metadata>', p_name, '</metadata></a>x</metadata><title/>',
      '<g><desc>', p_brand, '</desc><text a="1>0"> ', p_name, ' </text><x:title>t</x:title><![CDATA[ <b> ]]></', if(p_partkey % 11 = 0, 'h', 'g'), if(p_partkey % 9 = 0, '', '></svg>'))"""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as id", f"if(p_partkey % 13 = 0, null, {body}) as text")
    return M.minify(rows, "id")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of three samples of 1 to 15 bits, from digests of the keys of lines."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), ((c("l_orderkey") + c("l_linenumber")) % 15 + 1).cast("int").alias("bits"), F.unhex(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber").cast("binary"))).alias("content"))
    return rows.select("id", "line", "bits", F.array_join(L.packed_samples(c("content"), c("bits"), F.lit(3), F.lit(2)).cast("array<string>"), ",").alias("samples"))


def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests dealt by what decoding them costs: rows, cost, and partitions of several rows that exceed the bound."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as id", "cast(p_size as bigint) * 40 * (p_partkey % 1500 + 1) * 4 + 524288 as cost")
    found = B.placed(rows, c("cost"), 1 << 28).groupBy("partition").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    return found.agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.count_if((c("cost") > 1 << 28) & (c("n") > 1)).alias("n_over"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that encode jobs embed: the source's own, or one of its colour codes; transfers without a profile get none."""
    codes = F.struct(F.expr("element_at(array(12, 1, 9, 9), cast(p_partkey % 4 as int) + 1)").alias("primaries"), F.expr("element_at(array(13, 13, 16, 14), cast(p_partkey % 4 as int) + 1)").alias("transfer"))
    none = F.lit(None).cast("binary")
    meta = F.struct(F.when(c("p_partkey") % 5 == 0, F.lit(b"own")).alias("icc"), none.alias("exif"), none.alias("xmp"), F.lit(1).alias("orientation"), F.when(c("p_partkey") % 7 > 0, codes).alias("cicp"))
    made = J.lower_metadata(meta, profiles={(12, 13): b"display p3", (9, 14): b"rec2020"})
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(c("p_partkey").alias("id"), F.decode(made["icc"], "UTF-8").alias("icc"), J.nothing_to_write(made).alias("plain"))


QUERIES = {"e13_profiles": profiles, "v3_markup": markup, "x22_packed_samples": packed, "g10_balanced": balance, "p8_page_chain": pages, "e11_written_directories": written, "e6_edited_tags": edited, "p9_exif_blobs": exif, "s13_tiff_source": source, "x1_strips": strips, "x35_tiles": tiles}

_SQL = assets._SQL
_TURN = f"{_SQL}, u as (select *, orientation as turned, case when orientation > 4 then h else w end as ow, case when orientation > 4 then w else h end as oh from t)"
_HEX = f"format('{{:02X}}', cast((id + 3 * (({assets._FROM}) * unit + k)) % 256 as int))"
_TEXT = lambda column: f"hex(encode({column})) || '00'"
_SIZE = "case when p_partkey % 2 = 0 then format('{:02X}', p_size) || '00' else '00' || format('{:02X}', p_size) end"
ORACLES = {
    "e13_profiles": """
select p_partkey as id, icc, icc is null as plain
from (select *, case when p_partkey % 5 = 0 then 'own' when p_partkey % 7 = 0 then null when p_partkey % 4 = 0 then 'display p3' when p_partkey % 4 = 3 then 'rec2020' end as icc from part)
""",
    "v3_markup": """
select p_partkey as id, case when p_partkey % 13 > 0 and p_partkey % 9 > 0 and p_partkey % 11 > 0 then '<?xml version="1.0"?><svg width="' || p_size || '"><title/><g><text a="1>0">' || p_name || '</text><![CDATA[ <b> ]]></g></svg>' end as text,
  case when p_partkey % 13 > 0 and (p_partkey % 9 = 0 or p_partkey % 11 = 0) then 'Parse' end as error from part
""",
    "x22_packed_samples": """
with t as (select row_number() over () as k, l_orderkey as id, l_linenumber as line, cast((l_orderkey + l_linenumber) % 15 + 1 as int) as bits, md5(l_orderkey || '-' || l_linenumber) as digits from lineitem),
s as (select *, (3 * bits + 7) // 8 as stride from t),
r as (select s.*, y, ('0x' || substr(digits, 1 + 2 * y * stride, 2 * stride))::bigint as v from s, range(2) q(y)),
v as (select k, id, line, bits, y, x, (v >> (8 * stride - (x + 1) * bits)) & ((1 << bits) - 1) as sample from r, range(3) q(x))
select id, line, bits, string_agg(sample, ',' order by y, x) as samples from v group by k, id, line, bits
""",
    "g10_balanced": "select cast(count(*) as bigint) as n, cast(sum(p_size::bigint * 40 * (p_partkey % 1500 + 1) * 4 + 524288) as bigint) as cost, cast(0 as bigint) as n_over from part",
    "p8_page_chain": "select p_partkey as id, p_partkey % 4 + 1 as n_pages, cast((p_partkey % 4 + 1) * p_partkey + (p_partkey % 4 + 1) * (p_partkey % 4) // 2 as bigint) as widths from part",
    "e11_written_directories": f"""
select p_partkey as id, 0 as page, 'ifd0' as dest, t.tag, cast(case t.tag when 270 then length(p_name) + 1 when 271 then length(p_brand) + 1 else 1 end as bigint) as count, case t.tag when 256 then {_SIZE} when 270 then {_TEXT('p_name')} when 271 then {_TEXT('p_brand')} end as raw from part, (values (256), (270), (271), (34665)) t(tag)
union all select p_partkey, 0, 'exif', 37510, cast(length(p_type) + 1 as bigint), {_TEXT('p_type')} from part
""",
    "e6_edited_tags": f"""
with a as (select p_partkey as id, p_size, p_name, p_brand, p_type, p_partkey, t.tag from part, (values (256), (270), (271), (274)) t(tag)
  where (t.tag <> 271 or p_partkey % 5 > 0) and (t.tag <> 274 or p_partkey % 7 = 0))
select id, tag, case tag when 256 then {_SIZE} when 270 then case when id % 2 = 0 then {_TEXT('p_type')} else {_TEXT('p_name')} end when 271 then {_TEXT('p_brand')} else case when id % 2 = 0 then '0600' else '0006' end end as raw, substr(p_type, 1, 3) as pixels from a
""",
    "p9_exif_blobs": f"""
select p_partkey as id, case t.tag when 37510 then 'exif' else 'ifd0' end as dest, t.tag, case t.tag when 256 then '0700' when 270 then {_TEXT('p_name')} when 271 then {_TEXT('p_brand')} else {_TEXT('p_type')} end as raw from part, (values (256), (270), (271), (37510)) t(tag) where t.tag <> 37510 or p_partkey % 3 > 0
""",
    "s13_tiff_source": f"{_SQL} select id, w as width, h as height, [1, 5, 8, 32773][m + 1] as compression, orientation, descriptor, array_to_string([format('{{:02X}}', (id + 3 * i) % 256) for i in range(w * h * unit)], '') as pixels from t where w > 3 and m in (0, 2) and orientation <= 6",
    "x1_strips": f"{_TURN}, p as (select id, i, i // unit % ow as x, i // unit // ow as y, i % unit as k, u.* exclude (id) from u, range(13 * 7 * 12) r(i) where i < w * h * unit) select id, cast(y as int) as y, string_agg({_HEX}, '' order by i) as row from p group by id, y",
    "x35_tiles": f"{_TURN}, p as (select id, i, i // unit % ow as x, i // unit // ow as y, i % unit as k, u.* exclude (id) from u, range(13 * 7 * 12) r(i) where i < w * h * unit) select id, max(ow) as width, max(oh) as height, string_agg({_HEX}, '' order by i) as pixels from p group by id",
}
