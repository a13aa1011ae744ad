"""Registered queries of the engine's own operators and the SQL that they are held against.

Inputs are derived from columns of the tables by the same SQL on both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import assets, oracles, raster_queries, requests
from .functions import limits as L
from .functions import tags
from .plans import dimensions, variants

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Derived inputs: name -> (table, SQL select list valid in both engines).
INPUTS = {
    "px": ("lineitem", "l_orderkey as id, l_linenumber as line, cast(l_partkey % 256 as int) as c, cast(l_suppkey % 256 as int) as m, cast(l_orderkey % 256 as int) as y, cast((l_linenumber * 37) % 256 as int) as k, cast(floor(l_quantity) as int) % 256 as a"),
    "req": ("part", "p_partkey as id, cast(p_size * 40 as bigint) as w, cast(p_partkey % 1500 + 1 as bigint) as h, case cast(p_partkey % 10 as int) when 0 then 'gray' when 1 then 'graya' when 2 then 'rgb' when 3 then 'rgba' when 4 then 'palette' when 5 then 'cmyk' when 6 then 'cmyka' when 7 then 'ycbcr' when 8 then 'lab' else 'multiband' end as color, case cast(p_partkey % 5 as int) when 0 then 1 when 1 then 8 when 2 then 16 when 3 then 32 else 64 end as bits, cast(p_partkey % 6 + 1 as int) as samples, p_partkey % 3 = 0 as is_float"),
    "svgreq": ("part", "p_partkey as id, cast(p_size as int) as w, cast(p_partkey % 400 + 1 as int) as h, case when p_partkey % 3 = 0 then null else cast(p_partkey % 900 + 1 as int) end as tw, case when p_partkey % 5 < 2 then null else cast(p_size * 17 % 700 + 1 as int) end as th, case cast(p_partkey % 4 as int) when 0 then 'original' when 1 then 'contain' when 2 then 'cover' else 'fill' end as fit, case cast(p_partkey % 3 as int) when 0 then 0.5 when 1 then 1.0 else 2.0 end as scale"),
    "doc": ("part", "p_partkey as id, case cast(p_partkey % 8 as int) when 0 then '<svg width=\"10\">' when 1 then '  <?xml version=\"1.0\"?>' when 2 then '%PDF-1.7' when 3 then ' %PDF-1.4' when 4 then '<html><p><svg></svg>' when 5 then '<!DOCTYPE SVG>' when 6 then '<html>' else p_name end as body"),
    "pdfreq": ("orders", "o_orderkey as id, cast(o_orderkey % 7 as int) as n, case cast(o_custkey % 3 as int) when 0 then 595.28 when 1 then 612.0 else 0.0 end as pw, case cast(o_custkey % 3 as int) when 0 then 841.89 when 1 then 792.0 else 100.0 end as ph, case cast(o_orderkey % 6 as int) when 0 then 'scale' when 1 then 'dpi' when 2 then 'width' when 3 then 'height' when 4 then 'box' else 'exact' end as kind, case cast(o_orderkey % 6 as int) when 0 then 1.5 else cast(o_orderkey % 1999 as double) + 1 end as a, cast(o_orderkey % 4001 as double) as b, case cast(o_orderkey % 4 as int) when 0 then 'all' when 1 then 'single' when 2 then 'range' else 'list' end as sel, cast(o_orderkey % 5 as int) as p0, cast(o_custkey % 6 as int) as p1"),
    "ev": ("events", "event_id as id, cast(event_id % 10 as int) as tag, cast(user_id % 40 + 1 as bigint) as w, cast(event_id % 30 + 1 as bigint) as h, cast(event_id % 47 as int) as variant_id, cast(event_id % 65536 as int) as exif_tag"),
    "big": ("part", "p_partkey as id, cast(case cast(p_partkey % 3 as int) when 0 then 4294967295 when 1 then 65536 else p_size end as bigint) as w, cast(case cast(p_partkey % 5 as int) when 0 then 4294967295 when 1 then 2147483648 else p_partkey end as bigint) as h, cast(p_partkey % 4 * 4 + 1 as int) as bpp"),
    "box": ("orders", "o_orderkey as id, case cast(o_custkey % 5 as int) when 0 then cast('NaN' as double) when 1 then cast('Infinity' as double) when 2 then 0.0 else 612.0 end as pw, 792.0 + o_custkey % 3 as ph, case cast(o_orderkey % 6 as int) when 0 then 'scale' when 1 then 'dpi' when 2 then 'width' when 3 then 'height' when 4 then 'box' else 'exact' end as kind, case when o_orderkey % 11 = 0 and o_orderkey % 6 < 5 then cast('NaN' as double) when o_orderkey % 11 = 1 then 0.0 else cast(o_orderkey % 1999 as double) + 1 end as a, cast(o_orderkey % 4001 as double) + 1 as b"),
    "res": ("supplier", "s_suppkey as id, cast(s_suppkey % 5 as int) as unit, cast(s_suppkey * 100 as bigint) as num, cast(s_suppkey % 4 as bigint) as den"),
}


def _query(name: str, source: str, columns: Callable[[DataFrame], list[Column]], sql: str, more: str = "id", source_sql: str = "t", prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    table, select = INPUTS[source]
    keys = more.split(",")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*_split(select))
        rows = prepare(rows) if prepare else rows
        return rows.select(*keys, *columns(rows))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"with t as (select {select} from {table}) select {more}, {sql} from {source_sql}"


def _split(select: str) -> list[str]:
    """The items of a select list; commas in parentheses or quotes don't separate."""
    out, depth, quoted, item = [], 0, False, ""
    for ch in select:
        quoted ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quoted else 0
        if ch == "," and not depth and not quoted:
            out.append(item)
            item = ""
        else:
            item += ch
    return [*out, item]


c = F.col
_MAX = lambda: (F.lit(1600), F.lit(1400), F.lit(1500000), F.lit(6 << 20))

_query("s_sniff", "doc", lambda d: [L.is_svg(c("body").cast("binary")).alias("svg"), L.is_pdf(c("body").cast("binary")).alias("pdf"), L.sniff(c("body").cast("binary")).alias("format")],
       "svg, pdf, case when pdf then 'pdf' when svg then 'svg' end as format",
       source_sql="(select *, head like '<svg%' or head like '<?xml%' or head like '<!doctype svg%' or contains(head, '<svg') as svg, starts_with(body, '%PDF-') as pdf from (select *, ltrim(lower(substr(body, 1, 256)), ' ') as head from t))")
_query("p3_dpi", "res", lambda d: [F.round(L.dpi(c("unit"), c("num"), c("den")), 6).alias("dpi")],
       "round(case when den = 0 then null when unit = 2 then cast(num as double) / den when unit = 3 then cast(num as double) / den * 2.54 end, 6) as dpi")
_CH = "case when color in ('cmyk', 'cmyka') then 4 when color = 'palette' then 3 when color = 'multiband' and samples = 2 then 2 else samples end"
_BY = "case when bits <= 8 then 1 when bits <= 16 then 2 when bits <= 32 then 4 else 8 end"
_FA = "case when bits = 8 and color in ('gray', 'graya', 'rgb', 'rgba') then 1 else 2 end"


def _decode(d: DataFrame) -> list[Column]:
    bpp = L.output_channels(c("color"), c("samples")) * L.sample_bytes(c("bits"))
    factor = L.peak_factor(c("color"), c("bits"))
    return [bpp.alias("bpp"), factor.alias("factor"), L.decode_limits(c("w"), c("h"), bpp, factor, *_MAX()).alias("violated")]


_query("l1_decode_limits", "req", _decode, f"cast(({_CH}) * ({_BY}) as bigint) as bpp, cast({_FA} as bigint) as factor, case when w > 1600 then 'width' when h > 1400 then 'height' when w * h > 1500000 then 'pixels' when w * h * ({_CH}) * ({_BY}) * ({_FA}) + 524288 > 6291456 then 'memory' end as violated")
_query("l8_encode_limits", "req", lambda d: [L.encode_limits(c("w"), c("h"), L.sample_bytes(c("bits")) * c("samples"), *_MAX()).alias("violated")],
       f"case when w * h > 1500000 then 'pixels' when w > 1600 then 'width' when h > 1400 then 'height' when w * h * samples * ({_BY}) > 6291456 then 'memory' end as violated")
_query("l14_jp2_limits", "req", lambda d: [L.raster_limits(c("w"), c("h"), F.lit(1600), F.lit(1400), F.lit(1500000), F.lit(5 << 20)).alias("violated")],
       "case when w > 1600 then 'width' when h > 1400 then 'height' when w * h > 1500000 then 'pixels' when w * h * 4 > 5242880 then 'memory' end as violated")
def _merged(d: DataFrame) -> list[Column]:
    none = F.lit(None).cast("bigint")
    asked = F.struct(F.when(c("id") % 2 == 0, c("w")).alias("max_pixels"), F.when(c("id") % 3 == 0, c("w") * c("h") * 1000).alias("max_memory"), none.alias("max_width"), c("h").alias("max_height"))
    found = L.effective_limits(asked)
    buffers = L.tightened_buffers(found["max_memory"])
    return [*[found[x].alias(x) for x in ("max_pixels", "max_memory", "max_height")], buffers["decoding"].alias("decoding"), buffers["intermediate"].alias("intermediate")]


_query("l6_limit_merge", "req", _merged, "coalesce(case when id % 2 = 0 then w end, 120000000) as max_pixels, m as max_memory, h as max_height, least(268435456, m) as decoding, least(134217728, m) as intermediate",
       source_sql="(select *, coalesce(case when id % 3 = 0 then w * h * 1000 end, 4294967296) as m from t)")
_query("l17_overflow", "big", lambda d: [L.decode_limits(c("w"), c("h"), c("bpp"), F.lit(2), c("w"), c("h"), *[F.lit(x).cast("bigint") for x in (None, 9223372036854775806)]).alias("decode"), L.encode_limits(c("w"), c("h"), c("bpp"), c("w"), c("h"), F.lit(9223372036854775806), F.lit(4 << 30)).alias("encode"), L.product(c("w"), c("h"), c("bpp")).alias("bytes"), L.estimate(F.lit("tiff_decode"), L.product(c("w"), c("h")), L.product(c("w"), c("h"), c("bpp")))[1].alias("most")],
       "case when least(w * h * bpp * 2 + 524288, 9223372036854775807) > 9223372036854775806 then 'memory' end as decode, case when least(w * h, 9223372036854775807) > 9223372036854775806 then 'pixels' when w * h * bpp > 4294967296 then 'memory' end as encode, cast(least(w * h * bpp, 9223372036854775807) as bigint) as bytes, cast(least(w * h * bpp * 2 + 524288, 9223372036854775807) as bigint) as most",
       source_sql="(select id, w::hugeint as w, h::hugeint as h, bpp::hugeint as bpp from t)")
_query("x3_descriptor", "req", lambda d: [L.descriptor(c("color"), c("bits"), c("is_float"), c("samples")).alias("descriptor"), L.has_alpha(c("color"), c("samples")).alias("has_alpha")],
       "case when color = 'gray' then 'gray' when color = 'graya' then 'graya' when color in ('rgb', 'ycbcr', 'lab', 'palette') then 'rgb' when color = 'multiband' and samples = 1 then 'gray' when color = 'multiband' and samples = 2 then 'graya' when color = 'multiband' and samples = 3 then 'rgb' else 'rgba' end || '_' || case when bits <= 8 or color = 'palette' then 'u8' when is_float then 'f32' else 'u16' end as descriptor, color in ('graya', 'rgba', 'cmyka') or (color = 'multiband' and samples in (2, 4)) as has_alpha")


def _estimates(d: DataFrame) -> list[Column]:
    out = []
    for codec in L.ESTIMATES:
        typical, most, wall = L.estimate(F.lit(codec), c("w") * c("h"), c("w") * c("h") * 4)
        out += [typical.alias(f"{codec}_typical"), most.alias(f"{codec}_most"), wall.alias(f"{codec}_ms")]
    return out


_EST = {"tiff_decode": ("w*h*4 + 524288", "2*w*h*4 + 524288", 120000), "tiff_encode": ("2*w*h*4 + 1048576", "2*(2*w*h*4 + 1048576)", 200000), "svg": ("4*w*h*4 + 16777216", "8*w*h*4 + 16777216", 30000), "pdf": ("4*w*h*4 + 16777216", "8*w*h*4 + 16777216", 25000), "jp2": ("2*w*h*4 + 8388608", "2*(2*w*h*4 + 8388608)", 60000)}
_query("g10_estimates", "req", _estimates, ", ".join(f"{t} as {k}_typical, {m} as {k}_most, (w*h) // {s} as {k}_ms" for k, (t, m, s) in _EST.items()))


def _svg(d: DataFrame) -> list[Column]:
    w, h = L.svg_size(c("w"), c("h"), c("tw"), c("th"), c("fit"), c("scale"))
    return [w.alias("out_w"), h.alias("out_h"), L.raster_limits(w, h, F.lit(800), F.lit(800), F.lit(300000)).alias("violated")]


_query("g1_svg_geometry", "svgreq", _svg, """cast(ow as bigint) as out_w, cast(oh as bigint) as out_h, case when ow > 800 then 'width' when oh > 800 then 'height' when ow * oh > 300000 then 'pixels' end as violated""", source_sql="""(select *, ceil(cast(w as float) * sx) as ow, ceil(cast(h as float) * sy) as oh from (select *, case when tw is not null and th is not null and fit = 'fill' then cast(ry * cast(scale as float) as float) else sx end as sy from (select *,
case when tw is not null and th is not null and fit = 'fill' then rx * cast(scale as float) when tw is not null and th is not null and fit = 'cover' then greatest(rx, ry) * cast(scale as float) when tw is not null and th is not null then least(rx, ry) * cast(scale as float) when tw is not null then rx * cast(scale as float) when th is not null then ry * cast(scale as float) else cast(scale as float) end as sx
from (select *, cast(tw as float) / cast(w as float) as rx, cast(th as float) / cast(h as float) as ry from t))))""")


def _pdf(d: DataFrame) -> DataFrame:
    """The final size as columns, which the verdict reads."""
    w, h = L.pdf_size(F.when(c("pw") > 0, c("pw")).otherwise(1.0), c("ph"), c("kind"), c("a"), c("b"))
    return d.withColumns({"out_w": w, "out_h": h})


def _bounds(d: DataFrame) -> DataFrame:
    w, h = L.pdf_size(c("pw"), c("ph"), c("kind"), c("a"), c("b"))
    return L.pdf_output_size(d.withColumns({"fw": w, "fh": h}), c("pw"), c("ph"), c("kind"), c("a"), c("b"))


_PW = "cast(case when pw > 0 then pw else 1.0 end as float)"
_query("g5_pdf_geometry", "pdfreq", lambda d: [c("out_w"), c("out_h"), L.pdf_verdict(c("pw"), c("ph"), c("out_w"), c("out_h"), F.lit(2000000)).alias("error")], prepare=_pdf, sql=f"""ow as out_w, oh as out_h, case when pw <= 0 or ph <= 0 then 'ZeroDimensions' when ow < 1 or oh < 1 then 'InvalidRenderBounds' when ow > 65535 or oh > 65535 then 'DimensionOverflow' when ow * oh > 2000000 then 'PixelLimitExceeded' end as error""", source_sql=f"""(select *, cast(case when kind = 'exact' then floor(a) else floor({_PW} * s) end as bigint) as ow, cast(case when kind = 'exact' then floor(b) else floor(cast(ph as float) * s) end as bigint) as oh from (select *, cast(case kind when 'scale' then cast(a as float) when 'dpi' then cast(a as float) / cast(72 as float) when 'width' then cast(a as float) / {_PW} when 'height' then cast(a as float) / cast(ph as float) else least(cast(a as float) / {_PW}, cast(b as float) / cast(ph as float)) end as float) as s from t))""")
_query("g7_pdf_output_size", "box", lambda d: [c("out_w"), c("out_h"), c("error"), L.pdf_verdict(c("pw"), c("ph"), c("fw"), c("fh"), F.lit(120000000), c("a")).alias("verdict")],
       """case when error is null then cast(floor(case when kind = 'exact' then a else rw end) as bigint) end as out_w, case when error is null then cast(floor(case when kind = 'exact' then b else rh end) as bigint) end as out_h, error,
case when pw = 0 or isnan(pw) or isinf(pw) then 'ZeroDimensions' when isnan(a) or fw < 1 or fh < 1 then 'InvalidRenderBounds' when fw > 65535 or fh > 65535 then 'DimensionOverflow' when fw * fh > 120000000 then 'PixelLimitExceeded' end as verdict""",
       source_sql="""(select *, case when pw = 0 or isnan(pw) or isinf(pw) then 'ZeroDimensions' when kind <> 'exact' and (isnan(rw) or isnan(rh) or rw < 1 or rh < 1) then 'InvalidRenderBounds' end as error
from (select *, case when kind = 'width' then cast(a as float) else cast(612 as float) * s end as rw, case when kind = 'height' then cast(a as float) else cast(ph as float) * s end as rh, case when kind = 'exact' then a else floor(cast(612 as float) * s) end as fw, case when kind = 'exact' then b else floor(cast(ph as float) * s) end as fh
from (select *, cast(case kind when 'scale' then cast(a as float) when 'dpi' then cast(a as float) / cast(72 as float) when 'width' then cast(a as float) / cast(612 as float) when 'height' then cast(a as float) / cast(ph as float) else least(cast(a as float) / cast(612 as float), cast(b as float) / cast(ph as float)) end as float) as s from t)))""", prepare=_bounds)
_query("g8_page_selection", "pdfreq", lambda d: [F.array_join(L.page_indices(c("sel"), c("p0"), c("p1"), c("n")).cast("array<string>"), ",").alias("pages"), L.page_clamp(c("p0"), c("n")).alias("clamped"), L.too_many_pages(L.page_indices(c("sel"), c("p0"), c("p1"), c("n")), 4).alias("too_many")],
       "case when sel = 'all' then array_to_string(range(0, n), ',') when sel = 'single' and p0 < n then cast(p0 as varchar) when sel = 'range' and p0 < n and p1 < n then array_to_string(range(p0, p1 + 1), ',') when sel = 'list' and p0 < n and p1 < n then concat_ws(',', p0, p1, p0) end as pages, least(p0, greatest(n - 1, 0)) as clamped, case when sel = 'all' and n > 4 or sel = 'range' and p0 < n and p1 < n and p1 - p0 >= 4 then 'TooManyPages' end as too_many")
_query("x16_cmyk8", "px", lambda d: [L.cmyk8(c("c"), c("k")).alias("r"), L.cmyk8(c("m"), c("k")).alias("g"), L.cmyk8(c("y"), c("k")).alias("b")],
       ", ".join(f"cast(floor((cast(1 as float) - cast({i} as float) / cast(255 as float)) * (cast(1 as float) - cast(k as float) / cast(255 as float)) * cast(255 as float) + cast(0.5 as float)) as int) as {o}" for i, o in (("c", "r"), ("m", "g"), ("y", "b"))), more="id,line")
_query("x18_cmyk16", "px", lambda d: [L.cmyk16(c("c") * 257, c("k") * 257).alias("r"), L.cmyk16(c("m") * 257, c("k") * 257).alias("g")],
       ", ".join(f"cast(floor((1 - {i} * 257 / 65535.0::double) * (1 - k * 257 / 65535.0::double) * 65535 + 0.5) as int) as {o}" for i, o in (("c", "r"), ("m", "g"))), more="id,line")
_query("x26_unpremultiply", "px", lambda d: [L.unpremultiply(c("c"), c("a")).alias("r"), L.unpremultiply(c("m"), c("a")).alias("g")],
       ", ".join(f"case when a = 0 then 0 when a = 255 then {i} else least(255, ({i} * 255 + a // 2) // a) end as {o}" for i, o in (("c", "r"), ("m", "g"))), more="id,line")
#: A key times 2^47, as a decimal: ids of 65,536 and more are beyond a bigint.
_shifted = lambda key: key.cast("decimal(20,0)") * F.lit(1 << 47).cast("decimal(15,0)")
_query("x8_sample_conversion", "px", lambda d: [L.narrow_signed(c("c") - 128, 8).alias("i8"), L.narrow_signed(c("c") * 257 - 32768, 16).alias("i16"), L.narrow_signed(c("id") - 5000, 32).alias("i32"), L.narrow_signed(_shifted(c("id") - 5000), 64, wide=True).alias("i64"), L.narrow_unsigned(c("id") * 65537, 32).alias("u32"), L.narrow_unsigned(_shifted(c("id")), 64, wide=True).alias("u64")],
       "cast((id - 5000 + 65536) // 2 as int) as i64, cast(id // 2 as int) as u64, c as i8, c * 257 as i16, cast((id - 5000 + 2147483648) >> 16 as int) as i32, cast((id * 65537) >> 16 as int) as u32", more="id,line")
_query("x5_unpack", "px", lambda d: [F.array_join(L.unpack_bits(c("c"), n).cast("array<string>"), ",").alias(f"b{n}") for n in (1, 2, 4)],
       ", ".join("concat_ws(','" + "".join(f", ((c >> {i}) & {(1 << n) - 1}) * 255 // {(1 << n) - 1}" for i in range(8 - n, -1, -n)) + f") as b{n}" for n in (1, 2, 4)), more="id,line")
_query("x14_channels", "px", lambda d: [F.array_join(L.fit_channels(samples, F.lit(n), largest).cast("array<string>"), ",").alias(name) for samples, n, largest, name in ((F.array("c", "m", "y", "k"), 3, 255, "cut"), (F.array("c", "m"), 4, 255, "padded"), (F.array("c", "m", "y", "k", "a"), 4, 65535, "cut16"), (F.array("c"), 3, 65535, "padded16"))],
       "concat_ws(',', c, m, y) as cut, concat_ws(',', c, m, 255, 255) as padded, concat_ws(',', c, m, y, k) as cut16, concat_ws(',', c, 65535, 65535) as padded16", more="id,line")


def _orient(d: DataFrame) -> list[Column]:
    w, h = L.oriented(c("tag"), c("w"), c("h"))
    x, y = L.oriented_pixel(c("tag"), c("w") % 7 % c("w"), c("h") % 5 % c("h"), c("w"), c("h"))
    return [w.alias("out_w"), h.alias("out_h"), x.alias("x"), y.alias("y")]


_X, _Y = "(w % 7 % w)", "(h % 5 % h)"
_query("x35_orientation", "ev", _orient, f"case when tag between 5 and 8 then h else w end as out_w, case when tag between 5 and 8 then w else h end as out_h, case tag when 2 then w-1-{_X} when 3 then w-1-{_X} when 5 then {_Y} when 6 then h-1-{_Y} when 7 then h-1-{_Y} when 8 then {_Y} else {_X} end as x, case tag when 3 then h-1-{_Y} when 4 then h-1-{_Y} when 5 then {_X} when 6 then {_X} when 7 then w-1-{_X} when 8 then w-1-{_X} else {_Y} end as y")
_query("e8_exif_routing", "ev", lambda d: [tags.exif_destination(c("exif_tag")).alias("dest"), F.element_at(F.array(*[F.lit(n) for n in dimensions.FIELD_SIZES]), (c("tag") % 12 + 1)).alias("field_size")],
       "case when exif_tag in (40965, 256, 257, 258, 259, 262, 273, 274, 277, 278, 279, 282, 283, 284, 296) then null when exif_tag in (269, 270, 271, 272, 305, 306, 315, 316, 33432, 700) then 'ifd0' when exif_tag = 34853 then 'gps' else 'exif' end as dest, [1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8][tag % 12 + 1] as field_size")


def _error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(event_id % 47 as int) as variant_id")
    return events.join(F.broadcast(dimensions.errors(spark)), "variant_id").groupBy("codec", "origin", "kind").agg(F.count("*").alias("n"))


QUERIES["e_error_categories"] = _error_counts
ORACLES["e_error_categories"] = f"select codec, origin, kind, count(*) as n from events join {oracles.ERRORS} on v.variant_id = event_id % 47 group by all"
def _cell_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as id", "concat('tiff-', element_at(array('none', 'lzw', 'deflate', 'packbits', 'zstd'), cast(p_partkey % 5 as int) + 1), element_at(array('', '-hpred', '-big', '-big-hpred', '-warp', '-hpred-x'), cast(p_partkey % 6 as int) + 1)) as cell")
    found = variants.parse_cell_id("cell")
    return parts.select("id", found["method"].alias("method"), found["hpred"].alias("hpred"), found["big"].alias("big"))


QUERIES["w6_cell_ids"] = _cell_ids
ORACLES["w6_cell_ids"] = """with t as (select p_partkey as id, p_partkey % 5 as m, p_partkey % 6 as f from part), g as (select *, m < 4 and f < 4 and not (m = 0 and f in (1, 3)) as good from t)
select id, case when good then ['none', 'lzw', 'deflate', 'packbits'][m + 1] end as method, case when good then f in (1, 3) end as hpred, case when good then f in (2, 3) end as big from g"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every image request decodes to and whether it passes the limits."""
    table, select = INPUTS["req"]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*_split(select))
    verdict = F.coalesce(_decode(rows)[2], F.lit("ok"))
    return rows.groupBy(L.descriptor(c("color"), c("bits"), c("is_float"), c("samples")).alias("descriptor"), verdict.alias("verdict")).agg(F.count("*").alias("n"), F.sum(c("w") * c("h")).alias("pixels"))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = "with d as (" + ORACLES["x3_descriptor"] + "), l as (" + ORACLES["l1_decode_limits"] + ") select descriptor, coalesce(violated, 'ok') as verdict, count(*) as n, cast(sum(p_size * 40 * (p_partkey % 1500 + 1)) as bigint) as pixels from d join l using (id) join part on p_partkey = id group by all"

for _more in (assets, requests, raster_queries):
    QUERIES |= _more.QUERIES
    ORACLES |= _more.ORACLES
