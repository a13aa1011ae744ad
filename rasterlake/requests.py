"""Registered queries that hold rows of requests against the fixed tables: formats, capabilities, descriptors, compressions, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import assets, oracles
from .functions import limits as L
from .plans import dimensions, variants

CODECS, OPERATIONS = ("tiff", "svg", "pdf", "jp2"), ("tiff_decode", "tiff_encode", "svg", "pdf", "jp2")
FLAGS = ("cheap_probe", "icc", "exif", "xmp", "stop", "gray", "bits16", "f32", "alpha", "hdr", "lossless", "multi_image", "max_pixels", "max_memory", "max_input")
ASKED = ("row_level_decode", "animation_decode", "animation_encode", "decode")
KINDS = ("gray_u8", "rgb_u16", "rgba_u8", "graya_f32", "rgb_u8", "rgba_f16")
CODES = (1, 3, 4, 5, 7, 8, 32773, 32946, 50000, 50001, 9)


def _pick(items: tuple, number: str) -> str:
    """SQL, of both engines, for the item of a list that a number chooses."""
    return f"case cast({number} % {len(items)} as int) " + " ".join(f"when {i} then {x!r}" for i, x in enumerate(items)) + " end"


_EVENTS = [
    "event_id as id", f"{_pick(CODECS, 'event_id')} as codec", f"{_pick(OPERATIONS, 'event_id')} as operation", f"{_pick(FLAGS, 'user_id')} as flag", f"{_pick(ASKED, 'user_id')} as asked",
    f"{_pick(KINDS, 'user_id')} as descriptor", "case when event_id % 3 = 0 then 'encode' else 'decode' end as direction", f"{_pick(CODES, 'event_id')} as code",
]
_T = f"with t as (select {', '.join(_EVENTS)} from events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_EVENTS)


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the format of every file, by its first bytes."""
    found = assets.sniffed(spark, sf_dir).join(F.broadcast(dimensions.formats(spark)), "format", "left")
    return found.select("id", "format", "extension", "mime", "animation", "lossy", "bytes_needed")


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an operation has what a request needs."""
    known = F.broadcast(dimensions.capabilities(spark).withColumn("able", F.lit(True)))
    return _events(spark, sf_dir).join(known, ["operation", "flag"], "left").select("id", "operation", "flag", F.coalesce("able", F.lit(False)).alias("able"))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a codec gives or takes the pixels of a request."""
    known = F.broadcast(dimensions.descriptors(spark).withColumn("supported", F.lit(True)))
    return _events(spark, sf_dir).join(known, ["codec", "direction", "descriptor"], "left").groupBy("codec", "direction", "descriptor").agg(F.count("*").alias("n"), F.count("supported").alias("n_supported"))


def source_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request's source tells of its losses."""
    return _events(spark, sf_dir).join(F.broadcast(dimensions.source_details(spark)), "codec", "left").select("id", "codec", "lossless", "quality")


def compressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the compression codes of requests, and how many can be read."""
    found = _events(spark, sf_dir).join(F.broadcast(dimensions.compressions(spark)), "code", "left")
    return found.groupBy("code", "compression").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("readable"), F.lit(False)).alias("readable"))


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error category of operations that a codec refuses; null for the others."""
    known = dimensions.refused_operations(spark).withColumn("variant", F.when(F.col("codec") == "jp2", "UnsupportedOperation").otherwise("Unsupported"))
    why = known.join(dimensions.errors(spark), ["codec", "variant"]).select("codec", F.col("operation").alias("asked"), "origin", "kind")
    return _events(spark, sf_dir).join(F.broadcast(why), ["codec", "asked"], "left").select("id", "codec", "asked", "origin", "kind")


def variant_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant plan of every request, under its own axes (all or methods only), tier and deviations; null is no bound."""
    asked = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as id", "p_partkey % 2 = 0 as all_axes", "if(p_size % 5 < 4, cast(p_size % 5 as int), null) as max_tier", "if(p_partkey % 4 > 0, cast(p_partkey % 4 - 1 as int), null) as max_deviations")
    return variants.plans_of(asked, "id").select("id", "position", "cell_id", "deviations", "tier", "dropped")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three bytes of every event."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    part = lambda c, by: F.pmod(F.col(c), F.lit(by)).cast("int")
    return rows.select(F.col("event_id").alias("id"), L.fingerprint(part("event_id", 256), part("user_id", 256), part("event_id", 7)).alias("fingerprint"))


QUERIES = {
    "s7_formats": formats, "s9_capabilities": capabilities, "s10_descriptors": descriptors, "s17_source_details": source_details,
    "x40_compressions": compressions, "e_refused_operations": refused, "w2_variant_plan": variant_plans, "w7_fingerprints": fingerprints,
}

_STEP = "({} * 1099511628211) % 18446744073709551616"
ORACLES = {
    "s7_formats": f"select id, s.format, extension, mime, animation, lossy, bytes_needed from ({assets.ORACLES['s1_sniff_bytes']}) s left join ({oracles.FORMATS}) f on f.format = s.format",
    "s9_capabilities": f"{_T} select id, t.operation, t.flag, c.flag is not null as able from t left join ({oracles.CAPABILITIES}) c on c.operation = t.operation and c.flag = t.flag",
    "s10_descriptors": f"{_T} select t.codec, t.direction, t.descriptor, count(*) as n, count(d.codec) as n_supported from t left join ({oracles.DESCRIPTORS}) d on d.codec = t.codec and d.direction = t.direction and d.descriptor = t.descriptor group by 1, 2, 3",
    "s17_source_details": f"{_T} select id, t.codec, lossless, quality from t left join ({oracles.SOURCES}) s on s.codec = t.codec",
    "x40_compressions": f"{_T} select t.code, compression, count(*) as n, coalesce(bool_or(readable), false) as readable from t left join ({oracles.COMPRESSIONS}) c on c.code = t.code group by 1, 2",
    "e_refused_operations": f"{_T} select id, t.codec, asked, case when r.codec is not null then 'Request' end as origin, case when r.codec is not null then 'Unsupported' end as kind from t left join ({oracles.REFUSED}) r on r.codec = t.codec and r.operation = t.asked",
    "w2_variant_plan": """
with a as (
  select p_partkey as id, p_partkey % 2 = 0 as all_axes, case when p_size % 5 < 4 then p_size % 5 end as max_tier, case when p_partkey % 4 > 0 then p_partkey % 4 - 1 end as max_deviations from part
), c as (
  select *, (ci > 0)::int + p + b as deviations, ci + p + b as idx_sum
  from (values (0, 'none', 0), (1, 'lzw', 2), (2, 'deflate', 3), (3, 'packbits', 1)) m(ci, method, tier), range(2) x(p), range(2) y(b) where ci > 0 or p = 0
), j as (
  select *, coalesce(tier > max_tier, false) as dropped from a join c on all_axes or (p = 0 and b = 0)
)
select id, cast(row_number() over (partition by id order by deviations, idx_sum, ci, p, b) as int) as position,
  'tiff-' || method || case when p = 1 then '-hpred' else '' end || case when b = 1 then '-big' else '' end as cell_id, cast(deviations as int) as deviations, tier, dropped
from j where dropped or max_deviations is null or deviations <= max_deviations
""",
    "w7_fingerprints": "with a as (select event_id as id, " + _STEP.format("xor(14695981039346656037::hugeint, (event_id % 256)::hugeint)") + " as h1, user_id, event_id from events), b as (select *, " + _STEP.format("xor(h1, (user_id % 256)::hugeint)") + " as h2 from a), c as (select *, " + _STEP.format("xor(h2, (event_id % 7)::hugeint)") + " as h3 from b) select id, lower(lpad(to_hex(h3::ubigint), 16, '0')) as fingerprint from c",
}
