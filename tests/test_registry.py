"""Every registered query with SQL gives what DuckDB gives on the smallest tables; golden values."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from rasterlake import registry
from rasterlake.functions import limits as L
from rasterlake.plans import dimensions, variants

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sql, name):
    got = registry.QUERIES[name](spark, FOLDER)
    want = sql.sql(registry.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    key = lambda row: tuple(str(v) for v in row)
    left = sorted((tuple(r[c] for c in order) for r in got.collect()), key=key)
    right = sorted(want.project(", ".join(f'"{c}"' for c in order)).fetchall(), key=key)
    assert left == right


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_golden_values(spark):
    """Fixed values of the formulas."""
    lit = F.lit
    assert [one(spark, L.cmyk8(lit(c), lit(k)))[0] for c, k in ((0, 0), (255, 0), (0, 255), (128, 0), (128, 128), (64, 32), (200, 100))] == [255, 0, 0, 127, 63, 167, 33]
    assert [one(spark, L.unpremultiply(lit(c), lit(a)))[0] for c, a in ((64, 128), (1, 3), (200, 100), (10, 254))] == [128, 85, 255, 10]
    assert one(spark, L.unpack_bits(lit(0b10110100), 1))[0] == [255, 0, 255, 255, 0, 255, 0, 0]
    assert one(spark, L.unpack_bits(lit(0b11100100), 2))[0] == [255, 170, 85, 0]
    none = lit(None).cast("int")
    assert tuple(one(spark, *L.svg_size(lit(7), lit(7), lit(57), none, lit("original"), lit(1.0))))[0] == 58
    a4 = lit(595.28), lit(841.89)
    for kind, a, b, want in (("scale", 1.0, 0.0, (595, 841)), ("dpi", 144.0, 0.0, (1190, 1683)), ("box", 300.0, 10000.0, (300, 424)), ("exact", 800.0, 600.0, (800, 600)), ("width", 45.0, 0.0, (44, 63))):
        assert tuple(one(spark, *L.pdf_size(*a4, lit(kind), lit(a), lit(b)))) == want
    assert dimensions.fingerprint(0, 0, 0) == "d94d12186c0f2fb7" and dimensions.fingerprint(3, 1, 1) == "e1f9f21870fa0fd8"


def test_plan_order(spark):
    rows = variants.plan(spark).collect()
    assert [r.cell_id for r in rows[:5]] == ["tiff-none", "tiff-none-big", "tiff-lzw", "tiff-deflate", "tiff-packbits"] and len(rows) == 14


def test_samples_of_large_keys(spark, sql, tmp_path):
    """Keys whose 64-bit samples are beyond a bigint, and the bounds of the samples in both forms."""
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet").limit(40)
    rows.withColumn("l_orderkey", F.col("l_orderkey") + F.element_at(F.array(*[F.lit(x).cast("bigint") for x in (0, 65500, 70530, 131071, 9_000_000)]), (F.col("l_linenumber") % 5 + 1).cast("int"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.QUERIES["x8_sample_conversion"](spark, str(tmp_path))
    want = duckdb.sql(registry.ORACLES["x8_sample_conversion"].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet/*.parquet'")).project(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 40 and max(r[0] for r in want) >= 9_000_000
    for value, signed, unsigned in ((0, 32768, 0), ((1 << 63) - 1, 65535, 32767), (-1, 32767, None), (-(1 << 63), 0, None), ((1 << 64) - 1, None, 65535), ((1 << 48) - 1, 32768, 0), (-(1 << 48) - 1, 32766, None)):
        wide = F.lit(str(value)).cast("decimal(20,0)")
        assert signed is None or [one(spark, L.narrow_signed(x, 64, w))[0] for x, w in ((wide, True), (F.lit(value).cast("bigint"), False))] == [signed, signed]
        assert unsigned is None or one(spark, L.narrow_unsigned(wide, 64, wide=True))[0] == unsigned
    assert one(spark, L.narrow_unsigned(F.lit(-1).cast("bigint"), 64))[0] == 65535
