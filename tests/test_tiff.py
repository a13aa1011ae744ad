"""TIFF bytes: exact round trips, directories, metadata, defects, and the Spark operators."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterlake import assets
from rasterlake.operators import tiff_columns as T
from rasterlake.plans import variants
from rasterlake.sources import files, tiff
from rasterlake.streaming.ingest import ingest

SAMPLES = {"gray": 1, "graya": 2, "rgb": 3, "rgba": 4}


@pytest.mark.parametrize("layout,sample", list(itertools.product(SAMPLES, ("u8", "u16", "f32"))))
def test_round_trip(layout, sample):
    rng = np.random.default_rng(1)
    for method, hpred, big in itertools.product(tiff.METHODS, (0, 1), (0, 1)):
        for w, h in ((1, 1), (37, 23)):
            px = (rng.integers(0, 7, (h, w, SAMPLES[layout])) * 3).astype({"u8": "u1", "u16": "<u2", "f32": "<f4"}[sample]).tobytes()
            got = tiff.decode(tiff.encode(px, w, h, f"{layout}_{sample}", method, hpred, big, strip_bytes=1024))
            assert got == {"width": w, "height": h, "descriptor": f"{layout}_{sample}", "pixels": px}


def test_codecs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 100, 5000, 100000):
        for top in (2, 256):
            x = rng.integers(0, top, n).astype("u1").tobytes()
            assert tiff.lzw_decode(tiff.lzw_encode(x)) == x and tiff.packbits_decode(tiff.packbits_encode(x)) == x
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def stored(order, w, h, data, *more):
    """A file of one strip with the given tags, for layouts that encode() doesn't write."""
    tags = {256: (4, w), 257: (4, h), 259: (3, 1), 273: (4, 8), 278: (4, h), 279: (4, len(data))} | {t: (k, *v) for t, k, *v in more}
    entries = [(t, k, len(v), struct.pack(f"{order}{len(v)}{tiff.CODES[k]}", *v)) for t, (k, *v) in sorted(tags.items())]
    at = 8 + len(data) + len(data) % 2
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + data + b"\0" * (len(data) % 2) + tiff.pack_directory(entries, order, at)


@pytest.mark.parametrize("order", "<>")
def test_other_layouts(order):
    def get(w, h, data, *more):
        found = tiff.decode(stored(order, w, h, data, *more))
        return found["descriptor"], list(np.frombuffer(found["pixels"], {"u8": "u1", "u16": "<u2", "f32": "<f4"}[found["descriptor"].split("_")[1]]))

    assert get(5, 1, bytes([0b10110000]), (258, 3, 1), (262, 3, 1), (277, 3, 1)) == ("gray_u8", [255, 0, 255, 255, 0])
    assert get(3, 1, bytes([0b11100100]), (258, 3, 2), (262, 3, 0), (277, 3, 1)) == ("gray_u8", [0, 85, 170])
    assert get(2, 1, struct.pack(order + "2h", -32768, 5), (258, 3, 16), (262, 3, 1), (277, 3, 1), (339, 3, 2)) == ("gray_u16", [0, 32773])
    assert get(2, 1, struct.pack(order + "2I", 65536, 2**32 - 1), (258, 3, 32), (262, 3, 1), (277, 3, 1)) == ("gray_u16", [1, 65535])
    assert get(2, 1, struct.pack(order + "2d", 0.5, -1), (258, 3, 64), (262, 3, 1), (277, 3, 1), (339, 3, 3)) == ("gray_f32", [0.5, -1])
    assert get(1, 1, bytes([128, 64, 200, 100]), (258, 3, 8, 8, 8, 8), (262, 3, 5), (277, 3, 4))[0] == "rgba_u8"
    assert get(1, 1, bytes([0, 128, 255, 128]), (258, 3, 8, 8, 8, 8), (262, 3, 5), (277, 3, 4))[1] == [127, 63, 0, 255]
    colours = [i << 8 for i in range(48)]
    assert get(2, 1, bytes([0x1F]), (258, 3, 4), (262, 3, 3), (277, 3, 1), (320, 3, *colours)) == ("rgb_u8", [1, 17, 33, 15, 31, 47])
    with pytest.raises(tiff.TiffError, match="palette"):
        tiff.decode(stored(order, 2, 1, bytes([0x1F]), (258, 3, 4), (262, 3, 3), (277, 3, 1), (320, 3, *colours)), palettes=False)
    with pytest.raises(tiff.TiffError, match="colour map"):
        get(2, 1, bytes([0x1F]), (258, 3, 4), (262, 3, 3), (277, 3, 1), (320, 3, *colours[:20]))
    with pytest.raises(tiff.TiffError, match="sample format"):
        get(1, 1, bytes(3), (258, 3, 24), (262, 3, 1), (277, 3, 1))
    assert get(1, 1, bytes(range(6)), (258, 3, *[8] * 6), (262, 3, 2), (277, 3, 6)) == ("rgba_u8", [0, 1, 2, 3])


def test_metadata():
    exif = b"MM\0*" + struct.pack(">I", 8) + tiff.pack_directory([(0x010F, 2, 6, b"Maker\0"), (0x0100, 4, 1, b"\0\0\0\1"), (0x829A, 5, 1, struct.pack(">II", 1, 50)), (0xA005, 4, 1, b"\0\0\0\1")], ">", 8)
    found = tiff.info(tiff.encode(b"\1" * 4, 2, 2, "gray_u8", metadata={"orientation": 6, "icc": b"profile", "xmp": b"<x/>", "exif": exif}))
    assert (found["orientation"], found["icc"], found["xmp"], found["page_count"]) == (6, b"profile", b"<x/>", 1)
    order, _, at = tiff.header(found["exif"])
    assert [(e[0], e[3]) for e in tiff.directory(found["exif"], at, order)[0]] == [(0x010F, b"Maker\0"), (0x829A, struct.pack("<II", 1, 50))]
    assert tiff.encode(b"\1" * 4, 2, 2, "gray_u8", metadata={}) == tiff.encode(b"\1" * 4, 2, 2, "gray_u8")
    assert tiff.dots_per_inch(3, (100, 1), (100, 1)) == (254.0, 254.0) and tiff.dots_per_inch(2, (1, 0), (1, 1)) is None


def test_defects(spark):
    whole = tiff.encode(bytes(range(100)), 10, 10, "gray_u8")
    loop = bytearray(whole)
    loop[-4:] = struct.pack("<I", struct.unpack_from("<I", whole, 4)[0])
    rows = [(i, bytes(b) if b is not None else None, "x") for i, b in enumerate([whole, whole[:8], b"", None, b"no image", whole[:60], loop])]
    df = spark.createDataFrame(rows, "id int, content binary, tag string")
    got = {r.id: r for r in df.select("id", T.tiff_pixels(F.col("content")).alias("p"), T.tiff_info(F.col("content")).alias("i")).collect()}
    assert got[0].p.error is None and bytes(got[0].p.pixels) == bytes(range(100))
    assert [got[i].p.error and got[i].p.error.kind for i in range(1, 6)] == ["Truncated", "Truncated", None, "Decode", "Truncated"]
    assert got[3].p.width is None and got[0].i.page_count == 1
    assert T.tiff_tags(df.select("id", "content")).where("id = 0").count() == 11
    assert df.limit(0).select(T.tiff_info(F.col("content")).alias("i")).count() == 0


def test_best_variant(spark):
    folder = "/root/testdata/sf0.001"
    cells = variants.plan(spark).orderBy("deviations", "idx_sum", "ci", "pi", "bi").collect()
    images = {r.id: r for r in assets._images(spark, folder).collect()}
    got = {r.id: (r.n_bytes, r.cell_id) for r in assets.best(spark, folder).collect()}
    assert set(got) == set(images)
    for key, r in images.items():
        sizes = [(len(tiff.encode(bytes(r.pixels), r.w, r.h, r.descriptor, c.method, c.predictor == "horizontal", c.big_tiff)), i, c.cell_id) for i, c in enumerate(cells)]
        assert got[key] == (min(sizes)[0], min(sizes)[2])


def test_sizes_without_files():
    """Measured data are as long as what the encoders make, at the clears of LZW too."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 128, 129, 3835, 3836, 3837, 3838, 7674, 20000):
        for most in (1, 3, 256):
            data = rng.integers(0, most, n, dtype="u1").tobytes()
            assert tiff.lzw_size(data) == len(tiff.lzw_encode(data)) and tiff.lzw_decode(tiff.lzw_encode(data)) == data
            assert tiff.packbits_size(data) == len(tiff.packbits_encode(data))
    large = rng.integers(0, 4, 300 * 200 * 3, dtype="u1").tobytes()
    cells = [(m, p, b) for m in tiff.METHODS for p in (True, False) for b in (True, False)]
    assert tiff.smallest(large, 300, 200, "rgb_u8", cells) == min((len(tiff.encode(large, 300, 200, "rgb_u8", *cell)), i) for i, cell in enumerate(cells))


def test_images_are_spread(spark):
    """Images of one small file are dealt to all cores, with the pixels that their keys ask for."""
    folder = "/root/testdata/sf0.001"
    assert spark.read.parquet(f"{folder}/part.parquet").rdd.getNumPartitions() == 1
    assert assets.best(spark, folder).rdd.getNumPartitions() >= 4
    rows = assets._images(spark, folder).collect()
    assert len(rows) == len({r.id for r in rows}) and all(bytes(r.pixels) == bytes((r.id + 3 * i) % 256 for i in range(r.w * r.h * r.unit)) for r in rows)


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    whole = tiff.encode(bytes(range(100)), 10, 10, "gray_u8")
    (tmp_path / "in" / "a.tif").write_bytes(whole)
    (tmp_path / "in" / "deep" / "b.tiff").write_bytes(whole[:20])
    (tmp_path / "in" / "c.png").write_bytes(b"x")
    found = files.scan(spark, str(tmp_path / "in"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.tif", "b.tiff"]
    assert files.scan(spark, str(tmp_path / "in"), max_bytes=20).count() == 1
    assert files.listing_difference(found.select("path"), found.where("length > 20").select("path")).count() == 1
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["a.tif"].info.width == 10 and rows["b.tiff"].info.error.kind == "Truncated"


def test_planes_and_tiles():
    """Planes behind one another, and tiles that reach over both edges."""
    grid = np.arange(5 * 3 * 3, dtype="u1").reshape(3, 5, 3)
    data = grid.transpose(2, 0, 1).tobytes()
    more = [(258, 3, 8, 8, 8), (262, 3, 2), (277, 3, 3), (284, 3, 2), (273, 4, 8, 23, 38), (279, 4, 15, 15, 15)]
    assert tiff.decode(stored("<", 5, 3, data, *more))["pixels"] == grid.tobytes()
    gray = np.arange(20 * 18, dtype="<u2").reshape(18, 20)
    wide = np.zeros((32, 32), "<u2")
    wide[:18, :20] = gray
    tiles = [wide[y : y + 16, x : x + 16].tobytes() for y in (0, 16) for x in (0, 16)]
    more = [(258, 3, 16), (262, 3, 1), (277, 3, 1), (322, 3, 16), (323, 3, 16), (324, 4, 8, 520, 1032, 1544), (325, 4, 512, 512, 512, 512)]
    assert tiff.decode(stored("<", 20, 18, b"".join(tiles), *more))["pixels"] == gray.tobytes()


def test_limits_come_before_pixels(spark):
    huge = stored("<", 4_000_000_000, 4_000_000_000, b"\0", (258, 3, 8), (262, 3, 1), (277, 3, 1))
    small = tiff.encode(bytes(range(100)), 10, 10, "gray_u8")
    rgb16 = tiff.encode(bytes(600), 10, 10, "rgb_u16")
    df = spark.createDataFrame([(0, huge), (1, small), (2, rgb16)], "id int, content binary")
    kinds = lambda **limits: [r.p.error and r.p.error.kind for r in df.orderBy("id").select(T.tiff_pixels(F.col("content"), **limits).alias("p")).collect()]
    assert kinds() == ["LimitExceeded", None, None]
    assert kinds(max_width=9) == ["LimitExceeded"] * 3 and kinds(max_height=10, max_pixels=99) == ["LimitExceeded"] * 3
    # peak memory: once the output for 8-bit samples, twice for others, and 512 KiB
    assert kinds(max_memory=524288 + 100) == ["LimitExceeded", None, "LimitExceeded"] and kinds(max_memory=524288 + 1200)[2] is None
    assert kinds(max_memory=524288 + 1199)[2] == "LimitExceeded" and kinds(max_input=len(small))[2] == "Limit"
    bomb = tiff.packbits_encode(b"\0" * 1_000_000)
    assert len(tiff.packbits_decode(bomb, 1000)) < 1200 and len(tiff.lzw_decode(tiff.lzw_encode(bytes(1_000_000)), 1000)) < 6000


@pytest.mark.parametrize("tag", range(1, 9))
def test_orientation_in_pixels(tag):
    """A 4 x 2 grid of colours, turned by each tag: where its corners go."""
    grid = np.array([[[10 + 20 * x, 100 + 40 * y, 200] for x in range(4)] for y in range(2)], "u1")
    data = tiff.encode(grid.tobytes(), 4, 2, "rgb_u8", metadata={"orientation": tag})
    kept = tiff.decode_job(data)
    assert (kept["orientation"], kept["pixels"]) == (tag, grid.tobytes())
    got = tiff.decode_job(data, hint="correct")
    out = np.frombuffer(got["pixels"], "u1").reshape(got["height"], got["width"], 3)
    assert (got["width"], got["height"], got["orientation"]) == ((2, 4, 1) if tag > 4 else (4, 2, 1))
    #: The stored (x, y) that is seen at the upper left and at the upper right.
    seen = {1: ((0, 0), (3, 0)), 2: ((3, 0), (0, 0)), 3: ((3, 1), (0, 1)), 4: ((0, 1), (3, 1)), 5: ((0, 0), (0, 1)), 6: ((0, 1), (0, 0)), 7: ((3, 1), (3, 0)), 8: ((3, 0), (3, 1))}[tag]
    for place, (x, y) in zip((0, -1), seen, strict=True):
        assert out[0, place].tolist() == grid[y, x].tolist()
    upright = tiff.decode_job(data, hint="exact", asked=1)
    assert (upright["pixels"], upright["orientation"]) == (grid.tobytes(), 1)
    back = {6: 8, 8: 6}.get(tag, tag)
    assert tiff.decode_job(data, hint="both", asked=back)["pixels"] == grid.tobytes()


def test_metadata_policy():
    exif = b"II*\0" + struct.pack("<I", 8) + tiff.pack_directory([(0x010F, 2, 6, b"Maker\0")], "<", 8)
    data = tiff.encode(b"\1" * 4, 2, 2, "gray_u8", metadata={"orientation": 3, "icc": b"profile", "xmp": b"<x/>", "exif": exif})
    assert [tiff.decode_job(data)[k] is None for k in ("icc", "exif", "xmp")] == [False] * 3
    assert [tiff.decode_job(data, icc=False, exif=False, xmp=False)[k] for k in ("icc", "exif", "xmp")] == [None] * 3


def test_large_codes():
    """Tables that fill up and are cleared, and data that ends with them."""
    rng = np.random.default_rng(4)
    for n in (3836, 3837, 3838, 3839, 7680, 40000):
        x = rng.integers(0, 256, n).astype("u1").tobytes()
        assert tiff.lzw_decode(tiff.lzw_encode(x)) == x
    with pytest.raises(tiff.TiffError, match="LZW"):
        tiff.lzw_decode(bytes([0x80, 0x7F, 0xFF, 0xFF]))


def test_ink_of_all_bytes():
    ink, black = np.meshgrid(np.arange(256, dtype="u1"), np.arange(256, dtype="u1"), indexing="ij")
    found = tiff._cmyk(np.stack([ink, ink, ink, black], axis=2))
    one, top = np.float32(1), np.float32(255)
    want = np.floor((one - ink / top) * (one - black / top) * top + np.float32(0.5)).astype("u1")
    assert (found[:, :, 0] == want).all() and (found[:, :, 3] == 255).all()


def test_jobs_by_tag(spark):
    from rasterlake.session import cancellable

    with cancellable(spark, "decode") as stop:
        assert "decode" in spark.getTags() and spark.range(3).count() == 3 and stop() == []
    assert "decode" not in spark.getTags()


def test_large_results_are_sent_in_pieces(spark, monkeypatch):
    """Every row keeps its result, whatever the pieces."""
    monkeypatch.setattr(T, "_HELD", 100)
    grow = T.struct_udf(lambda n: {"n": int(n), "data": b"x" * int(n)}, "n int, data binary")
    got = spark.range(1000).coalesce(1).select("id", grow(F.struct((F.col("id") % 90).alias("c0"))).alias("r")).select("id", "r.n", F.length("r.data").alias("size")).collect()
    assert all(r.n == r.size == r.id % 90 for r in got) and len(got) == 1000
