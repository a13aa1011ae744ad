"""format("tiff"): round trips, pushed filters, slices, ranges of large files, failed tasks."""

import os
import tarfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rasterlake.functions.limits import DEFAULT_LIMITS
from rasterlake import raster_queries
from rasterlake.session import Tables
from rasterlake.sources import bundles, tiff, tiff_source


@pytest.fixture(scope="module")
def tiffs(spark):
    return tiff_source.register(spark)


def picture(w, h, samples, dtype="u1"):
    return (np.arange(w * h * samples, dtype="u4") * 7 % 251).astype(dtype).reshape(h, w, samples)


def rows():
    out = []
    for i, (name, samples, dtype) in enumerate([("gray_u8", 1, "<u1"), ("rgb_u8", 3, "<u1"), ("rgba_u16", 4, "<u2"), ("graya_u8", 2, "<u1"), ("gray_f32", 1, "<f4")]):
        for method in tiff.METHODS:
            out.append((f"{name}-{method}", 5 + i, 4, name, method, i % 2 == 0, i + 1, picture(5 + i, 4, samples, dtype).tobytes()))
    return out


NAMES = "name string, width int, height int, descriptor string, method string, big boolean, orientation int, pixels binary"


@pytest.fixture(scope="module")
def folder(tiffs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tiff") / "out")
    tiffs.createDataFrame(rows(), NAMES).repartition(4).write.format("tiff").mode("append").save(path)
    return path


def test_what_is_written_is_read(tiffs, folder):
    got = {r.path.rsplit("/", 1)[-1][:-4]: r for r in tiffs.read.format("tiff").load(folder).collect()}
    assert sorted(os.listdir(folder))[0] == "_SUCCESS" and not os.path.exists(f"{folder}/_temporary")
    assert len(got) == len(rows())
    for name, w, h, descriptor, method, big, orientation, pixels in rows():
        r = got[name]
        assert (r.width, r.height, r.descriptor, r.compression, r.big, r.orientation, bytes(r.pixels), r.error) == (w, h, descriptor, tiff.METHODS[method], big, orientation, pixels, None)


def test_filters_are_pushed(tiffs, folder):
    df = tiffs.read.format("tiff").schema("path string, width int, compression int").load(folder)
    found = df.where("width > 6 and compression = 8 and path like '%rgb%' and width * 2 < 99")
    plan = found._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index("Filter") : plan.index("BatchScan")]
    assert "width" in kept and "* 2" in kept and "compression" not in kept and "path" not in kept
    assert sorted(r.width for r in found.collect()) == [7]
    assert df.where("width is null").count() == 0


def test_header_columns_read_slices_only(tmp_path):
    path = str(tmp_path / "large.tif")
    with open(path, "wb") as out:
        out.write(tiff.encode(picture(2000, 1500, 3).tobytes(), 2000, 1500, "rgb_u8", "none"))
    size = os.path.getsize(path)
    with pa.OSFile(path) as file:
        data = tiff_source.Slices(file, size)
        assert tiff.info(data)["width"] == 2000 and data.read < 200_000 < size
        assert data[5:2] == b"" and data[size - 3 :] == open(path, "rb").read()[-3:]


@pytest.mark.parametrize("most", [1 << 27, 3000])
def test_strips_of_a_file_are_spread(tiffs, tmp_path, most):
    grid = picture(300, 200, 3)
    (tmp_path / "a.tif").write_bytes(tiff.encode(grid.tobytes(), 300, 200, "rgb_u8", "deflate", strip_bytes=4000))
    df = tiffs.read.format("tiff").option("rows", "strips").option("maxPartitionBytes", most).option("openCostInBytes", 1).load(str(tmp_path))
    got = df.orderBy("strip").collect()
    assert (df.rdd.getNumPartitions() > 1) == (most == 3000)
    assert [r.y for r in got] == list(range(0, 200, 4)) and b"".join(r.pixels for r in got) == grid.tobytes()
    assert {(r.x, r.columns, r.unit, r.plane) for r in got} == {(0, 300, 3, 0)}
    assert len({os.path.basename(r.path) for r in got}) == 1


def test_unreadable_files_are_rows(tiffs, tmp_path):
    (tmp_path / "short.tif").write_bytes(b"II*\0")
    (tmp_path / "not.tif").write_bytes(b"hello")
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x")
    for mode in ("images", "strips"):
        got = {os.path.basename(r.path): r for r in tiffs.read.format("tiff").option("rows", mode).load(str(tmp_path)).collect()}
        assert {n: (r.error.kind, r.width) for n, r in got.items()} == {"short.tif": ("Truncated", None), "not.tif": ("Decode", None), "empty.tif": ("Truncated", None)}
    assert tiffs.read.format("tiff").load(str(tmp_path)).where("width > 0").count() == 0
    assert tiffs.read.format("tiff").option("max_width", 1).load(str(tmp_path)).where("error.kind = 'LimitExceeded'").count() == 0


def test_limits_come_before_pixels(tiffs, folder):
    got = tiffs.read.format("tiff").option("max_width", 6).load(folder)
    assert {(r.width > 6, r.error and r.error.kind) for r in got.collect()} == {(True, "LimitExceeded"), (False, None)}
    how = {"each": 4, "bits": 8}
    with pytest.raises(tiff.TiffError, match="max_pixels"):
        tiff.check_block(1 << 16, 1 << 14, how, "rgb", DEFAULT_LIMITS)


def test_a_failed_task_leaves_no_file(tiffs, tmp_path):
    path = str(tmp_path / "out")
    bad = [*rows()[:3], ("bad", 2, 2, "rgb_u8", "none", False, 1, b"short")]
    with pytest.raises(Exception, match="pixels don't fit"):
        tiffs.createDataFrame(bad, NAMES).repartition(3).write.format("tiff").mode("append").save(path)
    assert not os.path.exists(path) or not [f for _, _, files in os.walk(path) for f in files]
    for value in ([("../x", *rows()[0][1:])], [(".x", *rows()[0][1:])], [("n", *rows()[0][1:7], None)]):
        with pytest.raises(Exception, match="InvalidInput|file name|no pixels"):
            tiffs.createDataFrame(value, NAMES).write.format("tiff").mode("append").save(path)


def test_overwrite_and_append(tiffs, tmp_path):
    path = str(tmp_path / "out")
    df = tiffs.createDataFrame(rows()[:4], NAMES)
    for mode, want in (("append", 4), ("append", 8), ("overwrite", 4)):
        df.write.format("tiff").mode(mode).save(path)
        assert tiffs.read.format("tiff").load(path).count() == want
    tiffs.createDataFrame([], NAMES).write.format("tiff").mode("overwrite").save(path)
    assert tiffs.read.format("tiff").load(path).collect() == []


def test_columns_are_checked(tiffs, folder):
    with pytest.raises(Exception, match="no such columns"):
        tiffs.read.format("tiff").schema("path string, wide int").load(folder).collect()
    with pytest.raises(Exception, match="columns missing"):
        tiffs.createDataFrame(rows(), NAMES).drop("width").write.format("tiff").mode("append").save(folder + "x")
    with pytest.raises(Exception, match="no such columns"):
        tiffs.createDataFrame(rows(), NAMES).withColumn("more", F.lit(1)).write.format("tiff").mode("append").save(folder + "x")


@pytest.mark.parametrize("most", [1 << 23, 2000])
def test_bundles_stand_for_their_files(tiffs, folder, tmp_path, most):
    """What is read from bundles, whole or by ranges, is what is read from files; archives are plain tar."""
    path = str(tmp_path / "out")
    tiffs.createDataFrame(rows(), NAMES).repartition(2).write.format("tiff").option("bundleBytes", 3000).mode("append").save(path)
    found = [os.path.join(d, f) for d, _, files in os.walk(path) for f in files if f != "_SUCCESS"]
    assert 2 < len(found) < len(rows()) and all(f.endswith(".tar") for f in found)
    plain = {os.path.basename(r.path): open(r.path, "rb").read() for r in tiffs.read.format("tiff").load(folder).collect()}
    inside = {}
    for f in found:
        with tarfile.open(f) as archive:
            inside |= {m.name: archive.extractfile(m).read() for m in archive}
    assert inside == plain
    for mode in ("images", "strips"):
        read = lambda where, mode=mode: tiffs.read.format("tiff").option("rows", mode).option("bundles", True).option("bundlePartitionBytes", most).load(where)
        key = lambda r: (os.path.basename(r["path"]), r.asDict() | {"path": 0})
        assert sorted(map(key, read(path).collect()), key=str) == sorted(map(key, read(folder).collect()), key=str)
        df = read(path).where("width > 6 and compression = 8 and path like '%rgb%' and size > 10")
        assert {os.path.basename(r.path) for r in df.collect()} == {"rgba_u16-deflate.tif"}


def test_broken_bundles_are_rows(tiffs, tmp_path):
    good = tiff.encode(bytes(range(100)), 10, 10, "gray_u8", "none")
    parts = [bundles.header(f"{i}.tif", len(x)) + x + bytes(-len(x) % 512) for i, x in enumerate((good, b"hello", good, b""))]
    (tmp_path / "whole.tar").write_bytes(b"".join(parts))
    (tmp_path / "cut.tar").write_bytes(b"".join(parts)[:700])
    (tmp_path / "bad.tar").write_bytes(parts[0] + b"x" * 512)
    (tmp_path / "empty.tar").write_bytes(bytes(1024))
    with tarfile.open(tmp_path / "other.tar", "w", format=tarfile.USTAR_FORMAT) as archive:
        (tmp_path / "_a").mkdir()
        (tmp_path / "_a" / "large.tif").write_bytes(tiff.encode(picture(900, 500, 3).tobytes(), 900, 500, "rgb_u8", "none"))
        archive.add(tmp_path / "_a", "deep" * 30)
    for most in (1 << 23, 512):
        got = tiffs.read.format("tiff").option("bundles", True).option("bundlePartitionBytes", most).load(str(tmp_path)).collect()
        told = {r.path[len(str(tmp_path)) + 1 :].replace("deep" * 30, "d"): r.error and r.error.kind for r in got}
        assert told == {"whole.tar/0.tif": None, "whole.tar/1.tif": "Decode", "whole.tar/2.tif": None, "whole.tar/3.tif": "Truncated", "cut.tar": "Decode", "bad.tar/0.tif": None, "bad.tar": "Decode", "other.tar/d/large.tif": None}
        assert [bytes(r.pixels) for r in got if r.width == 900] == [picture(900, 500, 3).tobytes()] and len(got) == len(told)
    assert {r.error.kind for r in tiffs.read.format("tiff").load(str(tmp_path)).collect()} == {"Decode"}
    with pytest.raises(ValueError, match="no member"):
        bundles.header("x" * 101, 1)


def test_images_of_a_table_are_few_files(tiffs):
    """The folder of the queries has an archive of many images for each task, not a file for each image."""
    with Tables(tiffs) as tables:
        path = raster_queries._stored(tiffs, "/root/testdata/sf0.001", tables.place())
        there = [f for _, _, files in os.walk(path.removeprefix("file:")) for f in files if f.endswith((".tif", ".tar"))]
        assert 0 < len(there) <= tiffs.sparkContext.defaultParallelism
