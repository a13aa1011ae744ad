"""Blocks of rasters against whole ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterlake.operators import rasters as R
from rasterlake.sources import tiff, tiff_source


def images():
    out = []
    for i in range(12):
        w, h, unit = 1 + i * 5 % 9, 1 + i * 3 % 7, (1, 3, 4, 6)[i % 4]
        out.append((i, w, h, unit, (np.arange(w * h * unit) * (i + 3) % 256).astype("u1").tobytes()))
    return out


def table(spark):
    more = [(90, 0, 3, 1, b""), (91, None, None, 1, b"x"), (92, 2, 2, 1, None)]
    return spark.createDataFrame(images() + more, "id long, width int, height int, unit int, pixels binary").withColumn("x", F.lit("clash")).repartition(3)


def whole(df):
    return {r.id: (r.width, r.height, bytes(r.pixels)) for r in R.assemble(df, "id").collect()}


def test_cut_and_assembled(spark):
    want = {i: (w, h, p) for i, w, h, _, p in images()}
    for side in (1, 3, 100):
        blocks = R.cut(table(spark), "id", side)
        assert whole(blocks) == want
        assert blocks.where(f"columns > {side} or rows > {side}").count() == 0
    assert whole(R.retile(R.cut(table(spark), "id", 3), "id", 4)) == want
    assert R.retile(R.cut(table(spark), "id", 2), "id", 5).count() == R.cut(table(spark), "id", 5).count()
    assert R.cut(table(spark).limit(0), "id", 2).collect() == [] and whole(R.cut(table(spark).limit(0), "id", 2)) == {}


@pytest.mark.parametrize("tag", [None, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9])
def test_orientation_of_blocks(spark, tag):
    got = whole(R.orient(R.cut(table(spark), "id", 3), F.lit(tag).cast("int")))
    for i, w, h, unit, p in images():
        want = tiff.turn(np.frombuffer(p, "u1").reshape(h, w, unit), tag or 1)
        assert got[i] == (want.shape[1], want.shape[0], want.tobytes())


def test_lines_and_nulls(spark):
    blocks = R.cut(table(spark), "id", 2)
    got = {(r.id, r.y): r.row for r in R.lines(blocks, "id").collect()}
    for i, w, h, unit, p in images():
        assert [bytes(got[i, y]) for y in range(h)] == [p[y * w * unit : (y + 1) * w * unit] for y in range(h)]
    holed = blocks.withColumn("pixels", F.when(F.col("y") > 0, F.col("pixels")))
    found = R.lines(R.orient(holed, F.lit(3)), "id").collect()
    heights = {i: h for i, _, h, _, _ in images()}
    assert all((r.row is None) == (r.y >= heights[r.id] - 2) for r in found)


@pytest.mark.parametrize("most", [0, 20, R.BAND])
def test_blocks_of_any_cut(spark, monkeypatch, most):
    """Lines and cells where blocks share places only in part, are as wide as the image, or lie in bands beyond the bound."""
    monkeypatch.setattr(R, "BAND", most)
    grid = np.arange(9 * 7 * 2).astype("u1").reshape(7, 9, 2)
    places = {"mixed": [(0, 0, 4, 3), (4, 0, 5, 3), (0, 3, 9, 1), (0, 4, 2, 3), (2, 4, 7, 2), (2, 6, 7, 1)], "strips": [(0, 0, 9, 4), (0, 4, 9, 3)], "hole": [(0, 0, 4, 7)]}
    blocks = [(k, 9, 7, 2, x, y, w, h, grid[y : y + h, x : x + w].tobytes()) for k, found in places.items() for x, y, w, h in found]
    df = spark.createDataFrame([*blocks, ("null", 9, 7, 2, 0, 0, 9, 7, None), ("bad", None, None, None, None, None, None, None, None)], "id string, image_width int, image_height int, unit int, x int, y int, columns int, rows int, pixels binary")
    got = {(r.id, r.y): r.row and bytes(r.row) for r in R.lines(df, "id").collect()}
    assert got == {(k, y): None if k == "null" else grid[y, : 4 if k == "hole" else 9].tobytes() for k in [*places, "null"] for y in range(7)}
    for side in (2, 4, 9):
        cells = R.retile(df.where("id in ('mixed', 'strips', 'null')"), "id", side).collect()
        assert sorted((r.id, r.x, r.y, r.columns, r.rows) for r in cells) == sorted((k, x, y, min(side, 9 - x), min(side, 7 - y)) for k in ("mixed", "strips", "null") for x in range(0, 9, side) for y in range(0, 7, side))
        assert all(r.pixels is None if r.id == "null" else bytes(r.pixels) == grid[r.y : r.y + r.rows, r.x : r.x + r.columns].tobytes() for r in cells)


def test_cells_within_a_block_stay(spark):
    """No row of strips that hold their cells passes an exchange, and neither do lines of blocks as wide as the image."""
    df = spark.createDataFrame([(i, 6, 8, 1, 0, y, 6, 4, bytes(24)) for i in range(50) for y in (0, 4)], "id long, image_width int, image_height int, unit int, x int, y int, columns int, rows int, pixels binary").coalesce(2)
    for found, n in ((R.retile(df, "id", 4), 200), (R.lines(df, "id"), 400)):
        assert len(found.collect()) == n
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Final Plan" in plan and "collect_list" not in plan[: plan.index("Initial Plan")]


def test_strips_of_files(spark, tmp_path):
    tiff_source.register(spark)
    grid = (np.arange(60 * 50 * 3) % 253).astype("u1").reshape(50, 60, 3)
    (tmp_path / "chunky.tif").write_bytes(tiff.encode(grid.tobytes(), 60, 50, "rgb_u8", "lzw", strip_bytes=900))
    apart = [tiff.encode(np.ascontiguousarray(grid[:, :, k]).tobytes(), 60, 50, "gray_u8", "none", strip_bytes=60 * 7) for k in range(3)]
    for k, file in enumerate(apart):
        (tmp_path / f"plane{k}.tif").write_bytes(file)
    strips = spark.read.format("tiff").option("rows", "strips").option("maxPartitionBytes", 2000).load(str(tmp_path)).withColumnsRenamed({"width": "image_width", "height": "image_height"})
    strips = strips.withColumn("name", F.element_at(F.split("path", "/"), -1))
    got = R.assemble(R.retile(strips.where("name = 'chunky.tif'"), "name", 16), "name").first()
    assert (got.width, got.height, bytes(got.pixels)) == (60, 50, grid.tobytes())
    planes = strips.where("name <> 'chunky.tif'").withColumn("plane", F.substring("name", 6, 1).cast("int")).withColumn("name", F.lit("p"))
    got = R.assemble(R.orient(R.join_planes(planes, "name"), F.lit(6)), "name").first()
    assert bytes(got.pixels) == np.ascontiguousarray(tiff.turn(grid, 6)).tobytes()
