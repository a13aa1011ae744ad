"""Rasters as relations of blocks: one image spans tasks.

A block is a row: the key of its image, the image's size (image_width, image_height) and bytes a pixel
(unit), where the block lies (x, y, columns, rows) and its pixels, line by line. Blocks of an
image cover it and don't overlap; they may be strips, tiles or cells of any cut. Orientation
moves the blocks by arithmetic on their keys, and turns each one by itself; cutting anew,
joining planes and giving lines are groupings by key and place, so no task holds more of an
image than the blocks of one cell, line or band. Only what lies in several blocks is grouped: cells
within a block and lines of blocks as wide as their image stay where they are. Both parts
read the blocks, so blocks that are costly to make should be a table.

Defined results: blocks with null pixels are passed on with null pixels, and a line or cell
with such a block is null; empty tables give empty tables; further columns of ``blocks``
are dropped; keys may repeat only if the blocks still don't overlap.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..sources.tiff import turn

#: Bytes of a band of blocks, beside each other over the whole width, that meets as one.
BAND = 16 << 20
COLUMNS = ("image_width", "image_height", "unit", "x", "y", "columns", "rows", "pixels")


def _joined(parts: Column) -> Column:
    """Binaries of an array end to end; null if one is."""
    whole = F.unhex(F.array_join(F.transform(parts, F.hex), ""))
    return F.when(F.size(parts) == 1, F.element_at(parts, 1)).when(~F.exists(parts, lambda p: p.isNull()), whole)


def _slice(pixels: Column, at: Column, length: Column) -> Column:
    return F.substr(pixels, (at + 1).cast("int"), length.cast("int"))


def cut(images: DataFrame, key: str, side: int, width: str = "width", height: str = "height", unit: str = "unit", pixels: str = "pixels") -> DataFrame:
    """Whole rasters as blocks of ``side`` x ``side`` pixels at most; those without size or pixels give none."""
    sized = images.select(key, F.col(width).alias("image_width"), F.col(height).alias("image_height"), F.col(unit).alias("unit"), F.col(pixels).alias("_all")).where("image_width > 0 and image_height > 0 and _all is not null")
    starts = lambda size: F.sequence(F.lit(0), F.col(size) - 1, F.lit(side))
    placed = sized.withColumn("y", F.explode(starts("image_height"))).withColumn("x", F.explode(starts("image_width")))
    placed = placed.withColumns({"columns": F.least(F.lit(side), F.col("image_width") - F.col("x")), "rows": F.least(F.lit(side), F.col("image_height") - F.col("y"))})
    line = lambda r: _slice(F.col("_all"), ((F.col("y") + r) * F.col("image_width") + F.col("x")) * F.col("unit"), F.col("columns") * F.col("unit"))
    return placed.withColumn("pixels", _joined(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), line))).select(key, *COLUMNS)


def retile(blocks: DataFrame, key: str, side: int) -> DataFrame:
    """The same rasters in blocks of ``side`` x ``side`` pixels, whatever they were cut into.

    Every block is split by the grid where it is; the pieces of a cell then meet, unless one block has all of it.
    """
    cells = lambda at, size: F.sequence((F.col(at) / side).cast("int"), ((F.col(at) + F.col(size) - 1) / side).cast("int"))
    split = blocks.withColumn("_row", F.explode(cells("y", "rows"))).withColumn("_column", F.explode(cells("x", "columns")))
    top, left = F.greatest(F.col("y"), F.col("_row") * side), F.greatest(F.col("x"), F.col("_column") * side)
    bottom, right = F.least(F.col("y") + F.col("rows"), (F.col("_row") + 1) * side), F.least(F.col("x") + F.col("columns"), (F.col("_column") + 1) * side)
    split = split.withColumns({"_top": top, "_left": left, "_bottom": bottom, "_right": right})
    y, x = F.col("_row") * side, F.col("_column") * side
    down, across = F.least(F.lit(side), F.col("image_height") - y), F.least(F.lit(side), F.col("image_width") - x)
    whole = (F.col("_bottom") - F.col("_top") == down) & (F.col("_right") - F.col("_left") == across)
    part = lambda y: _slice(F.col("pixels"), ((y - F.col("y")) * F.col("columns") + F.col("_left") - F.col("x")) * F.col("unit"), (F.col("_right") - F.col("_left")) * F.col("unit"))
    line = lambda y: F.struct(y.alias("y"), F.col("_left").alias("x"), part(y).alias("pixels"))
    numbers = F.sequence(F.col("_top"), F.col("_bottom") - 1)
    inside = split.where(F.coalesce(whole, F.lit(False))).withColumn("pixels", _joined(F.transform(numbers, part)))
    met = split.where(~F.coalesce(whole, F.lit(False))).withColumn("_lines", F.transform(numbers, line)).groupBy(key, "image_width", "image_height", "unit", "_row", "_column").agg(F.array_sort(F.flatten(F.collect_list("_lines"))).alias("_lines"))
    placed = lambda df: df.withColumns({"x": x, "y": y, "columns": across, "rows": down}).select(key, *COLUMNS)
    return placed(inside).unionByName(placed(met.withColumn("pixels", _joined(F.col("_lines.pixels")))))


@F.pandas_udf(BinaryType())
def _turned(pixels: pd.Series, columns: pd.Series, rows: pd.Series, unit: pd.Series, tag: pd.Series) -> pd.Series:
    """Blocks of one shape and tag together, by numpy's views."""
    out, alike = [None] * len(pixels), defaultdict(list)
    for i, (data, *shape) in enumerate(zip(pixels, columns.tolist(), rows.tolist(), unit.tolist(), tag.tolist(), strict=True)):
        if data is not None:
            alike[(len(data), *shape)].append(i)
    held = pixels.tolist()
    for (length, w, h, n, t), places in alike.items():
        if length != w * h * n:
            raise ValueError(f"{length} bytes of a block of {w} x {h} x {n}")
        grid = np.frombuffer(b"".join([held[i] for i in places]), np.uint8).reshape(len(places), h, w, n)
        turned = turn(grid.transpose(1, 2, 0, 3).reshape(h, w, -1), int(t))
        made = np.ascontiguousarray(turned.reshape(*turned.shape[:2], len(places), n).transpose(2, 0, 1, 3)).tobytes()
        for k, i in enumerate(places):
            out[i] = made[k * length : (k + 1) * length]
    return pd.Series(out, dtype=object)


def orient(blocks: DataFrame, tag: Column) -> DataFrame:
    """Blocks of the rasters with an orientation (1 to 8) applied; other tags change nothing.

    Where a block comes to lie follows from its key, so nothing is exchanged. Tags of one
    image must be equal.
    """
    own = blocks.withColumn("_tag", F.when(tag.between(2, 8), tag).otherwise(1).cast("int"))
    t = F.col("_tag")
    swap, across, down = t > 4, t.isin(2, 3, 6, 7), t.isin(3, 4, 7, 8)
    either = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    width, height, columns, rows = either("image_width", "image_height"), either("image_height", "image_width"), either("columns", "rows"), either("rows", "columns")
    x, y = either("x", "y"), either("y", "x")
    pixels = F.when(t == 1, F.col("pixels")).otherwise(_turned("pixels", "columns", "rows", "unit", "_tag"))
    moved = {"image_width": width, "image_height": height, "x": F.when(across, width - x - columns).otherwise(x), "y": F.when(down, height - y - rows).otherwise(y), "columns": columns, "rows": rows, "pixels": pixels}
    rest = [c for c in blocks.columns if c not in COLUMNS]
    return own.select(*rest, *[moved.get(c, F.col(c)).alias(c) for c in COLUMNS])


@F.pandas_udf(BinaryType())
def _mixed(planes: pd.Series, unit: pd.Series) -> pd.Series:
    """Equally long planes of one-sample pixels, sample by sample."""

    def one(parts, n):
        return None if any(p is None for p in parts) else np.stack([np.frombuffer(p, np.uint8).reshape(-1, n) for p in parts], axis=1).tobytes()

    return pd.Series([one(*row) for row in zip(planes, unit, strict=True)], dtype=object)


def join_planes(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks whose samples lie in planes (column ``plane``) as blocks of whole pixels; ``unit`` becomes their bytes together."""
    places = [c for c in COLUMNS if c != "pixels"]
    met = blocks.groupBy(key, *places).agg(F.array_sort(F.collect_list(F.struct("plane", "pixels"))).alias("_planes"))
    return met.withColumn("pixels", _mixed(F.col("_planes.pixels"), F.col("unit"))).withColumn("unit", F.col("unit") * F.size("_planes")).select(key, *COLUMNS)


def lines(blocks: DataFrame, key: str) -> DataFrame:
    """(key, y, row): the lines of the rasters, one row each, to push to a sink in order of y.

    Blocks of equal place and height meet first. Where these bands are as wide as the image, they
    have its lines; those of other blocks, and of bands beyond ``BAND`` bytes, meet line by line.
    """
    stride = F.col("columns") * F.col("unit")
    block = F.struct("x", stride.alias("stride"), "pixels")
    yes = lambda c: F.coalesce(c, F.lit(False))
    wide, small = yes(F.col("columns") == F.col("image_width")), yes(F.col("image_width").cast("bigint") * F.col("rows") * F.col("unit") <= BAND)
    alone = lambda df: df.select(key, "y", "rows", F.array(block).alias("_blocks"))
    bands = blocks.where(~wide & small).groupBy(key, "image_width", "y", "rows").agg(F.array_sort(F.collect_list(block)).alias("_blocks"), F.sum("columns").alias("_width"))
    whole = yes(F.col("_width") == F.col("image_width"))
    cut = lambda b: _slice(b["pixels"], F.col("_r") * b["stride"], b["stride"])
    each = lambda df: df.select(key, "y", "_blocks", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("_r"))
    y = (F.col("y") + F.col("_r")).alias("y")
    made = each(alone(blocks.where(wide)).unionByName(bands.where(whole).select(key, "y", "rows", "_blocks"))).select(key, y, _joined(F.transform("_blocks", cut)).alias("row"))
    apart = each(alone(blocks.where(~wide & ~small)).unionByName(bands.where(~whole).select(key, "y", "rows", "_blocks")))
    pieces = apart.select(key, y, F.transform("_blocks", lambda b: F.struct(b["x"].alias("x"), cut(b).alias("pixels"))).alias("ps"))
    met = pieces.groupBy(key, "y").agg(F.array_sort(F.flatten(F.collect_list("ps"))).alias("ps")).select(key, "y", _joined(F.col("ps.pixels")).alias("row"))
    return made.unionByName(met)


def assemble(blocks: DataFrame, key: str) -> DataFrame:
    """(key, width, height, pixels): whole rasters again, for images that fit a row."""
    size = blocks.groupBy(key).agg(F.max("image_width").alias("width"), F.max("image_height").alias("height"))
    met = lines(blocks, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", "row"))).alias("ls"))
    return size.join(met, key).select(key, "width", "height", _joined(F.col("ls.row")).alias("pixels"))
