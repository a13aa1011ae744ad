"""TIFF operators as Column functions over Arrow batches.

A bad row gives an ``error`` struct (kind, message) and never fails its task; null content
gives null fields and no error. Spark cuts Arrow batches by
``spark.sql.execution.arrow.maxBytesPerBatch`` as well as by rows, so a batch of large files
stays bounded; what it becomes is sent on in pieces of about 16 MB, or of one row, so that small files of
large images don't add up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.limits import DEFAULT_LIMITS
from ..sources import tiff

ERROR = "error struct<kind: string, message: string>"
INFO = "width int, height int, color string, bits int, samples int, is_float boolean, big boolean, page_count int, compression int, photometric int, orientation int, resolution_unit int, dpi_x double, dpi_y double, page_name string, icc binary, xmp binary, iptc binary, exif binary"
PIXELS = "width int, height int, descriptor string, pixels binary"
#: Bytes of binary results that are held before they are sent on.
_HELD = 16 << 20
TAG = "page int, dest string, tag int, type int, count bigint, raw binary"


def attempt(work: Callable[..., dict], names: list[str], *arguments) -> tuple:
    """Fields and error of one row; whatever is raised becomes the error."""
    if arguments[0] is None:
        return (None,) * (len(names) + 1)
    try:
        found = work(*arguments)
        return (*(found[name] for name in names), None)
    except tiff.TiffError as error:
        return (None,) * len(names) + ({"kind": error.kind, "message": str(error)},)
    except Exception as error:  # noqa: BLE001  a defect of one file must not end the job
        return (None,) * len(names) + ({"kind": "Decode", "message": f"{type(error).__name__}: {error}"},)


def struct_udf(work: Callable[..., dict], fields: str):
    """A struct-valued Arrow UDF of a function of one row; commas in <> don't separate fields."""
    names = [field.split()[0] for field in re.sub("<.*>", "", fields).split(", ")]

    @F.pandas_udf(f"{fields}, {ERROR}")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False, name=None):
                rows.append(attempt(work, names, *row))
                held += sum(len(v) for v in rows[-1] if isinstance(v, bytes))
                if held > _HELD:
                    yield pd.DataFrame(rows, columns=[*names, "error"], dtype=object)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=[*names, "error"], dtype=object)

    return run


def tiff_info(content: Column) -> Column:
    """Struct of what a probe tells."""
    return struct_udf(lambda data: tiff.info(bytes(data)), INFO)(F.struct(content))


def tiff_pixels(content: Column, palettes: bool = True, **limits: int) -> Column:
    """Struct of the first page's pixels; indices only with ``palettes``; sizes beyond the default limits, or those given, are errors before pixels are made."""
    asked = DEFAULT_LIMITS | limits
    return struct_udf(lambda data: tiff.decode(bytes(data), asked, palettes=palettes), PIXELS)(F.struct(content))


def tiff_decode(content: Column, limits: dict | None = None, hint: Column | None = None, asked: Column | None = None, **policy: bool) -> Column:
    """Struct of pixels and metadata as a decode job gives them.

    ``hint`` is preserve (default), correct, exact or both, ``asked`` the orientation of the
    last two; ``policy`` may forbid icc, exif or xmp.
    """
    work = lambda data, hint, asked: tiff.decode_job(bytes(data), limits, hint or "preserve", None if pd.isna(asked) else int(asked), **policy)
    return struct_udf(work, f"{PIXELS}, orientation int, icc binary, exif binary, xmp binary")(F.struct(content.alias("c0"), (F.lit("preserve") if hint is None else hint).alias("c1"), (F.lit(None).cast("int") if asked is None else asked).alias("c2")))


def encode_tiff(pixels: Column, width: Column, height: Column, descriptor: Column, method: Column, hpred: Column, big: Column, orientation: Column | None = None, icc: Column | None = None, xmp: Column | None = None, exif: Column | None = None, limits: dict | None = None) -> Column:
    """Struct (content, error): the file for a row of pixels, unless it is beyond the job's limits."""

    def work(pixels, width, height, descriptor, method, hpred, big, orientation, icc, xmp, exif) -> dict:
        metadata = {"orientation": None if orientation is None or pd.isna(orientation) else int(orientation), "icc": icc, "xmp": xmp, "exif": exif and bytes(exif)}
        return {"content": tiff.encode_job(bytes(pixels), int(width), int(height), descriptor, method, bool(hpred), bool(big), metadata, limits)}

    empty = F.lit(None).cast("binary")
    rest = [F.lit(None).cast("int") if orientation is None else orientation, *[empty if x is None else x for x in (icc, xmp, exif)]]
    named = [x.alias(f"c{i}") for i, x in enumerate((pixels, width, height, descriptor, method, hpred, big, *rest))]
    return struct_udf(work, "content binary")(F.struct(*named))


def _tags(data: bytes) -> dict:
    order, big, _ = tiff.header(data)
    rows = []
    for page, entries in enumerate(tiff.pages(data)):
        d = tiff.Directory(entries, order)
        groups = [("ifd0", entries)]
        for dest, pointer in (("exif", tiff.EXIF_POINTER), ("gps", tiff.GPS_POINTER)):
            inner = tiff.directory(data, d.one(pointer), order, big) if d.one(pointer) else None
            groups.append((dest, inner[0] if inner else []))
        rows += [{"page": page, "dest": dest, "tag": e[0], "type": e[1], "count": e[2], "raw": e[3]} for dest, found in groups for e in found]
    return {"tags": rows}


def tiff_tags(df: DataFrame, content: str = "content") -> DataFrame:
    """One row for every tag of every page and of its EXIF and GPS directories, in file order.

    Other columns stay; the new one is the struct ``tag``. Files that can't be read give no rows.
    """
    found = struct_udf(lambda data: _tags(bytes(data)), f"tags array<struct<{TAG.replace(' ', ': ').replace(',: ', ', ')}>>")(F.struct(F.col(content)))
    return df.withColumn("tag", F.explode(found["tags"]))


def best_variant(images: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """The smallest lossless file of every image: key, cell_id, n_bytes; null where an image can't be written.

    ``images`` has key, pixels, width, height and descriptor; ``cells`` is the variant plan, at
    most 14 rows. Each image is tried where it is, so nothing passes a shuffle; ties go to
    the cell earlier in the plan.
    """
    plan = cells.where(~F.col("dropped")).orderBy("deviations", "idx_sum", "ci", "pi", "bi").collect()
    tried = tuple((r.method, r.predictor == "horizontal", r.big_tiff) for r in plan)

    def work(pixels, width, height, descriptor) -> dict:
        n_bytes, i = tiff.smallest(bytes(pixels), int(width), int(height), descriptor, tried)
        return {"n_bytes": n_bytes, "cell_id": plan[i].cell_id}

    best = struct_udf(work, "n_bytes int, cell_id string")(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(("pixels", "width", "height", "descriptor"))]))
    return images.select(key, best.alias("best")).select(key, "best.cell_id", "best.n_bytes")
