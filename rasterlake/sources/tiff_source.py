"""``format("tiff")``: TIFF files as a Spark data source, read and written by Arrow batches.

Reading gives a row for each file, or, with ``rows = "strips"``, one for each strip or tile,
so that an image larger than a task's memory is spread over tasks. Only slices of a file are
read: its header and directory, and pixels if ``pixels`` is among the columns of the schema
that is asked for. Filters on header columns are pushed: those on path and size before any
file is opened, others before pixels are made. Files, or byte ranges of large files, are
packed into partitions by size.

Writing stages the files of a task in a folder of its own and moves it when the job commits;
a failed or repeated task leaves nothing.

Millions of small files are better off in bundles, which are tar archives (``bundles.py``):
with ``bundleBytes`` a task writes its files into archives of about that size, and with
``bundles`` archives that are read stand for their members, each with the archive's path and its own.
Neither listing nor driver then has an entry for every image.

Paths are what ``pyarrow.fs`` knows: local ones and URIs of stores. Options: ``rows``
(images or strips), ``bundles`` (true or false), ``bundleBytes``, ``bundlePartitionBytes``, ``maxPartitionBytes``, ``openCostInBytes``; limits of decoding ``max_width``,
``max_height``, ``max_pixels``, ``max_memory``, ``max_input``. Names beginning with _ or . are skipped.

Defined results: a file that can't be read gives its path, size and an error, in both modes; a file
without a TIFF header is such a file; an empty folder gives an empty table; a column that
the schema asks for and that isn't known is refused. Writing refuses null pixels.
"""

from __future__ import annotations

import operator
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from ..functions.limits import DEFAULT_LIMITS
from . import bundles, tiff

ERROR = "error struct<kind: string, message: string>"
HEADER = "path string, size bigint, width int, height int, color string, bits int, samples int, is_float boolean, big boolean, page_count int, compression int, photometric int, orientation int"
IMAGES = f"{HEADER}, descriptor string, pixels binary, {ERROR}"
STRIPS = f"{HEADER}, strip int, plane int, x int, y int, columns int, rows int, unit int, pixels binary, {ERROR}"
WRITABLE = ("pixels", "width", "height", "descriptor", "name", "method", "hpred", "big", "orientation", "icc", "xmp", "exif")

_TESTS = {ds.IsNotNull: lambda v, _: True, ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le, ds.In: lambda v, many: v in many, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: operator.contains}
_PUSHED = {field.split()[0] for field in HEADER.split(", ")}


def register(spark: SparkSession) -> SparkSession:
    """Make ``format("tiff")`` known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffDataSource)
    return spark


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class Slices:
    """A file of which only slices are read, at least ``block`` bytes at a time; what was read last is kept."""

    def __init__(self, file: pa.NativeFile, size: int, block: int = 1 << 16):
        self.file, self.size, self.block, self.at, self.held, self.read = file, size, block, 0, b"", 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop <= start:
            return b""
        if not self.at <= start <= stop <= self.at + len(self.held):
            self.at, self.held = start, self.file.read_at(max(stop - start, min(self.block, self.size - start)), start)
            self.read += len(self.held)
        return self.held[start - self.at : stop - self.at]


@dataclass
class Piece(ds.InputPartition):
    """Files (path, size), or with ``stop`` the strips of one file, or the members of one bundle, that begin in a range of its bytes."""

    files: list[tuple[str, int]]
    start: int = 0
    stop: int | None = None


class TiffDataSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return STRIPS if self.options.get("rows") == "strips" else IMAGES

    def reader(self, schema: StructType) -> TiffReader:
        return TiffReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> TiffWriter:
        return TiffWriter(self.options, schema, overwrite)


class TiffReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names, self.tests = options["path"], schema.names, []
        self.strips, self.bundles = options.get("rows") == "strips", options.get("bundles", "false").lower() == "true"
        known = {f.split()[0] for f in re.sub("<.*?>", "", STRIPS if self.strips else IMAGES).split(", ")}
        if unknown := set(self.names) - known:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        self.limits = DEFAULT_LIMITS | {k: int(v) for k in ("max_width", "max_height", "max_pixels", "max_memory", "max_input") if (v := options.get(k))}
        self.most, self.cost = int(options.get("maxPartitionBytes", 128 << 20)), int(options.get("openCostInBytes", 1 << 20))
        #: A byte of a bundle of small files takes longer than one of a large file.
        self.bundle_most = min(self.most, int(options.get("bundlePartitionBytes", 8 << 20)))
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow = to_arrow_schema(schema)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.tests.append((f.attribute[0], _TESTS[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def _passes(self, row: dict) -> bool:
        """Whether no pushed filter on the columns of ``row`` refuses it; a null passes none."""
        return all(name not in row or (row[name] is not None and test(row[name], value)) for name, test, value in self.tests)

    def _bundled(self, path: str) -> bool:
        return self.bundles and path.endswith(bundles.SUFFIX)

    def partitions(self) -> list[Piece]:
        store, path = _store(self.path)
        top = store.get_file_info(path)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [top] if top.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        inner = lambda p: p[len(path) :] if top.type == fs.FileType.Directory else ""
        files = sorted((i.path, i.size) for i in found if i.is_file and not any(x[:1] in ("_", ".") for x in inner(i.path).split("/")))
        files = [f for f in files if self._bundled(f[0]) or self._passes({"path": f[0], "size": f[1]})]
        pieces, held, weight = [], [], 0
        for file, size in files:
            most = self.bundle_most if self._bundled(file) else self.most
            if (self.strips or self._bundled(file)) and size > most:
                pieces += [Piece([(file, size)], at, at + most) for at in range(0, size, most)]
                continue
            if held and weight + size + self.cost > most:
                pieces.append(Piece(held))
                held, weight = [], 0
            held.append((file, size))
            weight += size + self.cost
        return [*pieces, *([Piece(held)] if held else [])] or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        """Batches of the columns asked for, of about 16 MB of pixels."""
        store = _store(self.path)[0]
        held, weight = [], 0
        for path, size in partition.files:
            for row in self._rows(store, path, size, partition):
                held.append(row)
                weight += 512 + len(row.get("pixels") or b"")
                if weight > 16 << 20:
                    yield self._batch(held)
                    held, weight = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{name: row.get(name) for name in self.names} for row in rows], schema=self.arrow)

    def _rows(self, store: fs.FileSystem, path: str, size: int, piece: Piece) -> Iterator[dict]:
        if not self._bundled(path):
            yield from self._file(store, path, size, piece)
            return
        try:
            with store.open_input_file(path) as file:
                for name, data in bundles.members(Slices(file, size, 1 << 20), piece.start, piece.stop):
                    yield from self._member({"path": f"{path}/{name}", "size": len(data)}, data)
        except bundles.BundleError as error:
            row = {"path": path, "size": size}
            if self._passes(row | dict.fromkeys(_PUSHED - set(row))):
                yield row | {"error": {"kind": "Decode", "message": str(error)}}

    def _member(self, row: dict, data: bytes | bundles.Window) -> Iterator[dict]:
        if not self._passes(row):
            return
        try:
            yield from self._found(data, row, Piece([]))
        except tiff.TiffError as error:
            if self._passes(row | dict.fromkeys(_PUSHED - set(row))):
                yield row | {"error": {"kind": error.kind, "message": str(error)}}

    def _file(self, store: fs.FileSystem, path: str, size: int, piece: Piece) -> Iterator[dict]:
        row = {"path": path, "size": size}
        try:
            with store.open_input_file(path) as file:
                yield from self._found(Slices(file, size), row, piece)
        except tiff.TiffError as error:
            if piece.start == 0 and self._passes(row | dict.fromkeys(_PUSHED - set(row))):
                yield row | {"error": {"kind": error.kind, "message": str(error)}}

    def _found(self, data: bytes | Slices | bundles.Window, row: dict, piece: Piece) -> Iterator[dict]:
        """Rows of a file; ``row`` gets what its header tells."""
        d, count, big = tiff.first_page(data)
        row |= tiff.summary(d, count, big)
        if self._passes(row):
            yield from self._strips(data, d, row, piece) if self.strips else self._image(data, d, row)

    def _image(self, data: bytes | Slices | bundles.Window, d: tiff.Directory, row: dict) -> Iterator[dict]:
        if not {"pixels", "descriptor"} & set(self.names):
            yield row
            return
        made = tiff.decode(data, self.limits, page=d)
        yield row | {"descriptor": made["descriptor"], "pixels": made["pixels"] if "pixels" in self.names else None}

    def _strips(self, data: bytes | Slices | bundles.Window, d: tiff.Directory, row: dict, piece: Piece) -> Iterator[dict]:
        color = tiff.color_type(d)
        places, how = tiff.grid_of(d)
        for i, place in enumerate(places):
            plane, x, y, across, down, offset, length = place
            if piece.stop is not None and not piece.start <= offset < piece.stop and not (piece.start == 0 and offset >= len(data)):
                continue
            tiff.check_block(across, down, how, color, self.limits)
            grid = tiff.block(data[offset : offset + length], place, how) if "pixels" in self.names else None
            yield row | {"strip": i, "plane": plane, "x": x, "y": y, "columns": min(across, how["width"] - x), "rows": min(down, how["height"] - y), "unit": how["each"] * (grid.dtype.itemsize if grid is not None else -(-how["bits"] // 8)), "pixels": None if grid is None else tiff.little(grid)}


@dataclass
class Staged(ds.WriterCommitMessage):
    folder: str | None
    files: int


class TiffWriter(ds.DataSourceArrowWriter):
    """Columns pixels, width, height, descriptor; where given, name (of the file, without ending), method, hpred, big, orientation, icc, xmp, exif."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.bundle_bytes = int(options.get("bundleBytes", 0))
        if missing := {"pixels", "width", "height", "descriptor"} - set(schema.names):
            raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
        if unknown := set(schema.names) - set(WRITABLE):
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, path = _store(self.path)
        folder, names = f"{path}/_temporary/{self.job}/{uuid.uuid4().hex}", set()
        with bundles.Sink(store, folder, self.bundle_bytes) as sink:
            for batch in iterator:
                for row in batch.to_pylist():
                    name = row.get("name") or f"{len(names):08d}"
                    if not re.fullmatch(r"[\w.-]+", name) or name[0] in "._" or name in names:
                        raise tiff.TiffError("InvalidInput", f"file name {name!r}")
                    names.add(name)
                    if row["pixels"] is None:
                        raise tiff.TiffError("InvalidInput", "no pixels")
                    own = {k: row[k] for k in ("method", "hpred", "big") if row.get(k) is not None}
                    sink.put(f"{name}.tif", tiff.encode_job(row["pixels"], row["width"], row["height"], row["descriptor"], **own, metadata={k: row.get(k) for k in ("orientation", "icc", "xmp", "exif")}))
        return Staged(folder if names else None, len(names))

    def commit(self, messages: list[Staged | None]) -> None:
        """Move every task's folder to its place, then drop what was staged by failed or repeated tasks."""
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path)):
                if not old.base_name.startswith("_temporary"):
                    store.delete_file(old.path) if old.is_file else store.delete_dir(old.path)
        for i, message in enumerate(messages):
            if message and message.folder:
                store.move(message.folder, f"{path}/part-{i:05d}-{self.job}")
        self._clean(store, path)
        with store.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean(*_store(self.path))

    def _clean(self, store: fs.FileSystem, path: str) -> None:
        staged = f"{path}/_temporary/{self.job}"
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)
        above = f"{path}/_temporary"
        if store.get_file_info(above).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(above)):
            store.delete_dir(above)
