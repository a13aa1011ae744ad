"""Exact dedup by Patricia-trie owners.

Texts are equal when identical after each run of ASCII white space became one space.
Equal texts of an Arrow batch are merged first (by their bytes), so a group that holds
a third of all rows reaches its trie as one row a batch. Rows then go to partitions by
length and content hash; each partition inserts the full byte strings into a compressed
radix trie whose terminal nodes keep the smallest id, and spills subtrees when it holds
more than ``spill_bytes``.

``keep_first`` sends whole rows to the tries, in the order of their ids: the first row of a
string is passed on as it is inserted and the others go, so a text is exchanged once.
Rows that come to a spilled subtree are spilled with it and told apart at the end.

Defined results: a null text is an empty text; a null doc_id is larger than any id, so
it owns a group only if all its ids are null (keep_id is then null); rows repeated with
the same doc_id and text are copies of which exactly one is kept; an empty table gives
an empty result; other columns pass through ``keep_first`` untouched and are ignored
otherwise. Very long texts are handled whole. Spilled subtrees are files of their own
task, which are gone with it; a task that is run again spills again.
"""

from __future__ import annotations

import pickle
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import columns_of, cut, hot_limit, in_slices, left_join_salted

#: Runs that differ from one single space.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

_PART = pa.schema([("size", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("owner", pa.int64()), ("n", pa.int64()), ("at_owner", pa.int64())])
_OWNER = pa.schema([("sha", pa.string()), ("owner", pa.int64()), ("n", pa.int64()), ("at_owner", pa.int64())])


def normalised(column):
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), _RUNS, " ")


def one_space(text: bytes | None) -> bytes:
    """:func:`normalised` of one text; bytes.split() parts it at the same six characters."""
    if not text:
        return b""
    words = b" ".join(text.split())
    if not words:
        return b" "
    return (b" " if text[:1].isspace() else b"") + words + (b" " if text[-1:].isspace() else b"")


def _merge(x: tuple | None, y: tuple) -> tuple:
    """Owners (id, rows, rows with that id) of one text taken together; null ids come last."""
    if x is None:
        return y
    if x[0] == y[0]:
        return x[0], x[1] + y[1], x[2] + y[2]
    first = x if y[0] is None or (x[0] is not None and x[0] < y[0]) else y
    return first[0], x[1] + y[1], first[2]


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _drain(file) -> Iterator[tuple]:
    """The entries of a spilled subtree; the file goes."""
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            break
    file.close()


class _Node:
    __slots__ = ("edge", "below", "value", "spill")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.below, self.value, self.spill = edge, {}, None, None


class OwnerTrie:
    """Compressed radix trie from byte strings to owners, in bounded memory."""

    def __init__(self, spill_bytes: int = 128 << 20) -> None:
        self.top, self.limit, self.held = _Node(b""), spill_bytes, 0

    def add(self, body: bytes, sha: str | None, value: tuple, late: Callable[[], bytes] | None = None) -> bool | None:
        """Whether ``body`` is new; None if its subtree is spilled, where what ``late`` makes takes the place of ``sha``."""
        node, at = self.top, 0
        while True:
            if node.spill is not None:
                pickle.dump((body[at:], late() if late else sha, value), node.spill)
                return None
            if at == len(body):
                new = node.value is None
                node.value = (sha, _merge(node.value and node.value[1], value))
                return new
            child = node.below.get(body[at])
            if child is None:
                child = node.below[body[at]] = _Node(body[at:])
                child.value = (sha, value)
                self.held += len(body) - at + 400
                break
            if body.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
                continue
            n = _shared(child.edge, body[at : at + len(child.edge)])
            fork = _Node(child.edge[:n])
            child.edge = child.edge[n:]
            fork.below[child.edge[0]] = child
            node.below[body[at]] = fork
            node, at = fork, at + n
        if self.held > self.limit:
            self._spill()
        return True

    def _spill(self) -> None:
        """Move every subtree below the top to a file of its own; later strings with that start follow it."""
        for child in self.top.below.values():
            if child.spill is None:
                file = tempfile.TemporaryFile(prefix="trie-")
                for rest, (sha, value) in self._walk(child, b""):
                    pickle.dump((rest, sha, value), file)
                child.below, child.value, child.spill = {}, None, file
        self.held = 0

    def _walk(self, node: _Node, path: bytes) -> Iterator[tuple]:
        stack = [(node, path)]
        while stack:
            node, path = stack.pop()
            if node.value is not None:
                yield path, node.value
            if node.spill is not None:
                yield from ((path + rest, (sha, value)) for rest, sha, value in _drain(node.spill))
            stack += [(child, path + child.edge) for child in node.below.values()]

    def owners(self) -> Iterator[tuple]:
        """(sha, owner) of every string."""
        stack = [self.top]
        while stack:
            node = stack.pop()
            if node.value is not None:
                yield node.value
            stack += node.below.values()
            if node.spill is not None:
                inner = OwnerTrie(self.limit)
                for entry in _drain(node.spill):
                    inner.add(*entry)
                yield from inner.owners()

    def late(self) -> Iterator[bytes]:
        """What :meth:`add` was given for those spilled strings of which none was there before."""
        stack = [self.top]
        while stack:
            node = stack.pop()
            stack += node.below.values()
            if node.spill is not None:
                inner = OwnerTrie(self.limit)
                for rest, made, value in _drain(node.spill):
                    if inner.add(rest, None, value, lambda made=made: made) and made is not None:
                        yield made
                yield from inner.late()


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, shas, bodies = columns_of(batch)
        found: dict[bytes, tuple] = {}
        sha_of: dict[bytes, str] = {}
        for doc, sha, body in zip(ids, shas, bodies, strict=True):
            found[body] = _merge(found.get(body), (doc, 1, 1))
            sha_of[body] = sha
        rows = ((len(body), sha_of[body], body, *value) for body, value in found.items())
        yield from in_slices(rows, _PART, weigh=lambda row: row[0])


def _tries(spill_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = OwnerTrie(spill_bytes)
        for batch in batches:
            for _, sha, body, owner, n, at_owner in zip(*columns_of(batch), strict=True):
                trie.add(body, sha, (owner, n, at_owner))
        yield from in_slices(((sha, *value) for sha, value in trie.owners() if value[1] > 1), _OWNER)

    return run


def _joined(df: DataFrame, doc_id: str, text: str, spill_bytes: int, rows: DataFrame) -> DataFrame:
    """``rows`` (with columns _id, _sha) and the owner of each row's group."""
    body = normalised(F.col(text))
    parts = df.select(F.col(doc_id).cast("long").alias("id"), F.sha2(body.cast("binary"), 256).alias("sha"), body.cast("binary").alias("body"))
    parts = parts.mapInArrow(_combine, "size long, sha string, body binary, owner long, n long, at_owner long")
    owners = cut(parts.repartition("size", "sha").mapInArrow(_tries(spill_bytes), "sha string, owner long, n long, at_owner long"))
    found = owners.select(F.col("sha").alias("_sha"), F.col("owner").alias("_owner"), F.col("n").alias("_n"), F.col("at_owner").alias("_at"))
    found = found.withColumn("_rows", F.col("_n"))
    out = left_join_salted(rows, found, "_sha", "_rows", hot_limit(df, df.count()), ["_id"])
    first = F.coalesce(F.col("_n").isNull() | F.col("_id").eqNullSafe(F.col("_owner")), F.lit(False))
    if owners.where("at_owner > 1").isEmpty():
        return out.withColumn("_kept", first)
    # Rows of one id and text may be very many: one of each task's first, then one of those; the others stay spread by task.
    out = out.withColumn("_task", F.spark_partition_id())
    out = out.withColumn("_one", F.row_number().over(Window.partitionBy("_sha", "_id", "_task").orderBy(F.lit(0))) == 1)
    out = out.withColumn("_task", F.when(F.col("_one"), -1).otherwise(F.col("_task")))
    return out.withColumn("_kept", first & F.col("_one") & (F.row_number().over(Window.partitionBy("_sha", "_id", "_task").orderBy(F.lit(0))) == 1)).drop("_task", "_one")


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", spill_bytes: int = 128 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = df.select(F.col(doc_id).cast("long").alias("_id"), F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("_sha"))
    return _joined(df, doc_id, text, spill_bytes, rows).select(
        F.col("_id").alias("doc_id"),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_owner")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def _texts(batch: pa.RecordBatch, text: str) -> pa.Array:
    return batch.column("row").field(text).cast(pa.binary())


def _first_of_batch(text: str):
    """Of equal texts of a batch the row of the smallest id; rows of different hashes are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids = batch.column("hash").to_pylist(), batch.column("id").to_pylist()
            bodies, often = _texts(batch, text), Counter(hashes)
            best: dict[tuple, int] = {}
            for i, x in enumerate(hashes):
                key = (x, one_space(bodies[i].as_py()) if often[x] > 1 else b"")
                j = best.setdefault(key, i)
                if ids[i] is not None and (ids[j] is None or ids[i] < ids[j]):
                    best[key] = i
            yield batch if len(best) == batch.num_rows else batch.take(pa.array(sorted(best.values()), pa.int64()))

    return run


def _first_rows(text: str, spill_bytes: int, most: int = 16 << 20):
    """The first row of every text, of rows that come by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, schema = OwnerTrie(spill_bytes), None
        for batch in batches:
            schema, bodies, kept = batch.schema, _texts(batch, text), []
            for i in range(batch.num_rows):
                if trie.add(one_space(bodies[i].as_py()), None, (None, 1, 1), lambda i=i, batch=batch: batch.slice(i, 1).serialize().to_pybytes()):
                    kept.append(i)
            if kept:
                yield batch if len(kept) == batch.num_rows else batch.take(pa.array(kept, pa.int64()))
        held, weight = [], 0
        for made in trie.late():
            held.append(pa.ipc.read_record_batch(pa.py_buffer(made), schema))
            weight += len(made)
            if weight > most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, weight = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", spill_bytes: int = 128 << 20) -> DataFrame:
    """The rows of ``df``, all columns as they were, without the later copies of a text."""
    packed = F.struct(*[F.col(f"`{name}`") for name in df.columns])
    rows = df.select(F.xxhash64(normalised(F.col(text))).alias("hash"), F.col(doc_id).cast("long").alias("id"), packed.alias("row"))
    row = StructField("row", rows.schema["row"].dataType)
    spread = rows.mapInArrow(_first_of_batch(text), StructType([StructField("hash", LongType()), StructField("id", LongType()), row])).repartition("hash")
    ordered = spread.sortWithinPartitions(F.col("id").asc_nulls_last()).select("row")
    return ordered.mapInArrow(_first_rows(text, spill_bytes), StructType([row])).select("row.*")
