"""Helpers shared by the operators: checkpoints, Arrow rows, hashing, components."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..session import drop_folder, settled, shared_folder  # noqa: F401

#: ASCII white space of the text contracts: 0x20 and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"

#: The shared checkpoint folder.
ensure_checkpoints = shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there from now on; the files go with the last reference to it."""
    return settled(df)


class Tables(session.Tables):
    """Large tables of one operator call, which also lets go of shuffle files; the last step of what reads them is a :func:`cut`."""

    def release(self) -> None:
        """Let Spark drop the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        """Delete the tables, then :meth:`release`."""
        super().__exit__()
        self.release()

    def __exit__(self, *_) -> None:
        self.drop()


def hot_limit(df: DataFrame, rows: int) -> int:
    """A quarter of a shuffle partition's share of ``rows``; fewer than four keys a partition can have more."""
    return max(1, rows // (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def join_counted(left: DataFrame, right: DataFrame, on: str, count: str, limit: int) -> DataFrame:
    """Inner join with ``right``, a few numbers for each key, once each; ``count`` says how many rows of ``left`` have it, and goes.

    Keys of more than ``limit`` rows, with :func:`hot_limit` fewer than four a shuffle partition,
    come to the driver and are broadcast, so their rows stay where they are; only the others'
    rows are exchanged. ``right`` is read twice: write it first.
    """
    hot = [row[0] for row in right.where(F.col(count) > limit).select(on).collect()]
    right = right.drop(count)
    if not hot:
        return left.join(right, on)
    chosen = F.col(on).isin(hot)
    return left.where(~chosen).join(right.where(~chosen), on).unionByName(left.where(chosen).join(F.broadcast(right.where(chosen)), on))


def left_join_salted(left: DataFrame, right: DataFrame, on: str, count: str, limit: int, by: list[str]) -> DataFrame:
    """Left join with ``right``, which has each key once; ``count`` says how many rows of ``left`` have it, and goes.

    Keys of more than ``limit`` rows are dealt over so many salts, by a hash of the columns ``by``
    of ``left``, that a task gets about ``limit`` of them; only these keys are broadcast, and
    with :func:`hot_limit` they are fewer than four a shuffle partition.
    """
    salts = F.ceil(F.col(count) / limit).cast("int")
    hot = right.where(F.col(count) > limit).select(on, salts.alias("_salts"))
    dealt = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > limit, salts).otherwise(1) - 1)))
    own = F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1))).cast("int")
    marked = left.join(F.broadcast(hot), on, "left").withColumn("_salt", own).drop("_salts")
    return marked.join(dealt, [on, "_salt"], "left").drop("_salt", count)


def columns_of(batch: pa.RecordBatch) -> list[list]:
    """The columns of a batch as Python lists."""
    return [column.to_pylist() for column in batch.columns]


def rows_of(batch: pa.RecordBatch, count: int = 256) -> Iterator[tuple]:
    """The rows of a batch; no more than ``count`` of them are Python objects at a time."""
    for start in range(0, batch.num_rows, count):
        yield from zip(*columns_of(batch.slice(start, count)), strict=True)


def batch_of(schema: pa.Schema, columns: Iterable[list]) -> pa.RecordBatch:
    """A batch of ``schema`` from one list per field."""
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(columns, schema, strict=True)],
        schema=schema,
    )


def in_slices(rows: Iterator[tuple], schema: pa.Schema, count: int = 4096, weigh=None, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``count`` rows and, by ``weigh(row)``, about ``most`` bytes."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 0
        if len(held) >= count or weight >= most:
            yield batch_of(schema, zip(*held, strict=True))
            held, weight = [], 0
    if held:
        yield batch_of(schema, zip(*held, strict=True))


def training_half(doc_id: str = "doc_id"):
    """Rows whose labels may be learned: crc32(doc_id as text) mod 3 is not 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def held_out(doc_id: str = "doc_id"):
    """The complement of :func:`training_half`; false where the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor, shift and multiply) over an unsigned array."""
    x = values.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Forest:
    """Union-find over hashable members; the smaller root wins."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        top = x
        while (above := self.up.get(top, top)) != top:
            top = above
        while (above := self.up.get(x, x)) != x:
            self.up[x], x = top, above
        return top

    def link(self, x, y) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), smallest member as component.

    Alternates large-star and small-star contraction; every round is two joins and
    aggregations on the executors, and reliable checkpoints cut the lineage. Nodes
    without an edge do not appear. Only a count and a checksum reach the driver. Rounds
    grow with the logarithm of the longest chain; ``rounds`` is a stop against endless
    work, which raises and never returns unfinished components.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            break
        mark = found
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = cut(small.distinct())
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled training documents (text, label), the same for the same tables.

    The ids are the ``rows`` smallest hashes of the training half, so the sample is bounded
    whatever the tables hold; joining it broadcasts at most ``rows`` ids. Of documents with
    one id the smallest text is taken. Written once.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & training_half()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    return cut(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label"))
