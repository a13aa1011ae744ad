"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted, and quantised by
``width``; ``k`` quantised projections together are a bucket of one of ``tables``
tables. At cosine 0.98 (distance 0.2) the number of tables makes a miss in all of them
less likely than 1e-8 for a pair, whatever the input is. In a bucket, cosines in double
precision decide.

Vectors that are equal in all components (by 128 bits of hashes of them) are one
representative with a count and a number of its own, so a group of copies of any size is one row. A bucket of more than ``block`` representatives
is dealt into blocks, and each pair of blocks is a task of its own. A pair that meets
in several tables is counted in the first one only, which the bucket numbers of both
tell. What leaves a bucket is one row a representative, its link count, and links of a
spanning forest, never all pairs.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component, and vectors of a null label, link with nothing (n_links 0, own component);
vectors of different lengths don't link; labels of any type are compared as they are; a null vec_id takes part, but its component is
the smallest id it is linked with; rows repeated with one vec_id count as vectors of
their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, Tables, columns_of, components, cut, in_slices, mix

_SIG = pa.schema([("rep", pa.int64()), ("label", pa.string()), ("n", pa.int64()), ("body", pa.binary()), ("keys", pa.list_(pa.int64()))])
_FOUND = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _signatures(tables: int, k: int, width: float, seed: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}

        def rows():
            for batch in batches:
                for rep, label, n, vector in zip(*columns_of(batch), strict=True):
                    x = np.array(vector, np.float64)
                    unit = x / np.sqrt(x @ x)
                    if x.size not in made:
                        draw = np.random.default_rng(seed + x.size)
                        made[x.size] = draw.standard_normal((tables * k, x.size)), draw.uniform(0, width, tables * k)
                    directions, shift = made[x.size]
                    cells = np.floor((directions @ unit + shift) / width).astype(np.int64).astype(np.uint64).reshape(tables, k)
                    key = np.arange(tables, dtype=np.uint64) + np.uint64(x.size << 32)
                    for i in range(k):
                        key = mix(key * np.uint64(0x100000001B3) ^ cells[:, i])
                    yield rep, label, n, x.astype(kind).tobytes(), key.astype(np.int64).tolist()

        yield from in_slices(rows(), _SIG, count=2048)

    return run


def _block_links(left: list[tuple], right: list[tuple] | None, table: int, threshold: float, kind: type) -> Iterator[tuple]:
    """Link counts and forest links of a block, or of two blocks; members are (rep, n, body, keys of earlier tables)."""
    both = left + (right or [])
    x = np.array([np.frombuffer(m[2], kind) for m in both], np.float64)
    norm = np.sqrt((x * x).sum(1))
    n = np.array([m[1] for m in both], np.int64)
    keys = np.array([m[3] for m in both], np.int64)
    links = np.zeros(len(both), np.int64)
    forest = Forest()
    for start in range(0, len(left), 256):
        a = np.arange(start, min(start + 256, len(left)))
        b = np.arange(len(left), len(both)) if right is not None else np.arange(start, len(left))
        i, j = np.nonzero((x[a] @ x[b].T) / (norm[a, None] * norm[b]) >= threshold)
        i, j = a[i], b[j]
        if right is None:
            i, j = i[i < j], j[i < j]
        if table:
            first = ~(keys[i] == keys[j]).any(1)
            i, j = i[first], j[first]
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            if forest.root(p) != forest.root(q):
                forest.link(p, q)
    for p in np.flatnonzero(links).tolist():
        yield both[p][0], int(links[p]), both[forest.root(p)][0]


def _buckets(threshold: float, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key, sides = None, ({}, {})
            for batch in batches:
                for label, table, bucket, p, q, side, rep, n, body, keys in zip(*columns_of(batch), strict=True):
                    if (label, table, bucket, p, q) != key:
                        if key:
                            yield from done(key, sides)
                        key, sides = (label, table, bucket, p, q), ({}, {})
                    sides[side][rep] = (rep, n, body, keys)
            if key:
                yield from done(key, sides)

        def done(key, sides):
            left, right = list(sides[0].values()), list(sides[1].values())
            if key[3] == key[4]:
                yield from _block_links(left, None, key[1], threshold, kind) if len(left) > 1 else ()
            elif left and right:
                yield from _block_links(left, right, key[1], threshold, kind)

        yield from in_slices(rows(), _FOUND)

    return run


def near_dedup(df: DataFrame, threshold: float = 0.98, tables: int = 40, k: int = 14, width: float = 2.2, block: int = 1024, seed: int = 11) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    with Tables(df.sparkSession) as written:
        return _near_dedup(df, written, threshold, tables, k, width, block, seed)


def _near_dedup(df: DataFrame, written: Tables, threshold: float, tables: int, k: int, width: float, block: int, seed: int) -> DataFrame:
    vector = F.col("embedding")
    norm = F.aggregate(F.transform(vector, lambda c: c.cast("double") * c.cast("double")), F.lit(0.0), lambda a, c: a + c)
    finite = ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col("label").isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(norm > 0, F.lit(False))
    kind = np.float32 if df.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    label = F.col("label") + 0.0 if df.schema["label"].dataType.typeName() in ("float", "double") else F.col("label")  # -0.0 equals 0.0
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), F.when(usable, vector).alias("v"))
    # a group of equal vectors is one row before the exchange already, named by two hashes of label and components
    ids = rows.select("vec_id", "label", "v", *[F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(i), "label", "v")).alias(f"h{i}") for i in (1, 2)])
    reps = ids.where("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    # its number is written, so it is the same for all who read it
    signed = written.write(reps.withColumn("rep", F.monotonically_increasing_id()))
    hashed = written.write(signed.select("rep", "label", "n", "v").mapInArrow(_signatures(tables, k, width, seed, kind), "rep long, label string, n long, body binary, keys array<long>"))
    keyed = hashed.select("rep", "label", F.posexplode("keys").alias("table", "bucket"))
    sizes = keyed.groupBy("label", "table", "bucket").agg(F.count("*").alias("m")).where("m > 1")
    shared = keyed.join(sizes, ["label", "table", "bucket"]).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    own = F.pmod(F.hash("rep"), F.col("blocks"))
    # block i meets block j: it is the left side where i <= j
    placed = shared.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("label", "table", "bucket", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), F.when(F.col("own") <= F.col("o"), 0).otherwise(1).alias("side"), "rep")
    where = ["label", "table", "bucket", "p", "q"]
    full = placed.join(hashed.select("rep", "n", "body", "keys"), "rep").select(*where, "side", "rep", "n", "body", F.slice("keys", F.lit(1), F.col("table")).alias("keys"))
    found = cut(full.repartition(*where).sortWithinPartitions(*where).mapInArrow(_buckets(threshold, kind), "rep long, links long, other long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    named = signed.select("h1", "h2", "rep", "n", "least").join(links, "rep", "left").join(comps, "rep", "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("class"), "least")
    smallest = named.groupBy("class").agg(F.min("least").alias("smallest"))
    final = cut(named.join(smallest, "class").select("h1", "h2", "links", "smallest"))
    out = ids.select("vec_id", "h1", "h2").join(final, ["h1", "h2"], "left")
    component = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
