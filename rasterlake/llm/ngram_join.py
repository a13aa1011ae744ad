"""N-gram Jaccard join in size-banded tiles with bitmap signatures.

A document's set holds the 64-bit hashes of its distinct word shingles. Routes bring
documents that may link into the same tile: ``bands`` groups of ``rows`` min-hashes,
so many that a pair at the threshold misses every one with a chance below 1e-9
whatever the input is. In a tile, documents are ordered by size; a pair is looked at
only if its sizes allow the threshold (the size band), then only if the common bits of
two hashed bitmaps allow it (from the bit counts, overlap <= |x| - |bits only in x|),
then decided by exact intersection of the sorted sets.

Whatever the size of a group, no task holds it: documents with equal sets (by a 128-bit hash
of the set) are one representative with a number of its own; a route's members are dealt into blocks of ``block`` documents which
all hold the route's leader (its smallest id). After this first pass, routes whose
members are not yet one component get a second pass: members outside a route's largest
component meet every block of it, so that every pair of a route is either in one
component or tested. Within a tile, pairs of one component aren't looked at again.

Defined results: a null text and a text without words have an empty set, which links
with nothing; fewer words than a shingle are one shingle; a null id takes part with no
id of its own, and its component is the smallest id of those linked (null if none);
repeated rows are copies; ties go to the smallest id; other columns are ignored; an
empty table gives an empty result; very long texts take part whole, with all their shingles.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, Tables, columns_of, components, cut, in_slices, mix

_SET = pa.schema([("id", pa.int64()), ("mark", pa.binary()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("routes", pa.list_(pa.int64()))])
_ITEMS = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("items", pa.binary())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_REMEMBERED = 200_000


def route_plan(threshold: float, rows: int = 4, miss: float = 1e-9) -> tuple[int, int]:
    """(bands, rows) with which a pair at the threshold is missed with a chance of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows)), rows


class _Words(dict):
    """64-bit hashes of words, in bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: bytes, k: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``k`` words."""
    parts = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    k = min(k, one.size)
    out = np.full(one.size - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x100000001B3) ^ one[i : one.size - k + 1 + i])
    return np.unique(out)


def _routes(items: np.ndarray, seeds: np.ndarray, rows: int) -> list[int]:
    least = np.full(seeds.size, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, items.size, 2048):
        part = items[start : start + 2048, None]
        np.minimum(least, ((part ^ seeds) * np.uint64(0xFF51AFD7ED558CCD)).min(0), out=least)
    bands = least.reshape(-1, rows)
    key = np.arange(len(bands), dtype=np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(0x100000001B3) ^ bands[:, i])
    return key.astype(np.int64).tolist()


def _name(items: np.ndarray) -> tuple[int, int]:
    """A set's name, the halves of a 128-bit hash of it."""
    return struct.unpack(">qq", xxhash.xxh3_128_digest(items.tobytes()))


def _items(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()

        def made():
            for batch in batches:
                for packed in batch.column(0).to_pylist():
                    items = shingles(zlib.decompress(packed), k, words)
                    yield *_name(items), items.tobytes()

        yield from in_slices(made(), _ITEMS, weigh=lambda row: len(row[2]))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, text) with the text compressed, as it is to be exchanged; each text of a batch once."""
    for batch in batches:
        texts = dict(zip(*columns_of(batch), strict=True))
        packed = [zlib.compress(text, 1) for text in texts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(packed, pa.binary())], names=["mark", "packed"])


def _sets(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(bands * rows, dtype=np.uint64), 3)
        words = _Words()

        def made():
            for batch in batches:
                for doc, text, mark in zip(*columns_of(batch), strict=True):
                    items = shingles(text or b"", k, words)
                    yield doc, mark, items.size, *_name(items), (_routes(items, seeds, rows) if items.size else None)

        yield from in_slices(made(), _SET)

    return run


def _bitmap(items: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    at = (items & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view(np.uint64)


class _Tile:
    """The documents of one block of a route, largest first; links between components."""

    def __init__(self, percent: int, bits: int = 2048) -> None:
        self.percent, self.bits = percent, bits

    def links(self, members: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int]]:
        """``members``: (digest, component so far, set)."""
        rows = sorted(((np.frombuffer(body, np.uint64), digest, comp) for digest, comp, body in {m[0]: m for m in members}.values()), key=lambda r: (len(r[0]), r[1]))
        size = np.array([len(r[0]) for r in rows], np.int64)
        maps = np.array([_bitmap(r[0], self.bits) for r in rows])
        forest = Forest()
        names = sorted({r[2] for r in rows})
        number = {name: i for i, name in enumerate(names)}
        comp = np.array([number[r[2]] for r in rows])  # roots of the forest over components
        for i, (items, digest, _) in enumerate(rows):
            low = int(np.searchsorted(size, -(-self.percent * size[i] // 100)))  # the size band below i
            other = np.arange(low, i)
            other = other[comp[other] != comp[i]]
            if not other.size:
                continue
            missing = np.bitwise_count(maps[i] & ~maps[other]).sum(1, dtype=np.int64)  # of i's items, surely not in the other
            most = np.minimum(size[i] - missing, size[other])
            missing = np.bitwise_count(maps[other] & ~maps[i]).sum(1, dtype=np.int64)
            most = np.minimum(most, size[other] - missing)
            other = other[100 * most >= self.percent * (size[i] + size[other] - most)]
            for j in other[::-1].tolist():
                if comp[j] == comp[i]:
                    continue
                common = np.intersect1d(items, rows[j][0], assume_unique=True).size
                if 100 * common >= self.percent * (size[i] + size[j] - common):
                    yield digest, rows[j][1]
                    forest.link(int(comp[i]), int(comp[j]))
                    keep, gone = min(comp[i], comp[j]), max(comp[i], comp[j])
                    comp[comp == gone] = keep


def _tiles(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            tile, key, held = _Tile(percent), None, []
            for batch in batches:
                for route, block, digest, comp, items in zip(*columns_of(batch), strict=True):
                    if (route, block) != key:
                        if len(held) > 1:
                            yield from tile.links(held)
                        key, held = (route, block), []
                    held.append((digest, comp, items))
            if len(held) > 1:
                yield from tile.links(held)

        yield from in_slices(made(), _LINK)

    return run


def _pass(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the tiles (route, block) with members ``digest`` of component ``comp``."""
    rows = placed.join(sets, "digest").select("route", "block", "digest", "comp", "items")
    rows = rows.repartition("route", "block").sortWithinPartitions("route", "block")
    return rows.mapInArrow(_tiles(percent), "a long, b long")


def _mark(text: str) -> Column:
    """A name of 128 bits for a text; null texts have one of their own."""
    return F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b""))


def classes(df: DataFrame, k: int = 4, percent: int = 85, block: int = 256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class (a number, equal for linked rows) and mark (a hash of the text)."""
    with Tables(df.sparkSession) as tables:
        return cut(_classes(df, tables, k, percent, block, doc_id, text))


def _classes(df: DataFrame, tables: Tables, k: int, percent: int, block: int, doc_id: str, text: str) -> DataFrame:
    """As :func:`classes`; the result reads ``tables``."""
    bands, rows = route_plan(percent / 100)
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"), _mark(text).alias("mark"))
    ids = tables.write(docs.mapInArrow(_sets(k, bands, rows), "id long, mark binary, n long, d1 long, d2 long, routes array<long>"))
    # a set that many rows share is one row; its number is written, so it is the same for all who read it
    reps = ids.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("least"), F.min("mark").alias("mark"), F.first("routes").alias("routes"))
    reps = tables.write(reps.withColumn("digest", F.monotonically_increasing_id()))
    keys = reps.select("digest", F.explode("routes").alias("route"))
    led = keys.groupBy("route").agg(F.min("digest").alias("leader"), F.max("digest").alias("last"), F.count("*").alias("m")).where("leader <> last")
    kept = tables.write(keys.join(led, "route").select("route", "digest", "leader", "m"))
    # of the routes with the same leader, each document needs its tile once
    members = kept.groupBy("leader", "digest").agg(F.max("m").alias("m"))
    # their texts, one a set: only compressed texts are exchanged
    needed = reps.select("d1", "d2", "digest", "mark").join(kept.select("digest").distinct(), "digest", "left_semi")
    texts = docs.where("text is not null").select("mark", "text").mapInArrow(_packed, "mark binary, packed binary").join(needed.select("mark").distinct(), "mark", "left_semi")
    items = texts.select("packed").mapInArrow(_items(k), "d1 long, d2 long, items binary").groupBy("d1", "d2").agg(F.first("items").alias("items"))
    sets = tables.write(items.join(needed, ["d1", "d2"]).select("digest", "items"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / block)).cast("int")
    first = members.where("digest <> leader").select(F.xxhash64("leader").alias("route"), F.pmod(F.xxhash64("digest"), blocks).cast("int").alias("block"), "digest", "leader")
    tops = first.select("route", "block", F.col("leader").alias("digest")).distinct()
    placed = first.select("route", "block", "digest").unionByName(tops).withColumn("comp", F.col("digest"))
    links = cut(_pass(placed, sets, percent).distinct())
    comps = cut(components(links))
    # second pass: the routes whose members are in several components
    known = kept.join(comps.withColumnRenamed("node", "digest"), "digest", "left").select("route", "digest", "m", F.coalesce("component", "digest").alias("comp"))
    seen = known.groupBy("route").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("mark"))
    open_ = seen.where("low <> high").groupBy("c", "mark").agg(F.min("route").alias("route"))  # routes of the same members need one tile
    counts = known.join(open_.select("route"), "route").groupBy("route", "comp").agg(F.count("*").alias("c"))
    mains = counts.groupBy("route").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    # all routes with one main component share its tiles: a member is in one block, and a member of
    # another component is in one chunk and meets every block; each pair (block, chunk) is a tile
    again = known.join(mains, "route").select(F.col("main").alias("route"), "digest", "comp").distinct()
    loads = again.groupBy("route").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("comp") != F.col("route")) / (4 * block)).cast("int").alias("chunks"))
    again = tables.write(again.join(loads, "route"))
    left = again.withColumn("i", F.pmod(F.xxhash64("digest"), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = again.where("comp <> route").withColumn("j", F.pmod(F.xxhash64("digest"), F.col("chunks"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = ["route", (F.col("i") * F.col("chunks") + F.col("j")).cast("int").alias("block"), "digest", "comp"]
    more = _pass(left.select(*tile).unionByName(right.select(*tile)), sets, percent)
    # its links are between components of the first pass, so only these are joined again
    more = cut(more)
    found = comps.withColumnRenamed("node", "digest")
    if not more.isEmpty():
        name = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"{side}_class"))
        upper = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b"))
        upper = cut(components(upper).select(F.col("node").alias("component"), F.col("component").alias("top")))
        found = found.join(upper, "component", "left").select("digest", F.coalesce("top", "component").alias("component"))
        alone = upper.join(comps.select(F.col("node").alias("known")), F.col("component") == F.col("known"), "left_anti")
        found = found.unionByName(alone.select(F.col("component").alias("digest"), F.col("top").alias("component")))
    # the smallest id of each class; partial aggregation comes before each exchange
    least = reps.select("d1", "d2", "digest", "least").join(found, "digest", "left")
    least = cut(least.select("d1", "d2", "least", F.coalesce("component", "digest").alias("class")))
    smallest = least.groupBy("class").agg(F.min("least").alias("smallest"))
    found = least.join(smallest, "class").select("d1", "d2", "class", "smallest")
    return ids.select("id", "mark", "n", "d1", "d2").join(found, ["d1", "d2"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("smallest", "id").alias("component_id"),
        "class",
        "mark",
    )


def keep_one(df: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they were, with one row of each class: the smallest id, ids before null.

    Texts without words are in no class and stay. Rows repeated with one id and text are
    one row to this choice: remove them first.
    """
    found = classes(df, k, percent, doc_id=doc_id, text=text)
    first = found.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))).alias("f"))
    kept = first.select("f._id", "f._mark").unionByName(found.where(F.col("class").isNull()).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))).distinct()
    rows = df.select(F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("_row"), F.col(doc_id).cast("long").alias("_a"), _mark(text).alias("_b"))
    return rows.join(kept, F.col("_a").eqNullSafe(F.col("_id")) & (F.col("_b") == F.col("_mark")), "left_semi").select("_row.*")
