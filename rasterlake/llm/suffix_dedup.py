"""Suffix-array dedup of long repeated byte strings.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere
else. Finding these strings without one suffix array of the whole corpus:

1. Every window of ``length`` bytes has an anchor: its ``gram``-byte substring of the
   smallest hash (by its upper 32 bits, the leftmost of equals). Equal windows have equal
   anchors at the same offset. Anchors that occur once are dropped by a count over their hashes.
2. The windows of a repeated anchor are split by their offset into blocks of ``step``.
   All windows of a block share a core of ``length - step + 1`` bytes; the block is keyed
   by the core's 128-bit hash, and only the edges left and right of the core are sent.
   So a passage in a third of all documents is one key with few different edges; equal
   rows are merged before they are sent.
3. A task builds an enhanced suffix array over its rows, edge + core symbol + edge, and
   scans it with a stack: every interval of common prefixes of at least ``step`` symbols
   (``length`` bytes) whose suffixes have different symbols to their left is a maximal
   repeat, reported with all its occurrences.

A key of more than ``hot`` rows is split before it is sent: half of a block's windows hold
the first half of the right edge, the others the last half of the left edge, so each half
is a block of ``step / 2`` with that much longer cores, whose rows are far fewer a key. This
is repeated while keys are hot; in blocks of one window the core is all of it, and a key of
several rows is a repeat as it stands. Occurrences become spans of bytes; spans of a text
are merged.

The same search runs over words in place of bytes: a symbol is then a word's 64-bit hash, so
white space between words may differ. ``strip`` also cuts passages of ``words`` words that are
found anywhere else, and ``digests`` counts them.

``repeats`` returns the maximal repeats themselves, one row an occurrence.

Texts are named by 128 bits of their SHA-256, so copies of a text are one text with a flag: a text
that several rows have is removed whole if it has ``length`` bytes.

Defined results: a null text is an empty text; texts shorter than ``length`` keep all
bytes; matches never cross texts and may overlap; repeated rows are copies; a null id
is passed on; other columns are ignored; an empty table gives an empty result; very
long texts are handled whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, columns_of, cut, hot_limit, in_slices, join_counted, left_join_salted, mix, rows_of

_TEXT = pa.schema([("sha", pa.binary()), ("body", pa.binary())])
_ANCHOR = pa.schema([("h", pa.int64()), ("sha", pa.binary()), ("place", pa.int64())])
_ROW = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("sha", pa.binary()), ("at", pa.int32()), ("stop", pa.int32())])
_DDL_ROW = "kind int, key binary, left binary, right binary, sha binary, at int, stop int"
_SPAN = pa.schema([("sha", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])
_REPEAT = pa.schema([("repeat", pa.binary()), ("length", pa.int32()), ("sha", pa.binary()), ("start", pa.int32())])
#: A word as bytes.split() has it, and the bytes of its hash.
_WORD = re.compile(rb"[^ \t-\r]+")
_CODE = 8
_NUMBERS = {1: np.uint8, _CODE: np.uint64}
#: The hashes of single bytes.
_BYTES = mix(np.arange(256, dtype=np.uint8), 5)
#: Numbers of the bytes of words (none of white space), and of places in a word.
_LETTERS = np.where(np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r")), np.uint64(0), mix(np.arange(256), 6))
_WEIGHTS = mix(np.arange(256), 7) | np.uint64(1)
#: The bits of a gram's hash that choose anchors; below them is its place.
_HIGH = np.uint64(0xFFFFFFFF00000000)
#: Rows that a task holds before it sends them.
_HELD = 60_000


class Search(NamedTuple):
    """Strings of ``length`` symbols of ``unit`` bytes: bytes themselves, or words by their hashes."""

    length: int
    gram: int
    step: int
    unit: int = 1

    def checked(self) -> Search:
        """This search, if its parts fit together."""
        for name, size in (("gram", self.gram), ("step", self.step)):
            if size < 1 or size & (size - 1):
                raise ValueError(f"{name} must be a power of two")
        if self.gram > self.length - self.step + 1 or self.length >= 1 << 16:
            raise ValueError("gram must be at most length - step + 1, and length below 65,536")
        return self

    def reader(self) -> Callable[[bytes], bytes]:
        """A function from texts to the bytes of their symbols."""
        return bytes if self.unit == 1 else word_codes


def word_codes(body: bytes) -> bytes:
    """Hashes of the words of a text: sums of its bytes' numbers times those of their places, which white space has no part in."""
    letters = _LETTERS[np.frombuffer(body, np.uint8)]
    inside = np.zeros(letters.size + 1, bool)
    np.not_equal(letters, 0, out=inside[1:])
    starts = np.flatnonzero(inside[1:] > inside[:-1])
    if not starts.size:
        return b""
    letters, starts = letters[starts[0] :], starts - starts[0]
    sizes = np.append(starts[1:], letters.size) - starts
    place = np.arange(letters.size) - starts.repeat(sizes)
    letters *= _WEIGHTS[place] if sizes.max() <= _WEIGHTS.size else mix(place, 7) | np.uint64(1)
    return mix(np.add.reduceat(letters, starts), 8).tobytes()


def of_bytes(length: int = 400, gram: int = 64, step: int = 64) -> Search:
    return Search(length, gram, step).checked()


def of_words(words: int = 51, gram: int = 8, step: int = 16) -> Search:
    return Search(words, gram, step, _CODE).checked()


def _gram_hashes(body: bytes, gram: int, unit: int = 1) -> np.ndarray:
    """Hash of the ``gram`` symbols (a power of two) of ``unit`` bytes from each place, by doubling."""
    h = _BYTES[np.frombuffer(body, np.uint8)] if unit == 1 else mix(np.frombuffer(body, _NUMBERS[unit]), 5)
    size = 1
    while size < gram:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 | 1) ^ ((h[size:] << np.uint64(7)) | (h[size:] >> np.uint64(57)))
        h = h ^ (h >> np.uint64(29))
        size *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchors(body: bytes, length: int, gram: int, unit: int = 1) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) of the anchors of a text, counted in symbols."""
    h = _gram_hashes(body, gram, unit)
    span = length - gram + 1  # grams in a window
    windows = h.size - span + 1
    padded = np.full(-(-h.size // span) * span, np.iinfo(np.uint64).max, np.uint64)
    # a place below its hash: the least of a window is then the leftmost of equals, and says where it is
    np.bitwise_or(h & _HIGH, np.arange(h.size, dtype=np.uint64), out=padded[: h.size])
    blocks = padded.reshape(-1, span)
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    upto = np.minimum.accumulate(blocks, 1).ravel()
    least = np.minimum(after[:windows], upto[span - 1 : span - 1 + windows])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    at = (least[first] & ~_HIGH).astype(np.int64)
    return h[at], at, first, np.append(first[1:], windows) - 1


def _anchors(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = search.reader()
        for batch in batches:
            seen = set()
            parts: list[list[np.ndarray]] = [[], [], [], []]
            names: list[bytes] = []
            for sha, body in rows_of(batch):
                if len(body) < search.length or sha in seen:
                    continue
                seen.add(sha)
                text = read(body)
                if len(text) < search.length * search.unit:
                    continue
                found = anchors(text, search.length, search.gram, search.unit)
                for part, values in zip(parts, found, strict=True):
                    part.append(values)
                names += [sha] * found[0].size
                if len(names) > _HELD:
                    yield _anchor_batch(names, parts)
                    names, parts = [], [[], [], [], []]
            if names:
                yield _anchor_batch(names, parts)

    return run


def _anchor_batch(names: list[bytes], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    h, at, first, last = (np.concatenate(part) for part in parts)
    place = (at << 32) | ((at - first) << 16) | (at - last)  # both below length, which is below 2 ** 16
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(names, pa.binary()), pa.array(place)], schema=_ANCHOR)


class _Rows:
    """Rows of blocks on their way out. Equal rows are sent once, and their spans reported at once, unless all are wanted."""

    def __init__(self, every: bool) -> None:
        self.every, self.held = every, []
        self.found: dict[tuple, list] = {}
        self.spans: list[tuple] = []

    def add(self, kind: int, row: tuple, sha: bytes, at: int, begin: int, end: int) -> None:
        """``row`` is key, left and right edge; ``at`` the place of its core, ``begin`` and ``end`` its reach."""
        if self.every:
            self.held.append((kind, *row, sha, at, None))
            return
        mark = self.found.get((kind, *row))
        if mark is None:
            self.found[kind, *row] = [sha, at, begin, end, False]
            return
        if not mark[4]:
            self.spans.append(((kind, mark[0]), mark[2], mark[3]))
            mark[4] = True
        self.spans.append(((kind, sha), begin, end))

    def full(self) -> bool:
        return len(self.found) + len(self.held) > _HELD

    def out(self) -> Iterator[pa.RecordBatch]:
        yield from in_slices(((*row, mark[0], mark[1], None) for row, mark in self.found.items()), _ROW)
        yield from in_slices(iter(self.held), _ROW)
        yield from in_slices(((kind, None, None, None, sha, start, stop) for (kind, sha), start, stop in _merge_spans(self.spans)), _ROW)
        self.__init__(self.every)


def _rows(searches: list[Search], every: bool):
    """Rows of the blocks of repeated anchors, of each search in turn. Places are counted in symbols; keys and edges are bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [search.reader() for search in searches]
        for batch in batches:
            rows, seen = _Rows(every), set()
            for sha, packed, *each in rows_of(batch):
                if sha in seen:
                    continue
                seen.add(sha)
                text = zlib.decompress(packed)
                for kind, (search, places) in enumerate(zip(searches, each, strict=True)):
                    if places:
                        _add_blocks(rows, kind, search, sha, readers[kind](text), places)
                if rows.full():
                    yield from rows.out()
            yield from rows.out()

    return run


def _add_blocks(rows: _Rows, kind: int, search: Search, sha: bytes, body: bytes, places: list[int]) -> None:
    length, _, step, unit = search
    for place in places:
        at = place >> 32
        first, last = at - (place >> 16 & 0xFFFF), at - (place & 0xFFFF)
        for block in range((at - last) // step, (at - first) // step + 1):
            low, high = max(at - last, block * step), min(at - first, block * step + step - 1)
            core0, core1 = at - block * step, at + length - block * step - step + 1
            key = xxhash.xxh3_128_digest(body[core0 * unit : core1 * unit]) + block.to_bytes(2, "little")
            begin, end = at - high, at + length - low
            rows.add(kind, (key, body[begin * unit : core0 * unit], body[core1 * unit : end * unit]), sha, core0, begin, end)


def _halve(search: Search, step: int, every: bool):
    """Rows of blocks of ``step`` as rows of blocks of half that step: longer cores, shorter edges."""
    half, unit, core = step // 2, search.unit, search.length - step + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(every)
            for kind, key, left, right, sha, at in zip(*columns_of(batch), strict=True):
                n = len(left) // unit
                # windows have from low to high symbols of the left edge
                low, high = max(0, step - 1 - len(right) // unit), min(n, step - 1)
                if low < half:
                    top = min(high, half - 1)
                    name = xxhash.xxh3_128_digest(key + b">" + right[: half * unit])
                    rows.add(kind, (name, left[(n - top) * unit :], right[half * unit : (step - 1 - low) * unit]), sha, at, at - top, at + core + step - 1 - low)
                if high >= half:
                    bottom = max(low, half)
                    name = xxhash.xxh3_128_digest(key + b"<" + left[(n - half) * unit :])
                    rows.add(kind, (name, left[(n - high) * unit : (n - half) * unit], right[: (step - 1 - bottom) * unit]), sha, at - half, at - high, at + core + step - 1 - bottom)
            yield from rows.out()

    return run


def _pack_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sha, body compressed), each text of a batch once: a group of copies is merged before the exchange."""
    for batch in batches:
        texts = dict(zip(*columns_of(batch), strict=True))
        yield from _pack([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(texts.values(), pa.binary())], schema=_TEXT)])


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column compressed, as it is to be exchanged; the others as they are."""
    for batch in batches:
        packed = pa.array([zlib.compress(body, 1) for body in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=[*batch.schema.names[:-1], "packed"])


def _merge_spans(spans: list[tuple]) -> list[tuple]:
    out: list[list] = []
    for name, start, stop in sorted(spans):
        if out and out[-1][0] == name and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], stop)
        else:
            out.append([name, start, stop])
    return [tuple(x) for x in out]


class SuffixArray:
    """Enhanced suffix array (order and common prefixes) over non-negative integers, by doubling."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        n = symbols.size
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        ranks = [rank]
        size = 1
        while size < depth:
            after = np.full(n, -1, np.int64)
            after[: n - size] = rank[size:]
            key = rank * (n + 1) + after + 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            ranks.append(rank)
            size *= 2
        self.order = np.argsort(rank, kind="stable")
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        self.common = np.zeros(n, np.int64)  # of the suffix and the one before it
        for level in range(len(ranks) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
            # a rank near the end stands for fewer symbols, but ends are separators that occur once
            self.common[1:][same] += 1 << level
            a, b = a + same * (1 << level), b + same * (1 << level)

    def maximal_repeats(self, before: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, places) of the maximal repeats of at least ``least`` symbols, deepest first.

        ``before`` has the symbol left of each place. The stack holds open intervals
        [length, first, a symbol to the left, whether these symbols differ].
        """
        common = np.append(self.common, 0).tolist()
        order, n = self.order, len(self.order)
        left = before[order].tolist()
        starts = np.flatnonzero(np.diff(np.concatenate([[0], (self.common >= least).astype(np.int8), [0]])) == 1)
        for start in starts.tolist():
            stack: list[list] = []
            for i in range(start, n + 1):
                depth = common[i]
                first, sign, differs = i - 1, left[i - 1], False
                while stack and stack[-1][0] > depth:
                    top = stack.pop()
                    top[3] |= differs or sign != top[2]
                    if top[3]:
                        yield top[0], order[top[1] : i]
                    _, first, sign, differs = top
                if depth < least:
                    break
                if stack and stack[-1][0] == depth:
                    stack[-1][3] |= differs or sign != stack[-1][2]
                else:
                    stack.append([depth, first, sign, differs])


class _Block:
    """The maximal repeats among rows (key, left, right, ...), whose edges and cores are one text of symbols."""

    def __init__(self, rows: list[tuple], step: int, unit: int) -> None:
        keys = {key: i for i, key in enumerate(sorted({row[0] for row in rows}))}
        lefts = np.array([len(row[1]) // unit for row in rows])
        sizes = lefts + np.array([len(row[2]) // unit for row in rows]) + 2
        self.rows, self.step, self.ends = rows, step, np.cumsum(sizes)
        self.core, blank = self.ends - sizes + lefts, b"\0" * unit
        raw = np.frombuffer(b"".join(row[1] + blank + row[2] + blank for row in rows), _NUMBERS[unit])
        if unit > 1:
            raw = np.unique(raw, return_inverse=True)[1]
        self.symbols = raw.astype(np.int64)
        top = int(self.symbols.max()) + 1
        base = top + len(keys)
        self.symbols[self.core] = top + np.array([keys[row[0]] for row in rows])
        self.symbols[self.ends - 1] = base + np.arange(len(rows))  # separators, each once
        self.before = np.concatenate([[base + len(rows)], self.symbols[:-1]])

    def repeats(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Symbols, places and rows of each."""
        for size, places in SuffixArray(self.symbols, 2 * self.step).maximal_repeats(self.before, self.step):
            yield size, places, np.searchsorted(self.ends, places, side="right")


def covered(rows: list[tuple], length: int, step: int, unit: int = 1) -> Iterator[tuple]:
    """Spans of the windows that repeat among rows (key, left, right, sha, at)."""
    block, n = _Block(rows, step, unit), len(rows)
    low, high = np.full(n, 1 << 40), np.full(n, -1)
    for size, places, row in block.repeats():
        np.minimum.at(low, row, places)
        np.maximum.at(high, row, places + size)
    for i in np.flatnonzero(high >= 0).tolist():
        # repeats of one row all hold its core, so together they are one span
        if rows[i][3] is not None:
            start = rows[i][4] - int(block.core[i] - low[i])
            yield rows[i][3], start, rows[i][4] + length - step + int(high[i] - block.core[i])


def occurrences(rows: list[tuple], length: int, step: int, unit: int = 1) -> Iterator[tuple]:
    """(repeat, length, sha, start) of the maximal repeats among rows (key, left, right, sha, at)."""
    block = _Block(rows, step, unit)
    for size, places, row in block.repeats():
        key, left, right, *_ = rows[row[0]]
        before = int(block.core[row[0]] - places[0])  # symbols of it left of the core, and right of it
        after = size - 1 - before
        name = xxhash.xxh3_128_digest(key + before.to_bytes(4, "little") + left[len(left) - before * unit :] + right[: after * unit])
        for i, place in zip(row.tolist(), places.tolist(), strict=True):
            yield name, size + length - step, rows[i][3], rows[i][4] - int(block.core[i] - place)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (key, left, right, sha, at) of one key after another, as their batches are sorted."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*columns_of(batch), strict=True):
            if group and row[0] != group[0][0]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _merged(group: list[tuple], core: int, unit: int, spans: list[tuple]) -> list[tuple]:
    """The rows of a key (sorted by their edges) with different edges; rows of equal ones are repeats, whose spans are added."""
    out: list[tuple] = []
    for row in group:
        if out and out[-1][1:3] == row[1:3]:
            for x in (out[-1], row):
                if x[3] is not None:
                    spans.append((x[3], x[4] - len(x[1]) // unit, x[4] + core + len(x[2]) // unit))
            out[-1] = (*row[:3], None, None)
        else:
            out.append(row)
    return out


def _arrays(search: Search, step: int, work, every: bool, symbols: int = 1 << 18):
    """``work`` (``covered`` or ``occurrences``) over the keys of a task, several together."""
    schema = _REPEAT if every else _SPAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            held, weight = [], 0
            for group in _groups(batches):
                spans: list[tuple] = []
                rows = group if every else _merged(group, search.length - step + 1, search.unit, spans)
                yield from spans
                if len(rows) > 1:
                    held += rows
                    weight += sum(len(x[1]) + len(x[2]) + 2 * search.unit for x in rows) // search.unit
                if weight > symbols:
                    yield from work(held, search.length, step, search.unit)
                    held, weight = [], 0
            if held:
                yield from work(held, search.length, step, search.unit)

        yield from in_slices(found(), schema)

    return run


def _anchored(docs: DataFrame, tables: Tables, search: Search) -> DataFrame:
    """Places of the anchors that occur more than once: sha, places."""
    found = tables.write(docs.mapInArrow(_anchors(search), "h long, sha binary, place long"))
    twice = tables.write(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    each = join_counted(found, twice, "h", "c", hot_limit(docs, found.count()))
    return each.groupBy("sha").agg(F.collect_set("place").alias("places"))


def _places(docs: DataFrame, search: Search) -> DataFrame:
    with Tables(docs.sparkSession) as tables:
        return cut(_anchored(docs, tables, search))


def _blocks(docs: DataFrame, tables: Tables, searches: list[Search], every: bool) -> DataFrame:
    """Rows of the blocks of every search, in one pass over the texts that have any."""
    places = None
    for kind, search in enumerate(searches):
        one = _places(docs, search).withColumnRenamed("places", f"p{kind}")
        places = one if places is None else places.join(one, "sha", "full")
    packed = docs.mapInArrow(_pack_once, "sha binary, packed binary").join(places, "sha")
    return tables.write(packed.select("sha", "packed", *[f"p{kind}" for kind in range(len(searches))]).mapInArrow(_rows(searches, every), _DDL_ROW))


def _shared(rows: DataFrame, tables: Tables) -> DataFrame:
    """The rows whose key others have too, and how many do."""
    loads = tables.write(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumn("n", F.col("c")))
    return tables.write(join_counted(rows, loads, "key", "c", hot_limit(rows, rows.count())))


def _matches(rows: DataFrame, tables: Tables, search: Search, hot: int, every: bool) -> DataFrame:
    """Spans (sha, start, stop) of the repeated strings among rows of blocks, or (``every``) occurrences of the repeats."""
    length, _, step, _ = search
    work, ddl = (occurrences, "repeat binary, length int, sha binary, start int") if every else (covered, "sha binary, start int, stop int")
    found = [] if every else [rows.where("stop is not null").select("sha", F.col("at").alias("start"), "stop")]
    blocks = rows.where("stop is null")
    while True:
        shared = _shared(blocks, tables)
        mild = shared.where(F.col("n") <= hot).select("key", "left", "right", "sha", "at")
        found.append(mild.repartition("key").sortWithinPartitions("key", "left", "right").mapInArrow(_arrays(search, step, work, every), ddl))
        rest = shared.where(F.col("n") > hot)
        if step == 1:
            whole = [F.col("key").alias("repeat"), F.lit(length).alias("length"), "sha", F.col("at").alias("start")]
            found.append(rest.select(*whole) if every else rest.select("sha", F.col("at").alias("start"), (F.col("at") + length).alias("stop")))
            break
        if rest.isEmpty():
            break
        halves = tables.write(rest.select("kind", "key", "left", "right", "sha", "at").mapInArrow(_halve(search, step, every), _DDL_ROW))
        if not every:
            found.append(halves.where("stop is not null").select("sha", F.col("at").alias("start"), "stop"))
        blocks, step = halves.where("stop is null"), step // 2
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def spans_of(docs: DataFrame, searches: list[Search], hot: int = 256) -> list[DataFrame]:
    """Repeated spans (sha, spans) of ``docs`` (sha, body) for each search, in its symbols; one row a text that has any."""
    out = []
    with Tables(docs.sparkSession) as tables:
        rows = _blocks(docs, tables, searches, False)
        tables.release()
        for kind, search in enumerate(searches):
            with Tables(docs.sparkSession) as own:
                every = _matches(rows.where(F.col("kind") == kind), own, search, hot, False)
                out.append(cut(every.groupBy("sha").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))))
    return out


def _neighbours(reach: int):
    """Of texts and their occurrences (name, start, length): what stands left of each (null at a text's start) and ``reach`` bytes right of it."""
    schema = pa.schema([("name", pa.binary()), ("sha", pa.binary()), ("start", pa.int32()), ("length", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for sha, packed, places in zip(*columns_of(batch), strict=True):
                    body = zlib.decompress(packed)
                    for x in places:
                        start, stop = x["start"], x["start"] + x["length"]
                        yield x["name"], sha, start, x["length"], body[start - 1 : start] if start else None, body[stop : stop + reach]

        yield from in_slices(rows(), schema, weigh=lambda row: 80 + len(row[5]))

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to groups (name, n, low, high) how many bytes their first and last continuation share, which is what all share."""
    for batch in batches:
        shared = []
        for low, high in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            n = min(len(low), len(high))
            differ = np.flatnonzero(np.frombuffer(low, np.uint8, n) != np.frombuffer(high, np.uint8, n))
            shared.append(int(differ[0]) if differ.size else n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int32())], names=["name", "n", "shared"])


def _grown(found: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """Occurrences (name, length, sha, start) of the maximal repeats, from groups of strings with all their occurrences.

    The intervals of a block end where its edges do; here they grow as far as they are
    repeats. A round reads what stands right of every occurrence: a group goes on while all
    agree, and where they part it is a repeat of that length and its branches, by the next
    byte, go on by themselves. Groups whose occurrences all have the same byte to their left
    are parts of others and go. Every maximal repeat is reached from the group that begins
    where it does. Rounds follow the number of branches on the way to a repeat, and its length.
    """
    done, reach = [], 1 << 9
    now = found
    while True:
        places = now.groupBy("sha").agg(F.collect_list(F.struct("name", "start", "length")).alias("places"))
        ddl = "name binary, sha binary, start int, length int, before binary, after binary"
        seen = tables.write(texts.join(places, "sha").select("sha", "packed", "places").mapInArrow(_neighbours(reach), ddl))
        groups = seen.groupBy("name").agg(F.count("*").alias("n"), F.min("after").alias("low"), F.max("after").alias("high"), F.min("before").alias("b0"), F.max("before").alias("b1"), F.count("before").alias("bn"))
        # A text's start is unlike anything, another text's start included.
        diverse = groups.where((F.col("n") > 1) & ((F.col("bn") < F.col("n")) | (F.col("b0") != F.col("b1"))))
        sized = tables.write(diverse.select("name", "n", "low", "high").mapInArrow(_common, "name binary, n long, shared int").withColumn("rows", F.col("n")))
        if sized.isEmpty():
            break
        each = tables.write(join_counted(seen, sized, "name", "rows", hot_limit(seen, seen.count())))
        on = F.col("shared") == reach
        length = F.col("length") + F.col("shared")
        done.append(each.where(~on).select("name", length.alias("length"), "sha", "start"))
        branch = F.substring(F.unhex(F.sha2(F.concat("name", F.encode(length.cast("string"), "UTF-8"), F.substr("after", F.col("shared") + 1, F.lit(1))), 256)), 1, 16)
        parted = each.where(~on & (F.length("after") > F.col("shared"))).select(branch.alias("name"), "sha", "start", (length + 1).alias("length"))
        now = tables.write(each.where(on).select("name", "sha", "start", length.alias("length")).unionByName(parted))
        reach = min(4 * reach, 1 << 16)
    out = found.select("name", "length", "sha", "start").limit(0)
    for one in done:
        out = out.unionByName(one)
    # Groups of one string, from beginnings of several lengths, have one first occurrence.
    first = tables.write(out.groupBy("name", "length").agg(F.min(F.struct("sha", "start")).alias("first"), F.count("*").alias("n")))
    once = tables.write(first.groupBy("first", "length").agg(F.min("name").alias("name"), F.first("n").alias("n")).withColumn("name_length", F.concat("name", F.encode(F.col("length").cast("string"), "UTF-8"))).select("name_length", "n"))
    return join_counted(out.withColumn("name_length", F.concat("name", F.encode(F.col("length").cast("string"), "UTF-8"))), once, "name_length", "n", hot_limit(out, first.count()))


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", search: Search | None = None, hot: int = 256) -> DataFrame:
    """The maximal repeats of at least ``length`` bytes, one row an occurrence: repeat (a name), length, doc_id, start.

    A repeat is maximal if its occurrences differ in the byte to the left and in that to the
    right, or end with a text; all of them are listed, so a group of any size is so many rows and no array. Neither
    ``hot`` nor the blocks have an effect on the result. A text that several rows have is
    listed for each of them, and is a repeat as a whole. Bytes only.
    """
    search = search or of_bytes()
    if search.unit != 1:
        raise ValueError("repeats are of bytes")
    docs = _bodies(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")), "_text")
    copies = docs.groupBy("sha").agg(F.count("*").alias("c"), F.first(F.length("body")).alias("length")).where((F.col("c") > 1) & (F.col("length") >= search.length))
    with Tables(df.sparkSession) as tables:
        texts = docs.select("sha", "body").dropDuplicates(["sha"])
        rows = _blocks(texts, tables, [search], True)
        found = tables.write(_matches(rows, tables, search, hot, True).withColumnRenamed("repeat", "name").dropDuplicates(["name", "sha", "start"]))
        packed = tables.write(texts.mapInArrow(_pack_once, "sha binary, packed binary"))
        grown = tables.write(_grown(found, packed, tables).select("name", "length", "sha", "start"))
        whole = copies.join(grown.where("start = 0").select("sha", "length"), ["sha", "length"], "left_anti")
        every = grown.unionByName(whole.select(F.col("sha").alias("name"), "length", "sha", F.lit(0).alias("start")))
        name = F.substring(F.unhex(F.sha2(F.concat("name", F.encode(F.col("length").cast("string"), "UTF-8")), 256)), 1, 16)
        every = cut(every.select(name.alias("repeat"), "length", "sha", "start"))
    return every.join(docs.select("sha", "doc_id"), "sha").select("repeat", "length", "doc_id", "start")


def _bodies(df: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.withColumn("body", body).withColumn("sha", F.substring(F.unhex(F.sha2(body, 256)), 1, 16))


def joined(spans: list, size: int, whole: bool, length: int) -> list[list[int]]:
    """Maximal removed runs of a text of ``size`` bytes (or words)."""
    if whole and size >= length:
        return [[0, size]]
    return [[start, stop] for _, start, stop in _merge_spans([(0, x["start"], x["stop"]) for x in spans or []])]


def with_passages(runs: list[list[int]], body: bytes, passages: list | None, whole: bool, words: int) -> list[list[int]]:
    """``runs`` and the repeated passages of words, whose spans are numbers of words."""
    if not passages and not whole:
        return runs
    places = [match.span() for match in _WORD.finditer(body)]
    if whole and len(places) >= words:
        return [[0, len(body)]]
    found = [(0, *run) for run in runs]
    found += [(0, places[start][0], places[stop - 1][1]) for start, stop in joined(passages, len(places), False, words)]
    return [[start, stop] for _, start, stop in _merge_spans(found)]


def _digests(length: int, words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc, packed, copies, spans, passages in zip(*columns_of(batch), strict=True):
                    body, whole = zlib.decompress(packed), (copies or 0) > 1
                    runs, at, kept = joined(spans, len(body), whole, length), 0, hashlib.sha256()
                    for start, stop in runs:
                        kept.update(body[at:start])
                        at = stop
                    kept.update(body[at:])
                    n = len(joined(passages, len(body.split()) if whole else 0, whole, words))
                    yield doc, len(body), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), n

        yield from in_slices(rows(), schema)

    return run


def with_spans(df: DataFrame, text: str, length: int = 400, words: int = 51, hot: int = 256) -> DataFrame:
    """The first column of ``df``, then packed (the compressed text), copies (null: one), spans and passages (null: none).

    ``spans`` are of bytes, ``passages`` of words. The result reads ``df`` and marks that are checkpoints.
    """
    docs = _bodies(df, text)
    spans, passages = spans_of(docs.select("sha", "body"), [of_bytes(length), of_words(words)], hot)
    copies = docs.groupBy("sha").agg(F.count("*").alias("copies")).where("copies > 1")
    marks = cut(spans.join(copies, "sha", "full").join(passages.withColumnRenamed("spans", "passages"), "sha", "full"))
    first = df.columns[0]
    packed = docs.select(first, "sha", "body").mapInArrow(_pack, f"{first} {df.schema[first].dataType.simpleString()}, sha binary, packed binary")
    marks = marks.withColumn("n", F.coalesce("copies", F.lit(1)))
    return left_join_salted(packed, marks, "sha", "n", hot_limit(df, df.count()), [first]).select(first, "packed", "copies", "spans", "passages")


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, words: int = 51, hot: int = 256) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages.

    The first five are of strings of ``length`` bytes; n_passages counts the maximal runs of
    words all in passages of ``words`` words that are found elsewhere, which go with ``strip``.
    """
    rows = with_spans(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")), "_text", length, words, hot)
    return rows.mapInArrow(_digests(length, words), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")


def _whole_characters(body: bytes, start: int, stop: int) -> tuple[int, int]:
    """The largest run inside that cuts no UTF-8 character."""
    while start < stop and body[start] & 0xC0 == 0x80:
        start += 1
    while stop > start and stop < len(body) and body[stop] & 0xC0 == 0x80:
        stop -= 1
    return start, stop


def _strip(length: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for packed, copies, spans, passages in zip(*(column.to_pylist() for column in batch.columns[1:]), strict=True):
                body, kept, at = zlib.decompress(packed), [], 0
                whole = (copies or 0) > 1
                runs = joined(spans, len(body), whole, length)
                for start, stop in with_passages(runs, body, passages, whole, words):
                    start, stop = _whole_characters(body, start, stop)
                    kept.append(body[at:start])
                    at = stop
                texts.append((b"".join(kept) + body[at:]).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "rest"])

    return run


def strip(df: DataFrame, text: str = "text", length: int = 400, words: int = 51, hot: int = 256) -> DataFrame:
    """The rows of ``df`` with the removed bytes gone from ``text``, whole characters only.

    Passages of ``words`` words that are found anywhere else go as well.
    A column n_chars gets the new length. Rows of which nothing but white space is left,
    though there was more, go; null texts stay null.
    """
    space = F.lit(" \t\n\x0b\x0c\r")
    others = [F.col(f"`{name}`") for name in df.columns if name != text]
    packed = df.select(F.struct(*others, F.col(text).isNull().alias("_none"), (F.trim(F.coalesce(F.col(text), F.lit("")), space) == "").alias("_blank")).alias("row"), F.col(text).alias("_text"))
    rows = with_spans(packed, "_text", length, words, hot)
    out = rows.mapInArrow(_strip(length, words), f"row {packed.schema['row'].dataType.simpleString()}, rest string")
    none = F.col("row._none")
    out = out.where(none | F.col("row._blank") | (F.trim(F.col("rest"), space) != ""))
    value = {text: F.when(~none, F.col("rest"))}
    if "n_chars" in df.columns:
        value["n_chars"] = F.when(none, F.col("row.n_chars")).otherwise(F.length("rest").cast("long"))
    return out.select(*[(value[name] if name in value else F.col(f"row.`{name}`")).alias(name) for name in df.columns])
