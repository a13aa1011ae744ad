r"""Periodic runs of words, after Ellert and Fischer: Lyndon arrays over an ordered alphabet.

A run is a stretch of words with smallest period q, at least 2q long, that no neighbouring
word extends. Words are compared with < and = and nothing else: no ranks, hashes, suffix
array or tree. For each of the two orders of words (ascending, descending), the longest
Lyndon word at i ends where the next smaller suffix begins, and every run has a Lyndon root
among these, for one order at least. So for each edge (i, j), j the next smaller suffix of i,
the longest common extension to the right of i and j and to the left of them tells the run
of period j - i.

Both extensions reuse what has been matched. Positions are handled from left to right with a
stack of suffixes that have no smaller one yet; while i lies in a stretch known to equal one
``shift`` words before, a comparison of i with j copies the result of i - shift with
j - shift, and only a result that reaches the end of the stretch is carried on, from there. When a suffix
leaves the stack, the next one shares min(a, b) words with i where a and b are known and
differ, and starts at a where they are equal. Extensions to the left do the same from right to left and stop
at a period, as the leftmost root of a run starts within one. Matched words are thus
not compared again, and the work follows the number of words.

Spark gives every document to one task, in Arrow batches; the memory of a task is that of a
batch and of the words of one document.

Defined results: a null text has no words; a null doc_id is a document like any other
(nothing is planted in it); repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored. Runs end at a document's ends. Very long texts are
handled whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import repeat
from operator import gt, lt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, in_slices

_RUN = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)
_DIGEST_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon_edges(w: list, less=lt) -> tuple[list[int], list[int]]:
    """For each i the next smaller suffix (len(w) if none) and how many words the two share.

    ``less`` is the order of two words; the end of the text is smaller than any word.
    """
    n = len(w)
    up, up_same = [-1] * n, [0] * n  # the previous smaller suffix and what it shares
    down, down_same = [n] * n, [0] * n
    end = shift = 0  # w[x] == w[x - shift] up to ``end``, for all x from where it was matched
    begin = n
    for i in range(1, n):
        c = w[i]
        j = i - 1
        same = above = 0  # ``same``: what i shares with the suffix that left the stack last; ``above``: what that one shares with j
        first = True
        while j >= 0:
            b = w[j]
            if b != c:
                same = 0
                smaller = less(c, b)
            else:
                exact = False
                if i < end and j >= begin:  # both lie in the matched stretch: as it was one shift before
                    k, m = i - shift, j - shift
                    known = down_same[m] if down[m] == k else up_same[k] if up[k] == m else -1
                    if known >= 0:
                        exact = known < end - i
                        same = known if exact else end - i
                    elif first or same != above:
                        same, exact = (1, False) if first else (min(same, above), True)
                elif first:
                    same = 1
                elif same != above:
                    same, exact = min(same, above), True
                if not exact:
                    same = same or 1
                    x, y = i + same, j + same
                    while x < n and w[x] == w[y]:
                        x += 1
                        y += 1
                    same = x - i
                    if x > end:
                        end, shift, begin = x, i - j, i
                smaller = i + same == n or less(w[i + same], w[j + same])
            if not smaller:
                up[i], up_same[i] = j, same
                break
            down[j], down_same[j] = i, same
            above = up_same[j]
            j = up[j]
            first = False
    return down, down_same


def _left(w: list, down: list[int], down_same: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, period, words before i that repeat after the period) of edges that share words, as far as fewer than a period."""
    n = len(w)
    known = [-1] * n
    begin, end, shift = n, 0, 0  # w[x] == w[x + shift] from ``begin``, up to where it was matched
    for i in range(n - 1, -1, -1):
        if not down_same[i]:
            continue
        j = down[i]
        p = j - i
        x = i
        if i > begin and j <= end and down[i + shift] == j + shift and known[i + shift] >= 0:
            seen = known[i + shift]
            if seen < i - begin:
                known[i] = seen
                if seen < p:
                    yield i, p, seen
                continue
            x = begin
        stop = max(0, i - p)
        while x > stop and w[x - 1] == w[x - 1 + p]:
            x -= 1
        known[i] = i - x
        if x < begin:
            begin, end, shift = x, i, p
        if i - x < p:
            yield i, p, i - x


def find_runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words, by start, then period."""
    out = []
    n = len(w)
    for less in (lt, gt):
        down, down_same = lyndon_edges(w, less)
        if any(down_same):
            for i, p, before in _left(w, down, down_same):
                end = i + p + down_same[i]
                length = end - i + before
                # A run that ends with the text has a root in both orders.
                if length >= 2 * p and length >= least and (less is lt or end < n):
                    out.append((i - before, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that any run has after its first period."""
    out, at = [], 0
    for start, stop in sorted((start + period, start + length) for start, length, period in found):
        if start > at:
            out += w[at:start]
        at = max(at, stop)
    return out + w[at:]


def planted(w: list, doc_id: int | None) -> list:
    """The words of the contract: of one document in ten, by the CRC of its id, the tail repeats with a period."""
    if doc_id is None or not w:
        return w
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return w
    n = len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = w[a : a + p]
    return w[:a] + (unit * ((n - a) // p + 1))[: n - a]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[bytes]]]:
    for batch in batches:
        for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield doc_id, (body.as_py() or b"").split()


def _run_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    rows = ((doc_id, *run) for doc_id, w in _words(batches) for run in find_runs(w, least))
    yield from in_slices(rows, _RUN)


def _digest_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    def rows():
        for doc_id, w in _words(batches):
            w = planted(w, doc_id)
            found = find_runs(w, least)
            longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
            most = (*longest, 1000 * longest[1] // longest[2]) if longest else repeat(None, 4)
            listed = "".join(f"{start},{length},{period}\n" for start, length, period in found)
            yield doc_id, len(found), *most, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(w, found))).hexdigest()

    yield from in_slices(rows(), _DIGEST)


def _bodies(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))


def runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """One row a run of at least ``least`` words: doc_id, start (word number), length, period (words)."""
    return _bodies(df, doc_id, text).mapInArrow(lambda batches: _run_rows(batches, least), "doc_id long, start long, length long, period long")


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """One row a document, with the contract's planted tails: number of runs, the longest one, digests of all and of the kept words."""
    return _bodies(df, doc_id, text).mapInArrow(lambda batches: _digest_rows(batches, least), _DIGEST_DDL)
