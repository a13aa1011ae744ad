"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

The pattern splits a text; every piece is merged on its own. Leaves of the tree are the
byte positions, and each holds the rank of the pair that starts there; an inner node
holds the leftmost smallest rank below it. A merge removes the right part's leaf and
updates its own and its left neighbour's leaf, each in logarithmic time.

Defined results: a null text is an empty text with no ids; special tokens are ordinary
text; very long pieces take n log n steps; pieces already merged are remembered in a
bounded table of each Python worker. Repeated rows give repeated results; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, in_slices

#: Fixed value: the split pattern whose matches never cross a single space.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE, _POSITION = 1 << 62, (1 << 32) - 1
#: Pieces a worker remembers, and the longest it remembers.
_REMEMBERED, _LONGEST = 500_000, 64
#: Characters of text that are split together.
_TOGETHER = 4 << 20
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.binary())])


def read_ranks(path: str) -> bytes:
    """The rank file as it is; it is read on the driver and sent to the workers (about 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


def rank_tree(keys: list[int]) -> tuple[list[int], int]:
    """Leaves ``keys`` from the returned offset on; every inner node is the smaller of its two children.

    A key is a rank and a position in one integer, so the smallest key is the leftmost smallest rank.
    """
    size = 1 << (len(keys) - 1).bit_length()
    best = [_NONE] * size + keys + [_NONE] * (size - len(keys))
    for i in range(size - 1, 0, -1):
        left, right = best[2 * i], best[2 * i + 1]
        best[i] = left if left < right else right
    return best, size


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.at_spaces = pattern == SPACED
        single = np.full(256, -1, np.int64)
        single[[token[0] for token in self.ranks if len(token) == 1]] = [rank for token, rank in self.ranks.items() if len(token) == 1]
        self.single = single
        pairs = sorted((left << 32 | right, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None)
        self.pairs, self.made = np.array([x[0] for x in pairs] + [1 << 62]), np.array([x[1] for x in pairs] + [0])

    def _keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tree keys of the pairs (left, right) that start at ``at``; -1 stands for no token."""
        pair = left << 32 | right
        i = np.searchsorted(self.pairs, pair)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[i] == pair), self.made[i] << 32 | at, _NONE)

    def merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids of many short pieces at once: one segment tree of ``size`` leaves a column, merged in step."""
        m = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(m, size).T
        token = np.full((size + 2, m), -1, np.int64)
        token[:size] = np.where(np.arange(size)[:, None] < length, self.single[raw], -1)
        after = np.arange(1, size + 2)[:, None].repeat(m, 1)
        before = np.arange(-1, size + 1)[:, None].repeat(m, 1)
        best = np.empty((2 * size, m), np.int64)
        best[size:] = self._keys(token[:size], token[1 : size + 1], np.arange(size)[:, None])
        for i in range(size - 1, 0, -1):
            np.minimum(best[2 * i], best[2 * i + 1], out=best[i])
        column = np.arange(m)
        while (column := column[best[1, column] < _NONE]).size:
            at, rank = best[1, column] & _POSITION, best[1, column] >> 32
            right = after[at, column]
            stop = after[right, column]
            left = before[at, column]
            after[at, column], before[stop, column] = stop, at
            token[at, column], token[right, column] = rank, -1
            changed = ((right, np.full(at.size, _NONE)), (at, self._keys(rank, token[stop, column], at)), (np.maximum(left, 0), np.where(left >= 0, self._keys(token[left, column], rank, left), self._keys(rank, token[stop, column], at))))
            for place, key in changed:
                best[place + size, column] = key
            for place, _ in changed:
                i = place + size >> 1
                while i[0]:
                    best[i, column] = np.minimum(best[2 * i, column], best[2 * i + 1, column])
                    i = i >> 1
        rows = token[:size].T
        alive = rows >= 0
        ids, ends = rows[alive].astype("<u4").tobytes(), np.cumsum(alive.sum(1)) * 4
        return [ids[start:end] for start, end in zip([0, *ends.tolist()], ends.tolist())]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        get = ranks.get
        best, size = rank_tree([_NONE if (rank := get(piece[i : i + 2])) is None else rank << 32 | i for i in range(n - 1)])
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n))
        while (key := best[1]) < _NONE:
            at = key & _POSITION
            right = end[at]
            stop = end[at] = end[right]
            left = before[at]
            before[stop] = at
            # the pairs that change: of the part that went, of the merged part, of its left neighbour
            for start, upto in ((right, 0), (at, end[stop] if stop < n else 0), (left, stop if left >= 0 else 0)):
                if upto:
                    key = _NONE if (rank := get(piece[start:upto])) is None else rank << 32 | start
                elif 0 <= start < n - 1:
                    key = _NONE
                else:
                    continue
                i = start + size
                if best[i] == key:
                    continue
                best[i] = key
                while i > 1:
                    other = best[i ^ 1]
                    if other < key:
                        key = other
                    i >>= 1
                    if best[i] == key:
                        break
                    best[i] = key
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't remembered; the short ones are merged together and remembered."""
        by_size: dict[int, list[str]] = {}
        out = {}
        for piece in pieces:
            body = piece.encode("utf-8")
            n = len(body)
            if n > _LONGEST:
                out[piece] = np.array(self.merge(body), dtype="<u4").tobytes()
            elif (whole := self.ranks.get(body)) is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            else:
                by_size.setdefault(max(8, 1 << (n - 1).bit_length()), []).append(piece)
        for size, group in by_size.items():
            for start in range(0, len(group), 20_000):
                some = group[start : start + 20_000]
                self.known.update(zip(some, self.merge_many([x.encode("utf-8") for x in some], size), strict=True))
        return out

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, split by the pattern."""
        split = [self.split(text) for text in texts]
        there = set().union(*split)
        new = there.difference(self.known)
        if len(self.known) + len(new) > _REMEMBERED:
            self.known.clear()
            new = there
        known, long = self.known, self._learn(new)
        if long:
            return [b"".join([known[x] if x in known else long[x] for x in pieces]) for pieces in split]
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Where ``at_spaces`` holds, no match crosses a single space between other characters,
        so words between such spaces are looked up whole; texts with other spacing are split
        by the pattern alone.
        """
        if not self.at_spaces:
            return self._pieces(texts)
        cut = [text.split(" ") for text in texts]
        there = set().union(*cut)
        new = there.difference(self.words)
        if len(self.words) + len(new) > _REMEMBERED:
            self.words.clear()
            new = there
        words = self.words
        odd = {x for x in new if not x or len(x) > 2 * _LONGEST or x[0].isspace() or x[-1].isspace()}
        new = [x for x in new if x not in odd]
        for start in range(0, len(new), 20_000):
            some = new[start : start + 20_000]
            words.update(zip(some, self._pieces([" " + x for x in some]), strict=True))
        first = self._pieces([x[0] for x in cut])
        out = []
        for text, start, rest in zip(texts, first, cut, strict=True):
            try:
                out.append(start + b"".join(map(words.__getitem__, rest[1:])) if rest[0] and not rest[0][-1].isspace() else None)
            except KeyError:
                out.append(None)
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(left, self._pieces([texts[i] for i in left]), strict=True):
            out[i] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_MADE: dict[tuple, ByteBPE] = {}


def _coder(rank_file: bytes, pattern: str) -> ByteBPE:
    """One coder a Python worker and rank file."""
    key = hashlib.sha256(rank_file).digest(), pattern
    if key not in _MADE:
        _MADE[key] = ByteBPE(rank_file, pattern)
    return _MADE[key]


def _over(sent, pattern: str, row, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value, pattern)

        def rows():
            for batch in batches:
                docs, texts = columns_of(batch)
                start = 0
                while start < len(docs):
                    stop, weight = start, 0
                    while stop < len(docs) and (stop == start or weight < _TOGETHER):
                        weight += len(texts[stop] or "")
                        stop += 1
                    for doc, ids in zip(docs[start:stop], coder.encode_many([x or "" for x in texts[start:stop]]), strict=True):
                        yield row(doc, ids, coder.decode(ids))
                    start = stop

        yield from in_slices(rows(), schema, weigh=lambda x: 100 if len(x) > 3 else 9 * len(x[1]))

    return run


def _digest(doc, ids: bytes, decoded: bytes) -> tuple:
    return doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _whole(doc, ids: bytes, decoded: bytes) -> tuple:
    return doc, np.frombuffer(ids, dtype="<u4").tolist(), decoded


def _run(df: DataFrame, rank_path: str, pattern: str, doc_id: str, text: str, row, schema: pa.Schema, ddl: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_over(sent, pattern, row, schema), ddl)


def encode(df: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, ids, decoded): the ids of every text, and the bytes that they decode to."""
    return _run(df, rank_path, pattern, doc_id, text, _whole, _IDS, "doc_id long, ids array<long>, decoded binary")


def digests(df: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of the same encoding and decoding."""
    return _run(df, rank_path, pattern, doc_id, text, _digest, _OUT, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
