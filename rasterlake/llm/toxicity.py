"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters and digits, each lower-cased by itself, so that the offsets of
spans are characters of the text as it is; their features are the word, its
first three to six characters and its last three. The labelled tokens come from the
labelled documents: a feature that hardly any documents but toxic ones have, and that more
of these have than chance explains at the sample's share of toxic documents (see
``markers``), makes a token of a toxic document toxic. The field
has the states clean and toxic, hashed feature weights and transition weights, fitted by
gradient ascent on the likelihood of whole documents. Forward-backward over a batch of
documents at once gives each token's marginal; a document's score is its largest
marginal, and the tokens above ``mark`` are its spans.

The model is fitted on at most ``rows`` labelled documents (a bounded sample, see
``labelled_sample``), and the field on all toxic documents of these and as many others, of
which no more than ``most_tokens`` tokens reach the driver (documents by their hash; one that
doesn't fit is left out). Every document is scored over its whole text.

Defined results: a null text, or one without a token, has score 0 and no span; without
labelled rows or toxic tokens every score is 0; repeated rows score the same; other
columns are ignored; an empty table gives no rows; very long texts are one chain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, cut, in_slices, labelled_sample

BUCKETS = 1 << 20
#: Features of a word.
PER_WORD = 6
_TOKEN = re.compile(r"[^\W_]+")
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def tokens(text: str) -> list[str]:
    return [word.lower() for word in _TOKEN.findall(text)]


def features(word: str) -> list[int]:
    """Hashed features of a word."""
    names = ["w" + word, "s" + word[-3:]] + [f"{n}{word[:n]}" for n in (3, 4, 5, 6)]
    return [xxhash.xxh3_64_intdigest(name) % BUCKETS for name in names]


class _Features(dict):
    def __missing__(self, word: str) -> list[int]:
        if len(self) > 150_000:
            self.clear()
        found = self[word] = features(word)
        return found


class _Weights(dict):
    """Emission weight of the toxic state by word."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = float(sum(self.weights[i] for i in features(word)))
        return found


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, sizes, known = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64), _Features()
    for batch in batches:
        for text, label in zip(*columns_of(batch), strict=True):
            sizes[label] += 1
            there = {i for word in set(tokens(text)) for i in known[word]}
            counts[label, np.fromiter(there, np.int64, len(there))] += 1
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (counts, sizes)], names=["counts", "sizes"])


def markers(counts: np.ndarray, sizes: np.ndarray, purity: float = 0.95) -> np.ndarray:
    """Which features mark toxic tokens, by the documents (others, toxic) that have them.

    The likelihood ratio of a feature compares the toxic share of its documents, smoothed by one
    document of the base rate, with the base rate. Chance alone reaches a ratio r in about one of r
    tests, so r has to exceed the number of tests among features that are in as many documents; the
    features of a word stand or fall together and are one test.
    """
    base = (sizes[1] + 0.5) / (sizes.sum() + 1)
    both = counts.sum(0)
    share = (counts[1] + base) / (both + 1)
    ratio = counts[1] * np.log(share / base) + counts[0] * np.log((1 - share) / (1 - base))
    as_many = np.cumsum(np.bincount(both)[::-1])[::-1]  # features in at least so many documents
    return (both > 0) & (share > base) & (counts[1] >= purity * both) & (ratio >= np.log(as_many[both] / PER_WORD))


def _chains(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, known = sent.value, _Features()
        for batch in batches:
            hashes, sizes, xs, ys = [], [], [], []
            for text, label in zip(*columns_of(batch), strict=True):
                x = np.array([known[word] for word in tokens(text)], np.int32).reshape(-1, PER_WORD)
                hashes.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
                sizes.append(len(x))
                xs.append(x.tobytes())
                ys.append((marked[x].any(1) & bool(label)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["hash", "n", "x", "y"])

    return run


def forward_backward(emission: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the toxic state, expected moves (2 x 2) and log partition of many chains.

    ``emission`` is the toxic state's score of each token of all chains in a row, ``first``
    marks the tokens that begin a chain. A chain's beginning forgets what was before it, so
    the row is one chain; it is cut into columns that are scanned together, first for the
    transfer matrix of each column, then with the right beginning.
    """
    n = emission.size
    width = max(1, int(np.sqrt(n)))
    height = -(-n // width)
    pad = width * height - n
    e = np.concatenate([emission, np.zeros(pad)]).reshape(width, height).T  # a column is a stretch of the row
    f = np.concatenate([first, np.ones(pad, bool)]).reshape(width, height).T
    step = np.exp(moves)
    begin = np.exp(start)[None, :].repeat(2, 0)
    weight = np.ones((height, width, 2))
    weight[..., 1] = np.exp(np.clip(e, -50, 50))
    move = np.where(f[..., None, None], begin, step)  # from, to

    def scan(state: np.ndarray, back: bool, keep: np.ndarray | None, logs: list | None) -> np.ndarray:
        for t in range(height - 1, -1, -1) if back else range(height):
            if back:
                if keep is not None:
                    keep[t] = state
                state = np.einsum("wij,wj,w...j->w...i", move[t], weight[t], state)
            else:
                state = np.einsum("w...i,wij,wj->w...j", state, move[t], weight[t])
            total = state.reshape(width, -1).sum(1)
            state = state / total.reshape(-1, *[1] * (state.ndim - 1))
            if keep is not None and not back:
                keep[t] = state
            if logs is not None:
                logs.append(np.log(total))
        return state

    eye = np.eye(2)[None].repeat(width, 0)
    ahead, behind = scan(eye, False, None, None), scan(eye, True, None, None)
    enter, leave = np.empty((width, 2)), np.empty((width, 2))
    state = np.array([0.5, 0.5])
    for w in range(width):
        enter[w] = state
        state = state @ ahead[w]
        state /= state.sum()
    state = np.array([0.5, 0.5])
    for w in range(width - 1, -1, -1):
        leave[w] = state
        state = state @ behind[w]
        state /= state.sum()
    alpha, beta, logs = np.empty((height, width, 2)), np.empty((height, width, 2)), []
    scan(enter, False, alpha, logs)
    scan(leave, True, beta, None)
    both = alpha * beta
    marginal = (both[..., 1] / both.sum(-1)).T.ravel()[:n]
    a, b = alpha.transpose(1, 0, 2).reshape(-1, 2)[:n], (beta * weight).transpose(1, 0, 2).reshape(-1, 2)[:n]
    pair = a[:-1, :, None] * step * b[1:, None, :]
    pair = (pair / pair.sum((1, 2), keepdims=True))[~first[1:]].sum(0) if n > 1 else np.zeros((2, 2))
    used = np.array(logs).T.ravel()[:n].sum() if n else 0.0
    return marginal, pair, float(used)


def train_field(x: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = 30, rate: float = 0.3, ridge: float = 0.02) -> dict:
    """Weights of the field by Adam over all chains; the likelihood is of whole chains."""
    used, inverse = np.unique(x, return_inverse=True)
    inverse = inverse.reshape(x.shape)
    p = [np.zeros(used.size), np.zeros((2, 2)), np.zeros(2), np.array([-3.0])]
    m, v = [0 * a for a in p], [0 * a for a in p]
    inner = ~first[1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
    starts = np.bincount(y[first].astype(int), minlength=2)
    scale = 1 / max(1.0, float(y.sum()))
    for step in range(1, steps + 1):
        q, pair, _ = forward_backward(p[0][inverse].sum(1) + p[3][0], first, p[1], p[2])
        error = q - y
        each = np.bincount(inverse.ravel(), weights=np.repeat(error, x.shape[1]), minlength=used.size)
        begun = np.array([(1 - q[first]).sum(), q[first].sum()])
        grads = [each * scale + ridge * scale * p[0], (pair - seen) * scale, (begun - starts) * scale, np.array([error.sum() * scale])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return {"used": used, "weights": p[0], "moves": p[1], "start": p[2], "bias": float(p[3][0])}


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 10000, others: int = 300, purity: float = 0.95, most_tokens: int = 300_000) -> dict | None:
    """The field, or None without anything toxic to learn."""
    sample = labelled_sample(docs, labels, label, rows).coalesce(6)
    counts, sizes = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for row in sample.mapInArrow(_document_counts, "counts binary, sizes binary").toLocalIterator():
        counts += np.frombuffer(row.counts, np.int32).reshape(2, BUCKETS)
        sizes += np.frombuffer(row.sizes, np.int64)
    marked = markers(counts, sizes, purity)
    if not marked.any():
        return None
    sent = docs.sparkSession.sparkContext.broadcast(marked)
    some = sample.where("label = 0").orderBy(F.xxhash64("text")).limit(max(others, int(sizes[1])))
    few = sample.where("label = 1").unionByName(some).coalesce(4)
    chains = cut(few.mapInArrow(_chains(sent), "hash long, n long, x binary, y binary").where("n > 0"))
    total, taken = 0, []
    for row in chains.groupBy("hash").agg(F.sum("n").alias("n")).orderBy("hash").collect():  # numbers of at most 2 * rows texts
        if total + row.n <= most_tokens:
            total += row.n
            taken.append((row.hash,))
    if not taken:
        return None
    found = chains.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "hash long")), "hash").select("x", "y").toPandas()
    pairs = sorted((bytes(x), bytes(y)) for x, y in zip(found["x"], found["y"], strict=True))
    x = np.concatenate([np.frombuffer(a, np.int32).reshape(-1, PER_WORD) for a, _ in pairs])
    y = np.concatenate([np.frombuffer(b, np.uint8) for _, b in pairs]).astype(np.float64)
    first = np.zeros(y.size, bool)
    first[np.cumsum([0] + [len(b) for _, b in pairs[:-1]])] = True
    field = train_field(x, y, first)
    weights = np.zeros(BUCKETS, np.float32)
    weights[field["used"]] = field["weights"]
    return {"weights": weights, "moves": field["moves"], "start": field["start"], "bias": field["bias"]}


def spans_in(text: str, marginals: np.ndarray, mark: float) -> list[dict]:
    """Offsets (in characters of the text) of runs of tokens above ``mark``."""
    out: list[dict] = []
    open_ = False
    for match, p in zip(_TOKEN.finditer(text), marginals.tolist(), strict=True):
        if p >= mark and open_:
            out[-1]["stop"] = match.end()
        elif p >= mark:
            out.append({"start": match.start(), "stop": match.end()})
        open_ = p >= mark
    return out


def _scores(sent, mark: float, together: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        weights = _Weights(model["weights"]) if model else None

        def done(held):
            e = np.concatenate([h[2] for h in held]) + model["bias"]
            starts = np.cumsum([0] + [h[2].size for h in held])
            first = np.zeros(e.size, bool)
            first[starts[:-1][np.diff(starts) > 0]] = True
            q = forward_backward(e, first, model["moves"], model["start"])[0] if e.size else e
            for (doc, text, own), start in zip(held, starts.tolist(), strict=False):
                part = q[start : start + own.size]
                best = float(part.max()) if part.size else 0.0
                yield doc, min(1.0, max(0.0, best)), spans_in(text, part, mark) if best >= mark else []

        def made():
            held, size = [], 0
            for batch in batches:
                for doc, text in zip(*columns_of(batch), strict=True):
                    if model is None:
                        yield doc, 0.0, []
                        continue
                    words = tokens(text or "")
                    held.append((doc, text or "", np.fromiter(map(weights.__getitem__, words), np.float64, len(words))))
                    size += len(words)
                    if size >= together:
                        yield from done(held)
                        held, size = [], 0
            if held:
                yield from done(held)

        yield from in_slices(made(), _OUT)

    return run


def score(docs: DataFrame, model: dict | None, mark: float = 0.5) -> DataFrame:
    """One row per document: doc_id, score, spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scores(sent, mark), "doc_id long, score double, spans array<struct<start:int,stop:int>>")
