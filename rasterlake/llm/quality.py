"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word bucket has a sparse random index vector of -1, 0 and 1. A word's shape (its characters as classes, runs as one)
has a bucket too, with the shapes around it as context. The vector of a word
is the sum of the index vectors of the words within ``window`` places of it over the
sample, scaled to length one, plus its own index vector. A document is the mean and the
deviation of its words' vectors, the mean of its shapes' vectors, the mean cosine of
adjacent words and the logarithm of its number of words. A network of
one hidden layer gives a logit; a temperature fitted on a fifth of the sample that the
network doesn't learn from calibrates the probability.

The model is fitted on at most ``rows`` labelled documents (a bounded sample, see
``labelled_sample``); what reaches the driver is bounded by it. Every document is
scored over its whole text.

Defined results: a null or empty text has the features of no words and gets a score as
any other; without labelled rows, or with one class only, the score is the share of
label 1 (0.5 without rows); repeated rows score the same; other columns are ignored; an empty table
gives no rows; very long texts and words are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, in_slices, labelled_sample

WORDS, SHAPES, SIZE, NONZERO = 8192, 512, 48, 6
BUCKETS = WORDS + SHAPES
_SHAPE = str.maketrans({**{chr(c): "A" for c in range(0x250) if chr(c).isupper()}, **{chr(c): "a" for c in range(0x250) if chr(c).islower()}, **{str(d): "0" for d in range(10)}})
_RUN = re.compile(r"(.)\1+")
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        shape = _RUN.sub(r"\1", word.translate(_SHAPE))
        found = self[word] = xxhash.xxh3_64_intdigest(word) % WORDS << 16 | WORDS + xxhash.xxh3_64_intdigest(shape) % SHAPES
        return found


def index_vectors(seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, SIZE), np.float32)
    for i in range(NONZERO):
        out[np.arange(BUCKETS), draw.integers(0, SIZE, BUCKETS)] = 1 if i % 2 else -1
    return out


def _ids(text: str, buckets: dict) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their shapes."""
    words = text.split()
    both = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    return both >> 16, both & 0xFFFF


def _contexts(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, index, sums = _Buckets(), index_vectors(seed), np.zeros((BUCKETS, SIZE), np.float64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for ids in _ids(text, buckets):
                    around = np.zeros((ids.size, SIZE), np.float32)
                    for step in range(1, min(window, ids.size - 1) + 1):
                        around[step:] += index[ids[:-step]]
                        around[:-step] += index[ids[step:]]
                    order = np.argsort(ids, kind="stable")
                    there, starts = np.unique(ids[order], return_index=True)
                    if there.size:
                        sums[there] += np.add.reduceat(around[order], starts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([sums.astype(np.float32).tobytes()], pa.binary())], names=["sums"])

    return run


def _features(text: str, vectors: np.ndarray, buckets: dict) -> np.ndarray:
    ids, shapes = _ids(text, buckets)
    if not ids.size:
        return np.zeros(3 * SIZE + 2, np.float32)
    mean, square, near = np.zeros(SIZE), np.zeros(SIZE), 0.0
    for start in range(0, ids.size, 65536):
        part = vectors[ids[start : start + 65537]]
        norm = np.sqrt(np.einsum("ij,ij->i", part, part)) + 1e-9
        near += float((np.einsum("ij,ij->i", part[1:], part[:-1]) / (norm[1:] * norm[:-1])).sum())
        part = part[:65536]
        mean += part.sum(0)
        square += np.einsum("ij,ij->j", part, part)
    mean, square = mean / ids.size, square / ids.size
    kinds, n = np.unique(shapes, return_counts=True)
    shape = n.astype(np.float32) @ vectors[kinds] / ids.size
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), shape, [near / ids.size, np.log1p(ids.size)]]).astype(np.float32)


def _sample_features(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, vectors = _Buckets(), sent.value
        for batch in batches:
            texts, labels = columns_of(batch)
            rows = [_features(text, vectors, buckets).tobytes() for text in texts]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(labels, pa.int32())], names=["x", "y"])

    return run


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 500, seed: int = 1) -> dict:
    """Weights of a two-layer network by Adam over all rows, and its temperature."""
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(x))
    fit, check = order[len(x) // 5 :], order[: len(x) // 5]
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    z = (x - mean) / scale
    p = [draw.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), draw.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v = [0 * a for a in p], [0 * a for a in p]
    for step in range(1, steps + 1):
        h = np.tanh(z[fit] @ p[0] + p[1])
        error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[fit]) / len(fit)
        back = np.outer(error, p[2]) * (1 - h * h)
        grads = [z[fit].T @ back + 1e-4 * p[0], back.sum(0), h.T @ error + 1e-4 * p[2], np.array([error.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(z[check] @ p[0] + p[1]) @ p[2] + p[3][0]

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, logit / t) - y[check] * logit / t))

    temperature = min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss) if len(check) else 1.0
    return {"mean": mean, "scale": scale, "p": p, "temperature": float(temperature)}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    p = model["p"]
    logit = (np.tanh(((x - model["mean"]) / model["scale"]) @ p[0] + p[1]) @ p[2] + p[3][0]) / model["temperature"]
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 6000, window: int = 2, seed: int = 4) -> dict:
    """The model: word vectors, network and temperature."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, rows).coalesce(8)
    sums = np.zeros((BUCKETS, SIZE), np.float64)
    for row in sample.select("text").mapInArrow(_contexts(window, seed), "sums binary").toLocalIterator():
        sums += np.frombuffer(row.sums, np.float32).reshape(BUCKETS, SIZE)
    vectors = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32) + index_vectors(seed) / np.float32(np.sqrt(NONZERO))
    sent = spark.sparkContext.broadcast(vectors)
    found = sample.select("text", "label").mapInArrow(_sample_features(sent), "x binary, y int").toPandas()
    y = found["y"].to_numpy(np.float64)
    if len(set(y.tolist())) < 2:
        return {"vectors": vectors, "network": None, "share": float(y.mean()) if y.size else 0.5}
    x = np.array([np.frombuffer(b, np.float32) for b in found["x"]], np.float64)
    order = np.lexsort([*x.T[::-1], y])  # the rows arrive in any order
    return {"vectors": vectors, "network": train_network(x[order], y[order])}


def _scores(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, buckets = sent.value, _Buckets()
        for batch in batches:
            ids, texts = columns_of(batch)
            if not ids:
                continue
            if model["network"] is None:
                score = np.full(len(ids), model["share"])
            else:
                score = probability(model["network"], np.array([_features(text or "", model["vectors"], buckets) for text in texts], np.float64))
            yield from in_slices(zip(ids, score.tolist(), strict=True), _OUT)

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scores(sent), "doc_id long, score double")
