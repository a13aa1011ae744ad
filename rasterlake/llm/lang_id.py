"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1. A trigram is the product of its letters'
vectors, each rotated by the letter's place; a text is the sum of its trigrams, and a
language is the sum of the trigrams of its learned texts. A text gets the language
whose profile has the largest cosine with it.

Every training row is learned from: each task bundles its trigrams into one vector a language,
and these are summed on the executors in whole numbers, so what reaches the driver is one
vector a language, however large the corpus is. Profiles have their common mean taken off, so that
trigrams that all languages share don't decide.

Defined results: a null text or one without a letter is ``und`` with score 0; rows of
null lang aren't learned from; without any learned row every text is ``und``; ties go
to the first language by name; whole texts are used however long; repeated rows and
other columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, mix

#: Letter classes (a power of two); class 0 is a run of other characters.
_CLASSES = 64
_CODES = _CLASSES**3
_OUT = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])
UNKNOWN = "und"


def _class_table() -> np.ndarray:
    """Class of each code point: letters share 63 classes by a hash, the rest is class 0."""
    points = np.arange(0x110000, dtype=np.uint64)
    table = (mix(points, 7) % np.uint64(_CLASSES - 1) + np.uint64(1)).astype(np.uint8)
    low = np.arange(26)
    table[97 + low] = 1 + low  # the common letters keep classes of their own
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)
    return np.where(letter, table, 0).astype(np.int32)


_TABLE: list[np.ndarray] = []
_GAP = np.zeros(1, np.int32)


def codes_of(text: str) -> np.ndarray:
    """Trigram codes of a lower-cased text; runs of other characters count as one space."""
    if not _TABLE:
        _TABLE.append(_class_table())
    lower = text.lower() + " "
    points = np.frombuffer(lower.encode("utf-16-le", "surrogatepass"), np.uint16)
    if points.size != len(lower):
        points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _TABLE[0][points]
    keep = kind > 0
    keep[1:] |= keep[:-1].copy()
    kind = kind[keep]
    if kind.size < 2:
        return np.empty(0, np.int32)
    kind = np.concatenate([_GAP, kind])
    return (kind[:-2] * _CLASSES + kind[1:-1]) * _CLASSES + kind[2:]


def letter_vectors(size: int, seed: int) -> np.ndarray:
    """A vector of -1 and 1 for each class."""
    return np.random.default_rng(seed).integers(0, 2, (_CLASSES, size), dtype=np.int8) * 2 - 1


def bind(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Vectors of trigrams: the letters' vectors rotated by two, one and no places, multiplied."""
    a, b, c = codes // (_CLASSES * _CLASSES), codes // _CLASSES % _CLASSES, codes % _CLASSES
    return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]


def _bundles(size: int, seed: int):
    """One row a language and task: the sum of its trigrams' vectors, and their number behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*columns_of(batch), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(_CODES, np.int64)
                np.add.at(counts[lang], codes_of(text or ""), 1)
        letters = letter_vectors(size, seed)
        for lang, n in counts.items():
            there, total = np.flatnonzero(n), np.zeros(size, np.int64)
            for start in range(0, there.size, 8192):
                part = there[start : start + 8192]
                total += n[part] @ bind(part, letters).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([[*total.tolist(), int(n.sum())]], pa.list_(pa.int64()))], names=["lang", "sums"])

    return run


def learn(df: DataFrame, lang: str = "lang", text: str = "text", size: int = 256, seed: int = 20) -> dict:
    """Profiles of the languages of ``df``."""
    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), F.col(text))
    each = rows.mapInArrow(_bundles(size, seed), "lang string, sums array<long>").select("lang", F.posexplode("sums").alias("place", "value"))
    found = each.groupBy("lang", "place").agg(F.sum("value").alias("value")).toPandas()
    names, profiles = sorted(found["lang"].unique()), []
    for name in names:
        sums = found[found["lang"] == name].sort_values("place")["value"].to_numpy(np.float64)
        profiles.append(sums[:size] / max(1.0, sums[size]))
    return {"names": names, "profiles": np.array(profiles).reshape(len(names), size), "size": size, "seed": seed}


class _Scorer:
    def __init__(self, model: dict) -> None:
        self.names, self.letters = model["names"], letter_vectors(model["size"], model["seed"])
        self.mean = model["profiles"].mean(0) if self.names else np.zeros(model["size"])
        centred = model["profiles"] - (self.mean if len(self.names) > 1 else 0)
        self.profiles = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.mean = (self.mean if len(self.names) > 1 else 0 * self.mean).astype(np.float32)
        self.rows = np.full(_CODES, -1, np.int32)
        self.vectors = np.empty((0, model["size"]), np.float32)

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes = codes_of(text or "")
        if not codes.size or not self.names or not any(map(str.isalpha, text or "")):
            return UNKNOWN, 0.0
        codes, n = np.unique(codes, return_counts=True)
        new = codes[self.rows[codes] < 0]
        if new.size:
            if len(self.vectors) + new.size > 40_000:  # bounded memory: start again
                self.rows[:], self.vectors, new = -1, self.vectors[:0], codes
            self.rows[new] = np.arange(len(self.vectors), len(self.vectors) + new.size)
            self.vectors = np.concatenate([self.vectors, bind(new, self.letters).astype(np.float32)])
        total = n.astype(np.float32) @ self.vectors[self.rows[codes]] / np.float32(n.sum()) - self.mean
        cosines = self.profiles @ total / max(float(np.linalg.norm(total)), 1e-12)
        best = int(np.argmax(cosines))
        return self.names[best], float(min(1.0, max(0.0, cosines[best])))


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(sent.value)
        for batch in batches:
            found = [score(text) for text in batch.column(batch.schema.names.index("_text")).to_pylist()]
            new = [pa.array(values, field.type) for values, field in zip(zip(*found, strict=True), _OUT, strict=True)] if found else [pa.array([], field.type) for field in _OUT]
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + new, names=[batch.schema.names[i] for i in kept] + _OUT.names)

    return run


def predict(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``df``'s columns as struct ``row``, with lang_pred and score."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row"), F.col(text).alias("_text"))
    return rows.mapInArrow(_predict(sent), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double") if df.columns else rows


