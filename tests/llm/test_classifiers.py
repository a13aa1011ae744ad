"""Quality, language and toxicity operators against plain recomputations, and their defined results."""

import itertools
import math
import zlib

import numpy as np
import pytest
from rasterlake.llm import lang_id, quality, toxicity
from rasterlake.llm.common import labelled_sample

DOCS = "doc_id long, text string"


def split(n):
    """``n`` ids of the training half and ``n`` of the rest."""
    train, held, i = [], [], 0
    while len(train) < n or len(held) < n:
        (held if zlib.crc32(str(i).encode()) % 3 == 1 else train).append(i)
        i += 1
    return train[:n], held[:n]


def test_quality_features_word_by_word():
    vectors = np.random.default_rng(1).standard_normal((quality.BUCKETS, quality.SIZE)).astype(np.float32)
    buckets = quality._Buckets()
    for text in ("one", "One two TWO 12-34 zwei", " a  b\na a " * 40, "x" * 5000 + " y"):
        words = text.split()
        ids = [buckets[w] >> 16 for w in words]
        shapes = [buckets[w] & 0xFFFF for w in words]
        own = np.array([vectors[i] for i in ids], np.float64)
        near = sum(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) for a, b in itertools.pairwise(own)) / len(words)
        want = [*own.mean(0), *own.std(0), *np.mean([vectors[i] for i in shapes], 0), near, math.log(1 + len(words))]
        assert np.allclose(quality._features(text, vectors, buckets), want, atol=2e-3)
    assert not quality._features("", vectors, buckets).any()
    assert quality._Buckets()["a" * 100 + "0"] & 0xFFFF != quality._Buckets()["a" * 100] & 0xFFFF  # a word's end counts, however long it is


def test_quality_contexts_word_by_word():
    import pyarrow as pa

    texts = ["a b c a", "b", "", "c c c"]
    out = next(quality._contexts(2, 4)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    got = np.frombuffer(out.column(0).to_pylist()[0], np.float32).reshape(quality.BUCKETS, quality.SIZE)
    buckets, index = quality._Buckets(), quality.index_vectors(4)
    want = np.zeros_like(got)
    for text in texts:
        words = text.split()
        for part in (lambda w: buckets[w] >> 16, lambda w: buckets[w] & 0xFFFF):
            ids = [part(w) for w in words]
            for i, j in itertools.product(range(len(ids)), repeat=2):
                if 0 < abs(i - j) <= 2:
                    want[ids[i]] += index[ids[j]]
    assert np.allclose(got, want)


def test_network_and_temperature():
    draw = np.random.default_rng(3)
    x = draw.standard_normal((600, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (draw.random(600) < 0.1)).astype(float)
    model = quality.train_network(x, y, steps=300)
    w1, b1, w2, b2 = model["p"]
    logits = []
    for row in (x - model["mean"]) / model["scale"]:
        hidden = [math.tanh(sum(row[i] * w1[i, j] for i in range(5)) + b1[j]) for j in range(w1.shape[1])]
        logits.append(sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0])
    assert np.allclose(quality.probability(model, x), [1 / (1 + math.exp(-v / model["temperature"])) for v in logits])
    assert ((quality.probability(model, x) > 0.5) == y).mean() > 0.85  # no line divides these
    check = draw.__class__(np.random.PCG64(1)).permutation(600)[:120]  # the rows that only the temperature is fitted on
    loss = lambda t: np.mean(np.logaddexp(0, np.array(logits)[check] / t) - y[check] * np.array(logits)[check] / t)
    assert loss(model["temperature"]) <= loss(1.0) + 1e-9


def graded(n=60):
    """Documents of two kinds in both halves, and their labels."""
    draw = np.random.default_rng(5)
    train, held = split(n)
    good, bad = ["alpha", "beta", "gamma", "delta", "omega"], ["zx!!", "q0q0", "##", "buy", "NOW"]
    rows = [(i, " ".join(draw.choice(good if k % 2 else bad, 30)), k % 2) for ids in (train, held) for k, i in enumerate(ids)]
    return rows, held


def test_quality_of_held_out_documents(spark):
    rows, held = graded()
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t, _ in rows], DOCS + ", share string, score double").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows if i in set(held))
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1 - y if i in set(held) else y) for i, _, y in rows], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality.score(docs, quality.learn(docs, flipped)).collect()}
    assert all(abs(got[i] - again[i]) < 1e-9 for i in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "alpha beta " * 100_000), (None, "zx!!")], DOCS)
    found = {(r.doc_id, round(r.score, 9)) for r in quality.score(odd, model).collect()}
    assert len(found) == 4 and len({s for i, s in found if i in (1, 2)}) == 1 and all(0 <= s <= 1 for _, s in found)
    assert quality.score(docs.limit(0), model).collect() == []


def test_quality_without_much_to_learn(spark):
    train, _ = split(4)
    docs = spark.createDataFrame([(i, "a b") for i in train], DOCS)
    for rows, want in (([], 0.5), ([(i, 1) for i in train], 1.0), ([(train[0], None), (None, 1), (train[1], 7)], 0.5)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert {r.score for r in quality.score(docs, quality.learn(docs, labels)).collect()} == {want}
    assert quality.learn(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))["share"] == 0.5


def test_sample_is_bounded_whatever_repeats(spark):
    train, _ = split(30)
    docs = spark.createDataFrame([(train[0], f"text {i}") for i in range(50)] + [(i, "t") for i in train[1:]] + [(train[1], None)], DOCS)
    labels = spark.createDataFrame([(i, 1) for i in train] * 2, "doc_id long, quality int")
    assert labelled_sample(docs, labels, "quality", 10).count() == 10
    assert {r.text for r in labelled_sample(docs, labels, "quality", 1000).collect()} == {"text 0", "t", ""}


# --- language -----------------------------------------------------------------


def naive_vector(text, letters):
    """The trigrams of a text bound letter by letter and bundled."""
    codes = lang_id.codes_of(text)
    size = letters.shape[1]
    total = [0] * size
    for code in codes.tolist():
        a, b, c = code // 4096, code // 64 % 64, code % 64
        for k in range(size):
            total[k] += int(letters[a][(k - 2) % size]) * int(letters[b][(k - 1) % size]) * int(letters[c][k])
    return np.array(total, np.float64), codes.size


def test_language_profiles_letter_by_letter(spark):
    rows = [("en", "The cat, the dog; the house."), ("de", "Der Hund und die Katze"), ("de", "das Haus"), ("fr", "le chat et la maison"), (None, "nothing"), ("en", None), ("fr", "")]
    model = lang_id.learn(spark.createDataFrame(rows, "lang string, text string").repartition(3), size=32)
    letters = lang_id.letter_vectors(32, model["seed"])
    want = {}
    for lang, text in rows:
        if lang and text:
            vector, n = naive_vector(text, letters)
            sums, count = want.get(lang, (0, 0))
            want[lang] = sums + vector, count + n
    assert model["names"] == sorted(want)
    profiles = np.array([want[name][0] / want[name][1] for name in model["names"]])
    assert np.allclose(model["profiles"], profiles)
    text = "the house and the cat"
    vector, n = naive_vector(text, letters)
    centred, own = profiles - profiles.mean(0), vector / n - profiles.mean(0)
    cosines = centred @ own / np.linalg.norm(centred, axis=1) / np.linalg.norm(own)
    name, score = lang_id._Scorer(model)(text)
    assert name == model["names"][int(np.argmax(cosines))] == "en" and abs(score - cosines.max()) < 1e-4


def test_language_defined_results(spark):
    rows = [(1, "the cat and the dog", "en", "a", "b"), (1, "the cat and the dog", "en", "a", "b"), (2, "der Hund und die Katze", "de", "a", "b"), (3, None, "en", "a", "b"), (4, "12 !", None, "a", "b"), (5, "the dog " * 200_000, None, "a", "b")]
    df = spark.createDataFrame(rows, DOCS + ", lang string, lang_pred string, score string").repartition(3)
    model = lang_id.learn(df)
    got = [(r.row.doc_id, r.lang_pred) for r in lang_id.predict(df, model).collect()]
    assert sorted(got) == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "en")]
    assert lang_id.predict(df.limit(0), model).collect() == []
    nothing = lang_id.learn(df.limit(0))
    assert {r.lang_pred for r in lang_id.predict(df, nothing).collect()} == {"und"}
    twins = lang_id.learn(spark.createDataFrame([("b", "same words"), ("a", "same words")], "lang string, text string"))
    assert {r.lang_pred for r in lang_id.predict(df.where("doc_id = 1"), twins).collect()} == {"a"}


# --- toxicity -----------------------------------------------------------------


def field():
    draw = np.random.default_rng(8)
    return {"weights": draw.standard_normal(toxicity.BUCKETS).astype(np.float32), "moves": draw.standard_normal((2, 2)), "start": draw.standard_normal(2), "bias": -0.5}


def test_scores_by_enumeration(spark):
    model = field()
    texts = ["one", "Two words, HERE", "a b c d e f", "", None, "!!"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(2)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    for doc, text in enumerate(texts):
        words = [w for w in "".join(c if c.isalnum() else " " for c in text or "").split()]
        if not words:
            assert got[doc].score == 0 and got[doc].spans == []
            continue
        e = [sum(float(model["weights"][i]) for i in toxicity.features(w.lower())) + model["bias"] for w in words]
        total, on = 0.0, np.zeros(len(words))
        for tags in itertools.product((0, 1), repeat=len(words)):
            w = math.exp(model["start"][tags[0]] + sum(a * t for a, t in zip(e, tags, strict=True)) + sum(model["moves"][a, b] for a, b in itertools.pairwise(tags)))
            total += w
            on += w * np.array(tags)
        marginals = on / total
        assert abs(got[doc].score - marginals.max()) < 1e-6
        marked = [m >= 0.5 for m in marginals]
        assert len(got[doc].spans) == sum(m and not (i and marked[i - 1]) for i, m in enumerate(marked))


def test_spans_are_places_in_the_text():
    for text in ("İİİ bad x", "ẞ bad", "Bad"):
        n = len(toxicity.tokens(text))
        at = text.lower().index("bad") if text == "Bad" else text.index("bad")
        marginals = np.array([float(w == "bad") for w in toxicity.tokens(text)])
        assert n == marginals.size and toxicity.spans_in(text, marginals, 0.5) == [{"start": at, "stop": at + 3}]


def test_toxicity_defined_results(spark):
    train, _ = split(40)
    rows = [(i, "vile slur here" if k % 4 == 0 else "plain words here", int(k % 4 == 0)) for k, i in enumerate(train)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "words " * 300_000 + "vile slur", 0.5), (3, "plain", 0.5), (3, "plain", 0.5)], DOCS + ", score double")
    got = sorted((r.doc_id, r.score >= 0.7) for r in toxicity.score(odd, model).collect())
    assert got == [(1, False), (2, False), (3, False), (3, False), (3, True)]
    assert toxicity.score(odd.limit(0), model).collect() == []
    for none in ([], [(i, 0) for i in train], [(None, 1)]):
        nothing = toxicity.learn(docs, spark.createDataFrame(none, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}
    # no more tokens reach the driver than allowed: of documents of three tokens, two
    assert toxicity.learn(docs, labels, most_tokens=2) is None and toxicity.learn(docs, labels, most_tokens=100) is not None
