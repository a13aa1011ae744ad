"""Near-duplicate operators against brute force on small tables."""

import math
import random

import numpy as np
from rasterlake.llm import embed_dedup, ngram_join
from rasterlake.llm.common import components


def closure(ids, edges):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(500, i) for i in range(600, 640)]
    want = closure({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows, base = [], rng.standard_normal((12, 16))
    for i in range(150):
        v = base[i % 12] + rng.standard_normal(16) * (0.02, 0.12, 0.2)[i % 3]
        rows.append((i, [float(np.float32(x)) for x in v], i % 2 if i % 12 else 5))
    rows += [(150 + i, rows[0][1], 5) for i in range(30)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [math.nan] * 16, 1), (203, [None] * 16, 1), (204, rows[0][1], None), (205, [], 1), (206, rows[1][1][:8], 1), (207, [math.inf] * 16, 1)]
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    edges = []
    for a in good:
        for b in good:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    edges.append((a[0], b[0]))
    want = closure([r[0] for r in rows], edges)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    for block in (1024, 4):
        got = {r.vec_id: r for r in embed_dedup.near_dedup(df, block=block).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert {i: r.n_links for i, r in got.items()} == {r[0]: sum(r[0] in e for e in edges) for r in rows}
        assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert embed_dedup.near_dedup(df.limit(0)).collect() == []


def sets_of(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def test_jaccard(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(400)]
    texts = [None, "", " \t\n", "one", "ONE ", "a b c", "A  b\tc"]
    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 220))]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy[rng.randint(0, 3) :]))
    texts += [texts[8], " ".join(vocabulary * 30)]
    sets = [sets_of(t, 4) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = closure(range(len(texts)), edges)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(3)
    for block in (256, 2):
        got = {r.doc_id: r for r in ngram_join.classes(df, block=block).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert ngram_join.classes(df.limit(0)).collect() == []


def test_second_pass_finds_what_the_first_leaves(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(400)]
    texts = []
    for _ in range(3):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(25):
            base[rng.randrange(120)] = rng.choice(vocabulary)
            texts.append(" ".join(base))
    sets = [sets_of(t, 4) for t in texts]
    want = closure(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole, calls = ngram_join._pass, []

    def some(*args):
        calls.append(args)
        return whole(*args).where("a % 3 = 0") if len(calls) == 1 else whole(*args)

    monkeypatch.setattr(ngram_join, "_pass", some)
    assert {r.doc_id: r.component_id for r in ngram_join.classes(df, block=2).collect()} == want


def test_null_and_repeated_ids(spark):
    row = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, row, "a"), (None, row, "a"), (4, row, "a"), (4, [1.0, 2.0, 3.0001], "a"), (5, row, "b"), (6, row, None)], "vec_id long, embedding array<double>, label string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_dedup(df).collect()), key=str)
    assert got == sorted([(None, 3, 4, False), (None, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (5, 0, 5, True), (6, 0, 6, True)], key=str)
    labels = spark.createDataFrame([(1, [1.0, 1.0], 1.2), (2, [1.0, 1.0], 1.7), (3, [2.0, 2.0], 1.2), (4, [1.0, 1.0], -0.0), (5, [1.0, 1.0], 0.0)], "vec_id long, embedding array<float>, label double")
    assert {r.vec_id: r.component_id for r in embed_dedup.near_dedup(labels).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}
    texts = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "x"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(texts).collect()), key=str)
    assert got == sorted([(None, 2, 7), (None, 2, 7), (7, 2, 7), (7, 1, 7), (None, 0, None)], key=str)
