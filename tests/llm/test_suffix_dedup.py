"""Suffix-array dedup against a brute-force count of windows."""

import hashlib
import random
import sys
from collections import Counter

import numpy as np
import pytest
from rasterlake.llm import suffix_dedup


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(texts, n):
    """How many maximal runs of words each text has that lie in windows of ``n`` words found elsewhere."""
    split = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append(sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)))
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("seed", range(2))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    shared = [words(rng, n) for n in (60, 90, 110, 140, 300)]
    texts = [None, "", "x" * 399, "x" * 400, "y" * 400, "ab" * 900, "The " * 300, words(rng, 5000)]
    for _ in range(30):
        parts = [words(rng, rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            one = rng.choice(shared)
            cut = rng.randint(0, len(one) // 4)
            parts += [one[cut : len(one) - rng.randint(0, len(one) // 4)], words(rng, rng.randint(0, 30))]
        texts.append(rng.choice(["", " "]).join(parts))
    texts += [texts[12], texts[13]]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, sha string").repartition(3)
    for hot in (256, 2, 1):
        rows = suffix_dedup.digests(df, hot=hot).collect()
        got = {r[0]: tuple(r[1:5]) for r in rows}
        assert [got[i] for i in range(len(texts))] == brute(texts, 400)
        found = {r.doc_id: r.n_passages for r in rows}
        assert [found[i] for i in range(len(texts))] == passages(texts, 51)


def positions(texts, length):
    """Where each string of ``length`` bytes that starts more than once starts."""
    found = {}
    for doc, text in enumerate(texts):
        body = (text or "").encode()
        for i in range(len(body) - length + 1):
            found.setdefault(body[i : i + length], set()).add((doc, i))
    return {w: p for w, p in found.items() if len(p) > 1}


@pytest.mark.parametrize("hot", [256, 6, 1])
def test_repeats_with_all_occurrences(spark, hot):
    rng = random.Random(9)
    shared = [words(rng, n) for n in (14, 20, 60)]
    texts = [None, "", "ab" * 60]
    for i in range(24):
        one = shared[i % 3]
        texts.append(words(rng, rng.randint(0, 12)) + one[rng.randint(0, 9) : len(one) - rng.randint(0, 9)] + words(rng, rng.randint(0, 12)))
    texts += [texts[5], "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    groups = {}
    for r in suffix_dedup.repeats(df, search=suffix_dedup.of_bytes(40, 8, 8), hot=hot).collect():
        groups.setdefault((bytes(r.repeat), r.length), []).append((r.doc_id, r.start))
    want, got = positions(texts, 40), {}
    bodies = [(t or "").encode() for t in texts]
    for (_, size), places in groups.items():
        strings = {bodies[doc][at : at + size] for doc, at in places}
        assert len(strings) == 1 and len(places) == len(set(places)) > 1
        string = strings.pop()
        assert sorted(places) == sorted((d, i) for d, b in enumerate(bodies) for i in range(len(b) - size + 1) if b[i : i + size] == string)
        for k in range(size - 39):
            got.setdefault(string[k : k + 40], set()).update((doc, at + k) for doc, at in places)
    assert got == want
    assert {(len(bodies[d][i : i + size]), frozenset(places)) for (_, size), places in groups.items() for d, i in places[:1]} == maximal(bodies, 40)


def maximal(bodies, least):
    """(length, occurrences) of every string that occurs twice and whose neighbours differ on both sides."""
    places = {}
    for d, b in enumerate(bodies):
        for i in range(len(b)):
            for j in range(i + least, len(b) + 1):
                places.setdefault(b[i:j], []).append((d, i))
    side = lambda x: len(x) > 1 and (b"" in x or len(set(x)) > 1)
    return {(len(s), frozenset(at)) for s, at in places.items() if side([bodies[d][i - 1 : i] if i else b"" for d, i in at]) and side([bodies[d][i + len(s) : i + len(s) + 1] for d, i in at])}


@pytest.mark.parametrize("hot", [256, 1])
def test_a_long_copy_is_one_repeat(spark, hot):
    """Parts of it found in other texts are repeats of their own, and don't cut it."""
    rng = random.Random(2)
    p, q, r = (words(rng, n) for n in (30, 60, 30))
    texts = ["1" + p + q + r + "a", "2" + p + q + r + "b", "3" + p + q + "c", "4" + q + r + "d", "x" * 50]
    df = spark.createDataFrame([(i, t, b"n") for i, t in enumerate(texts)], "doc_id long, text string, name binary").repartition(2)
    groups = {}
    for x in suffix_dedup.repeats(df, search=suffix_dedup.of_bytes(40, 8, 8), hot=hot).collect():
        groups.setdefault((bytes(x.repeat), x.length), set()).add((x.doc_id, x.start))
    assert {(size, frozenset(at)) for (_, size), at in groups.items()} == maximal([t.encode() for t in texts], 40)
    assert (len((p + q + r).encode()), frozenset({(0, 1), (1, 1)})) in {(size, frozenset(at)) for (_, size), at in groups.items()}


@pytest.mark.parametrize("parts", [(400, 48, 32), (400, 64, 24), (80, 64, 32), (1 << 16, 64, 32)])
def test_parts_that_do_not_fit(parts):
    with pytest.raises(ValueError):
        suffix_dedup.of_bytes(*parts)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.digests(df).collect() == [] and suffix_dedup.repeats(df).collect() == []


def test_maximal_repeats():
    import numpy as np

    text = np.frombuffer(b"xabcyabczabc#", np.uint8).astype(np.int64)
    before = np.concatenate([[999], text[:-1]])
    found = sorted((size, sorted(places.tolist())) for size, places in suffix_dedup.SuffixArray(text, 8).maximal_repeats(before, 2))
    assert found == [(3, [1, 5, 9])]


def calls(work, *args):
    """How many functions ``work`` calls, those of C included."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        work(*args)
    finally:
        sys.setprofile(None)
    return n


def test_anchors_are_the_leftmost_of_the_least():
    rng = random.Random(4)
    search = suffix_dedup.of_bytes(40, 8, 16)
    for text in (b"x" * 40, b"abc" * 100, bytes(rng.choices(b"ab", k=700)), rng.randbytes(900)):
        h = suffix_dedup._gram_hashes(text, search.gram) >> np.uint64(32)
        got = {}
        for _, at, first, last in zip(*suffix_dedup.anchors(text, search.length, search.gram)):
            got |= dict.fromkeys(range(first, last + 1), at)
        span = search.length - search.gram + 1
        assert got == {w: w + int(np.argmin(h[w : w + span])) for w in range(len(text) - search.length + 1)}


def test_anchors_and_words_take_no_call_each():
    rng = random.Random(5)
    short, long = (words(rng, n).encode() for n in (200, 20_000))
    for search in (suffix_dedup.of_bytes(), suffix_dedup.of_words()):
        read = search.reader()
        assert calls(read, long) <= calls(read, short) + 10
        found = [(search.length, search.gram, search.unit)] * 2
        least, most = (calls(suffix_dedup.anchors, read(text), *sizes) for text, sizes in zip((short, long), found))
        assert most <= least + 10


def test_codes_are_those_of_words():
    rng = random.Random(6)
    split = [bytes(rng.choices(b"ab\xc3\xa9\x00\x1c", k=rng.choice((1, 2, 3, 5, 300)))) for _ in range(3000)] + [b"a" * n for n in (255, 256, 257, 5000)]
    text = b"".join(bytes(rng.choices(b" \t\n\x0b\x0c\r", k=rng.randint(1, 3))) + w for w in split)
    code = {}
    for body in (text, text + b" ", text.lstrip(), b" ".join(split)):
        codes = np.frombuffer(suffix_dedup.word_codes(body), np.uint64).tolist()
        assert len(codes) == len(split) and all(code.setdefault(w, c) == c for w, c in zip(split, codes))
    assert len(set(code.values())) == len(code)
    assert suffix_dedup.word_codes(b"") == suffix_dedup.word_codes(b" \n") == b""
    assert suffix_dedup.word_codes(b"b a\x00") == b"".join(map(suffix_dedup.word_codes, (b"b", b"a\x00")))
