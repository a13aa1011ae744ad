"""Source divergence, periodic runs and personal data, against brute force and by their defined results."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from rasterlake.llm import pii, runs, source_divergence
from rasterlake.llm.common import Tables

# --- runs


def every_run(w, least):
    """(start, length, period) of all runs, by trying every period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            length = i + p - start
            if i > start and length >= max(least, 2 * p):
                found.setdefault((start, length), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        letters, n, w = rng.choice(["a", "ab", "ab", "abc", "abcd"]), rng.randrange(45), []
        while len(w) < n:
            if w and rng.random() < 0.4:
                i = rng.randrange(len(w))
                w += w[i : rng.randint(i + 1, len(w))] * rng.randint(1, 3)
            else:
                w.append(rng.choice(letters))
        yield [c.encode() for c in w]


@pytest.mark.parametrize("least", [2, 12])
def test_runs_are_those_of_all_periods(least):
    for w in texts(least, 4000):
        assert runs.find_runs(w, least) == every_run(w, least), w


class Counted:
    n = 0

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Counted.n += 1
        return self.v == other.v

    def __lt__(self, other):
        Counted.n += 1
        return self.v < other.v

    def __gt__(self, other):
        Counted.n += 1
        return self.v > other.v

    __hash__ = None


def test_runs_compare_words_a_bounded_number_of_times():
    fib = ["a", "ab"]
    while len(fib[-1]) < 20_000:
        fib.append(fib[-1] + fib[-2])
    for text in ("a" * 20_000, "abcab" * 4_000, fib[-1], "".join("ab"[i.bit_count() & 1] for i in range(20_000)), "".join("a" * k + "b" for k in range(1, 200))):
        Counted.n = 0
        runs.find_runs([Counted(c) for c in text], 2)
        assert Counted.n < 20 * len(text)


def test_runs_of_documents(spark):
    long = ("x y z " * 5_000).encode() + b"end"
    rows = [(1, "a b " * 9 + "c"), (1, "a b " * 9 + "c"), (2, None), (3, ""), (4, "one two three"), (None, "t " * 12), (7, long.decode()), (8, "a\tb\n" * 6)]
    df = spark.createDataFrame([(*r, "n", 0) for r in rows], "doc_id long, text string, start string, n_runs long").repartition(3)
    got = runs.digests(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id) or ""
        w = runs.planted(text.encode().split(), r.doc_id)
        want = every_run(w, 12) if len(w) < 1000 else [(0, 15_000, 3)]
        assert r.n_runs == len(want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in want).encode()).hexdigest()
        gone = {i for a, b, c in want for i in range(a + c, a + b)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        top = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == top and r.exponent_milli == (top[1] and 1000 * top[1] // top[2])
    assert sorted((r.start, r.length, r.period) for r in runs.runs(df).where("doc_id = 1").collect()) == [(0, 18, 2)] * 2
    assert runs.digests(df.limit(0)).collect() == [] and runs.runs(df.limit(0)).collect() == []


def test_planted_tails_repeat():
    ids = [d for d in range(400) if runs.planted([b"%d" % i for i in range(50)], d) != [b"%d" % i for i in range(50)]]
    assert 20 < len(ids) < 60
    assert runs.planted([], ids[0]) == [] and runs.planted([b"a"], None) == [b"a"] and len(runs.planted([b"x"] * 7, ids[0])) == 7


# --- source divergence


def divergence(rows, least, most):
    """(lang, source, part, item, value, rank) by dense counting."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    share = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        total = lambda c: sum(c[t] for t in kept)  # noqa: B023, E731
        own, others = counts[lang, source], {s: c for (g, s), c in counts.items() if g == lang and s != source}
        whole = sum((c for (g, _), c in counts.items() if g == lang), Counter())
        pairs = [(sum(apart(share(own[t], total(own), v), share(c[t], total(c), v)) for t in kept), s) for s, c in others.items()]
        terms = [(apart(p, q), t) for t in kept if own[t] and (p := share(own[t], total(own), v)) > (q := share(whole[t], total(whole), v))]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[: most if part == "term" else None])]
    return sorted(out, key=str)


@pytest.mark.parametrize("groups", [100_000, 0])
def test_divergence_by_dense_counting(spark, monkeypatch, groups):
    monkeypatch.setattr(source_divergence, "_GROUPS", groups)
    monkeypatch.setattr(source_divergence, "_HELD", 40)
    rng = random.Random(5)
    words = ["the", "The", "été", "ÉTÉ", "a-b", "x1y", "zebra", "İ", "日本", "ein", "'", "12", "OF", "of", "tie", "eit"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "", None, "s3"]), " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(160)]
    rows += [("rare", "s1", "only once"), ("rare", "s2", None), ("rare", "s3", ""), ("alone", "s", "q " * 50)] + [rows[0]] * 40
    df = spark.createDataFrame([(i % 9 or None, *r, "t") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string").repartition(5)
    found = source_divergence.divergence(df, least_docs=10, most_terms=3)
    got = sorted(((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found.collect()), key=str)
    assert got == divergence(rows, 10, 3)
    assert {r[4] for r in got if r[0] == "rare"} == {0} and not [r for r in got if r[0] == "alone"]


def test_divergence_of_nothing_and_of_long_texts(spark):
    df = spark.createDataFrame([("en", "a", "word " * 400_000), ("en", "b", "other " * 3)], "lang string, source string, text string")
    got = source_divergence.divergence(df, least_docs=1).collect()
    assert sorted((r.source, r.part, r.item, r["rank"]) for r in got) == [("a", "pair", "b", 1), ("a", "term", "word", 1), ("b", "pair", "a", 1), ("b", "term", "other", 1)]
    assert source_divergence.divergence(df.limit(0)).collect() == []
    assert list(source_divergence._pieces(b"ab cd ef", 1)) == [[b"ab"], [b"cd"], [b"ef"]]


# --- personal data


def literal(text):
    """Base spans by the contract's own patterns."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        twice = [int(c) * 2 for c in digits[-2::-2]]
        if 14 <= len(digits) <= 19 and (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    pieces = ["a@b.c", "@", ".", "..", "x@y", "é", "+1 (555) 010-9999", "+", "1.2.3.4", "255.255.255.256", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "0", "7", " ", "-", "(", "a.b-c%+@d-e.f.g", "000000000000001.0.0.1", "٣", "1234567890123456789", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 12)))
        assert pii.base_spans(text) == literal(text), text


def test_hard_texts_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 300_000, "+1" + "(" * 1_000_000, "a@" * 500_000, "1 " * 500_000, "a at " * 200_000, "x(at)" * 200_000):
        assert pii._candidates(text, pii.base_spans(text)) is not None


SEEDS = [f"+1 (555) 010-{n}" for n in range(1000, 1008)]


def corpus():
    """Phones after 'call me at', a number that has no plus there, numbers elsewhere, an address in words after 'write to'."""
    rows = [(i, f"Hello, call me at {p} tonight.") for i, p in enumerate(SEEDS)]
    rows += [(20 + i, f"you can write to u{i}@mail.example please") for i in range(8)]
    rows += [(40, "so call me at 555-010-2222 or not"), (41, "then write to jane (at) mail (dot) example now"), (42, "the order number 555-010-2223 is late"), (43, "the order number 888-010-2223 is late")]
    return rows + [(50, None), (51, ""), (None, "so call me at 555-010-2222 or not"), (40, "so call me at 555-010-2222 or not")]


def test_patterns_discover_unseen_identifiers(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in corpus()], "doc_id long, text string, n_email long, found string").repartition(3)
    got = pii.digests(df).collect()
    assert len(got) == len(corpus())
    texts = {d: t or "" for d, t in corpus()}
    for r in got:
        base = literal(texts[r.doc_id])
        listed = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        want = {40: [(14, 3, 26)], None: [(14, 3, 26)], 41: [(14, 0, 42)]}.get(r.doc_id, base)
        assert r.spans == listed(want), r
    assert pii.digests(df.limit(0)).collect() == []


def test_patterns_by_hand(spark):
    """Two rounds over a small graph: what a confident pattern discovers supports the next one; copies count once."""
    edges = [("p", f"s{i}", "number", 0.0, 0.0, 0.0, 1.0) for i in range(6)] + [("p", f"u{i}", "number", 0.0, 0.0, 0.0, 0.0) for i in range(1)]
    edges += [("q", f"s{i}", "number", 0.0, 0.0, 0.0, 1.0) for i in range(6)] + [("q", "u0", "number", 0.0, 0.0, 0.0, 0.0)] + [("few", f"s{i}", "number", 0.0, 0.0, 0.0, 1.0) for i in range(2)]
    edges += [("r", f"s{i}", "number", 0.0, 0.0, 0.0, 1.0) for i in range(4)] + [("r", "u0", "number", 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(edges, "pattern string, instance string, family string, email double, ip double, card double, phone double")
    with Tables(spark) as tables:
        score = lambda rounds: {r.pattern: round(r.phone, 4) for r in pii.score_patterns(df, tables, rounds).collect()}
        assert score(1) == {"p": 0.8, "q": 0.8}
        u0 = 1 - (1 - 0.8) ** 2
        assert score(2) == {"p": round((6 + u0) / 7.5, 4), "q": round((6 + u0) / 7.5, 4), "r": round((4 + u0) / 5.5, 4)}


def test_copies_of_a_text_make_no_pattern(spark):
    rows = [(i, "call me at +1 (555) 010-1000 and reach me via 555-010-7777 now") for i in range(300)]
    rows += [(1000 + i, "reach me via 555-010-8888 now") for i in range(5)]
    got = pii.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.spans for r in got.collect()} == {"phone:11:28", ""} and got.agg(F.count("*")).first()[0] == 305
