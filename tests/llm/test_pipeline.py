"""The corpus pipeline against brute force over a small table."""

import random
import re

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def shingles(text):
    found = re.findall(r"[^ \t-\r]+", text.lower())
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def brute(rows):
    """Length in bytes of each document that is left, by id."""
    left = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    owner = {}
    for i in sorted(left):
        owner.setdefault(re.sub(r"[ \t-\r]+", " ", left[i]), i)
    left = {i: left[i] for i in owner.values()}
    sets = {i: shingles(t) for i, t in left.items()}
    group = {i: i for i in left}
    for a in sorted(left):
        for b in sorted(left):
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    left = {i: t for i, t in left.items() if group[i] == i}
    starts = {}
    for i, t in left.items():
        for at in range(len(t) - 399):
            starts[t[at : at + 400]] = starts.get(t[at : at + 400], 0) + 1
    out = {}
    for i, t in left.items():
        gone = set()
        for at in range(len(t) - 399):
            if starts[t[at : at + 400]] > 1:
                gone.update(range(at, at + 400))
        rest = "".join(c for at, c in enumerate(t) if at not in gone)
        if rest.strip(" "):
            out[i] = len(rest)
    return out


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    passage = words(rng, 120)
    texts = [None, "", "12 34 !", "short", "short ", words(rng, 4000)]
    texts += [words(rng, rng.randint(20, 200)) for _ in range(30)]
    texts += [texts[8], texts[8].replace(" ", "\n"), texts[9] + " one", "one " + texts[10], texts[11].upper()]
    texts += [words(rng, 60) + " " + passage + " " + words(rng, 60) for _ in range(4)]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "a", "b", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    lengths, bins = {}, {}
    for row in corpus_pipeline.run(spark, str(tmp_path)).collect():
        lengths[row.doc_id] = lengths.get(row.doc_id, 0) + row.length
        bins[row.bin_id] = bins.get(row.bin_id, 0) + row.length
    want = brute(rows)
    assert lengths == want
    assert len(want) < len(rows) - 7 and sum(want.values()) < sum(len(texts[i]) for i in want)
    assert max(bins.values()) <= 16384


def spaced(rng, text):
    return re.sub(" ", lambda _: rng.choice([" ", " ", "\n", "  "]), text)


def without_passages(text, others):
    """``text`` without the words of windows of 51 words that are elsewhere, as a list of words."""
    own = text.split()
    seen = {}
    for t in [text, *others]:
        parts = t.split()
        for i in range(len(parts) - 50):
            seen[tuple(parts[i : i + 51])] = seen.get(tuple(parts[i : i + 51]), 0) + 1
    gone = set()
    for i in range(len(own) - 50):
        if seen[tuple(own[i : i + 51])] > 1:
            gone.update(range(i, i + 51))
    return [w for i, w in enumerate(own) if i not in gone]


def test_passages_of_over_fifty_words(spark):
    rng = random.Random(8)
    short = lambda n: " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 3))) for _ in range(n))
    passages = [f"{i}p {words(rng, n - 2)} p{i}" for i, n in enumerate((50, 51, 52, 55, 58, 60))] + [f"s {short(49)} s"]
    texts = []
    for i, passage in enumerate(passages):
        for k in range(2 + i % 2):
            texts.append(f"{i}a{k} {words(rng, rng.randint(5, 90))} {i}b{k} {spaced(rng, passage) if i == 4 else passage} {i}c{k} {words(rng, rng.randint(5, 90))}")
    texts += [f"0a9 {passages[5]} x9 {passages[3]}", "\n" + passages[2] + "\n", None, "", " \n", f"t {passages[1]} u {passages[1]} v"]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(3)
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    for i, t in enumerate(texts):
        want = without_passages(t or "", [o for j, o in enumerate(texts) if j != i and o])
        if (t or "").split() and not want:
            assert i not in got
        elif t is None:
            assert got[i].text is None
        else:
            assert got[i].text.split() == want and got[i].n_chars == len(got[i].text)
    assert passages[0] in got[0].text and passages[1] not in got[2].text


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
