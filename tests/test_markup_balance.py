"""Markup by tokens, samples of odd depths, partitions by cost: against plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from rasterlake.functions import limits as L
from rasterlake.operators import balance as B
from rasterlake.operators import markup as M
from rasterlake.sources import svg


def documents():
    rng = random.Random(4)
    pieces = ["<a>", "</a>", "<b c='>'>", "</b>", "<metadata>", "</metadata>", "<x:desc>", "</x:desc>", "<title/>", "<!-- <a> -->", "<?p?>", "<?xml v?>", " text ", "\n", "<![CDATA[</a>]]>", "<!DOCTYPE a [<!ENTITY b '>'>]>", "é"]
    out = ["", "<", "a<b", "<a/>", "<a></a >", "<desc>x<desc>y</desc>z</desc>w", "</a>", "<a", "<a><b></a></b>", "<desc/>q", " <a> b </a> "]
    for _ in range(400):
        depth, text = [], ""
        for _ in range(rng.randrange(14)):
            p = rng.choice(pieces)
            if p.startswith("</"):
                p = f"</{depth.pop()}>" if depth and rng.random() < 0.95 else p
            elif p[1:2].isalpha() and p[0] == "<" and not p.endswith("/>"):
                depth.append(p[1:-1].split()[0])
            text += p
        out.append(text + "".join(f"</{d}>" for d in reversed(depth)) if rng.random() < 0.9 else text)
    return out


@pytest.mark.parametrize("options", [{}, {"comments": False, "instructions": False, "whitespace": False, "dropped": ()}])
def test_minified_as_by_hand(spark, options):
    texts = documents()
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, text string").withColumn("at", F.lit(0)).repartition(4)
    got = {r.id: (r.text, r.error) for r in M.minify(df, "id", **options).collect()}
    assert got.pop(-1) == (None, None)
    off = {"comments": False, "instructions": False, "whitespace": False, "metadata": False, "descriptions": False, "titles": False} if options else {}
    for i, text in enumerate(texts):
        try:
            want = svg.minify(text.encode(), **off).decode(), None
        except svg.SourceError as error:
            want = None, error.kind
        assert got[i] == want, text
    assert M.minify(df.limit(0), "id").collect() == []


def test_long_tags_and_texts(spark):
    text = "<a " + " ".join(f'b{i}="<{i}>"' for i in range(20_000)) + ">" + "word " * 100_000 + "<!--" + "-" * 100_000 + "--></a>"
    got = M.minify(spark.createDataFrame([(1, text)], "id long, text string"), "id").first()
    assert got.error is None and got.text == svg.minify(text.encode()).decode()


def test_samples_of_every_depth(spark):
    rng = random.Random(1)
    rows = []
    for bits in range(1, 17):
        for per_row, lines in ((1, 1), (3, 2), (7, 3)):
            rows.append((bits, per_row, lines, rng.randbytes(-(-per_row * bits // 8) * lines)))
    bad = [(0, 1, 1, b"x"), (17, 1, 1, b"xxx"), (8, 2, 1, b"x"), (8, 0, 1, b"x"), (8, 1, 0, b"x"), (8, 1, 1, None)]
    df = spark.createDataFrame(rows + bad, "bits int, per_row int, lines int, content binary")
    got = df.select("*", L.packed_samples(F.col("content"), F.col("bits"), F.col("per_row"), F.col("lines")).alias("s")).collect()
    for r in got[: len(rows)]:
        stride, want = len(r.content) // r.lines, []
        for y in range(r.lines):
            line = "".join(f"{b:08b}" for b in r.content[y * stride : (y + 1) * stride])
            want += [int(line[i * r.bits : (i + 1) * r.bits], 2) for i in range(r.per_row)]
        assert r.s == want
    assert [r.s for r in got[len(rows) :]] == [None] * len(bad)


def test_partitions_stay_under_the_bound(spark):
    rng = random.Random(7)
    costs = [rng.choice([0, 1, 5, 60, 99, 100, 350]) for _ in range(3000)] + [None, -5]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(costs)], "id long, cost long").repartition(5)
    out = B.balanced(df, F.col("cost"), 100, buckets=16)
    got = out.select("id", "cost", F.spark_partition_id().alias("p")).collect()
    assert sorted(r.id for r in got) == list(range(len(costs)))
    held = {}
    for r in got:
        held.setdefault(r.p, []).append(max(r.cost or 0, 0))
    assert all(sum(x) <= 100 or sum(1 for v in x if v) == 1 for x in held.values())
    assert len(held) <= 2 * sum(max(c or 0, 0) for c in costs) / 100 + 2
    assert B.balanced(df.limit(0), F.col("cost"), 100).collect() == []
    with pytest.raises(ValueError, match="at least 1"):
        B.placed(df, F.col("cost"), 0)
