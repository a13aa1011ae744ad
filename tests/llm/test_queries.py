"""Every registered query once, against its SQL where it has any; what operators leave behind; helpers."""

import gc
import os
import time
from types import SimpleNamespace

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F
from rasterlake.llm import chat_format, common, exact_dedup, packing, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sql, name):
    got = queries.QUERIES[name](spark, FOLDER)
    want = sql.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    key = lambda row: tuple(str(v) for v in row)
    left = sorted((tuple(r[c] for c in order) for r in got.collect()), key=key)
    right = sorted(want.project(", ".join(f'"{c}"' for c in order)).fetchall(), key=key)
    assert left == right


def test_the_other_queries(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLES)):
        found = queries.QUERIES[name](spark, FOLDER)
        ids = found.select("doc_id").distinct().count()
        assert ids == n and (name == "op8_best_fit_packing" or found.count() == n), name


def left_behind(spark):
    """Tables of operators in the checkpoint folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(common.ensure_checkpoints(spark))
    return [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.getPath().getName().startswith("table-")]


def test_results_outlive_other_operators(spark):
    names = ("op2_embedding_near_dedup", "op6_suffix_array_dedup", "op8_best_fit_packing", "op10_ngram_join")
    before = left_behind(spark)
    made = {name: queries.QUERIES[name](spark, FOLDER) for name in names}
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert set(left_behind(spark)) <= set(before)
    assert all(df.count() > 0 for df in made.values())


def checkpoints(spark):
    """Checkpoints of this context that are there after both collections of garbage."""
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)
    path = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return {s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}


def test_only_the_result_is_left(spark):
    common.ensure_checkpoints(spark)
    before = checkpoints(spark)
    for name in ("op2_embedding_near_dedup", "op10_ngram_join", "op11_source_divergence"):
        found = queries.QUERIES[name](spark, FOLDER)
        n = found.count()
        assert len(checkpoints(spark) - before) <= 1 and found.count() == n, name
        del found
        assert checkpoints(spark) <= before, name


def test_no_folder_that_others_cannot_see():
    empty = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: empty))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="share"):
        common.ensure_checkpoints(session)
    session.conf = SimpleNamespace(get=lambda name, default: "s3a://bucket/x/")
    assert common.ensure_checkpoints(session) == "s3a://bucket/x"


def test_joins_of_hot_keys(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k long, v long").repartition(4)
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("c"), F.max("v").alias("m"))
    key = lambda df: sorted(map(str, df.select("k", "v", "m").collect()))
    for limit in (10, 1000):
        assert key(common.left_join_salted(left, right, "k", "c", limit, ["v"])) == key(left.join(right.drop("c"), "k", "left"))
        assert key(common.join_counted(left, right, "k", "c", limit)) == key(left.join(right.drop("c"), "k"))


def tightest(rows, capacity, per_source):
    """(doc_id, part) -> bin, by trying every bin."""
    bins, out, full = [], [], 0
    for doc, length, source, cluster in sorted(rows, key=lambda r: (-r[1], r[0] is None, str(r[0]))):
        start = 0
        while length - start > capacity:
            out.append((doc, start, f"w{full}"))
            full, start = full + 1, start + capacity
        rest = length - start
        fits = [(capacity - sum(n for n, *_ in b) - rest, i) for i, b in enumerate(bins) if sum(n for n, *_ in b) + rest <= capacity and (source is None or [s for _, s, _ in b].count(source) < per_source) and (cluster is None or cluster not in [c for *_, c in b])]
        if not fits:
            bins.append([])
            fits = [(0, len(bins) - 1)]
        bins[min(fits)[1]].append((rest, source, cluster))
        out.append((doc, start, str(min(fits)[1])))
    return out


def test_packing_takes_the_tightest_bin(spark):
    rows = [(i, "xyz"[i % 3] * (i * 53 % 240) + str(i % 50), ["a", "b", None][i * i % 3]) for i in range(160)] + [(900, "w" * 555, "a"), (901, None, "a"), (902, "", None)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, source string, shard int, row int").repartition(3)
    got = packing.pack(df, capacity=200, per_source=2, shard_rows=1000).collect()
    want = tightest([(i, len(t or ""), s, t or None) for i, t, s in rows], 200, 2)
    assert sorted((r.doc_id, r.start, r.bin_id.split("-")[1]) for r in got) == sorted(want)


def test_packing_deals_equal_rows(spark):
    rows = [(None, "same", "a")] * 300 + [(7, "same", "a")] * 300 + [(None, "b", None), (8, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, capacity=10, shard_rows=20).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 301
    per_bin = {}
    for r in got:
        per_bin.setdefault(r.bin_id, []).append(r.length)
    assert all(lengths.count(4) <= 1 for lengths in per_bin.values())
    assert packing.pack(df.limit(0)).collect() == []


def test_preferences_defined_results(spark):
    big = 18014398509481987
    rows = [(0, 1, "user", "hi"), (0, 2, "assistant", "yo"), (1, 1, "user", "hi"), (1, 2, "assistant", "no"), (1, 3, None, None), (5, 2, "assistant", "alone"), (5, 1, "user", "q"), (None, 1, "user", "lost"), (big, 1, "user", "x"), (big - 1, 1, "user", "x"), (8, 1, "b", "2"), (8, 1, "a", "1"), (8, None, "user", "first"), (-1, 1, "user", "n")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, pair_id long").repartition(3)
    got = {r.pair_id: r for r in chat_format.preferences(chat_format.neighbour_pairs(df)).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert set(got) == {0, 2, 4, big // 2, -1}
    assert (got[0].n_common, got[0].prompt, got[0].chosen, got[0].rejected) == (1, turn("user", "hi"), turn("assistant", "yo"), turn("assistant", "no") + turn("", ""))
    assert [got[0].chosen[s.start : s.end] for s in got[0].chosen_mask] == ["yo"] and [got[0].rejected[s.start : s.end] for s in got[0].rejected_mask] == ["no"]
    assert (got[2].chosen, got[2].rejected, got[2].n_common) == ("", turn("user", "q") + turn("assistant", "alone"), 0)
    assert got[4].chosen == turn("user", "first") + turn("a", "1") + turn("b", "2") and got[4].rejected == ""
    assert (got[big // 2].prompt, got[big // 2].chosen) == (turn("user", "x"), "") and got[-1].rejected == turn("user", "n")
    assert chat_format.preferences(chat_format.neighbour_pairs(df.limit(0))).collect() == []


def test_exact_dedup_of_very_long_texts_and_none(spark):
    long = "word " * 400_000
    df = spark.createDataFrame([(3, long), (2, long.replace(" ", "\n")), (1, long + "x"), (1, long + "x")], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, spill_bytes=1000).collect())
    assert got == [(1, 1, 2, False), (1, 1, 2, True), (2, 2, 2, True), (3, 2, 2, False)]
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == [] and exact_dedup.keep_first(df.limit(0)).collect() == []
