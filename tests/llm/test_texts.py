"""Tokeniser, trie, packing, language and classifier operators on small inputs."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from rasterlake.llm import byte_bpe, exact_dedup, lang_id, packing, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " a", " a  b", "a\n b", "x  y", "<|endoftext|>", "x" * 3000, "ab" * 2000, "é́" * 50, "It's 1,234 tests\n\n  here", "日本語 text 😀"]


def test_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate([*TEXTS, TEXTS[2]])], "doc_id long, text string, ids string, n_tokens int")
    got = {r.doc_id: r for r in byte_bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate([*TEXTS, TEXTS[2]]):
        ids = want.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    df = df.where(f"doc_id < {len(TEXTS)}")
    for row in byte_bpe.encode(df, PATH, public_tokenizers.PATTERN).collect():
        text = TEXTS[row.doc_id] or ""
        assert row.ids == want.encode_ordinary(text) and bytes(row.decoded) == text.encode()
    assert byte_bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_trie_spills():
    bodies = [f"{i % 37}-{'pq' * (i % 11)}".encode() for i in range(600)]
    for limit in (1 << 30, 3000):
        trie = exact_dedup.OwnerTrie(limit)
        for i, body in enumerate(bodies):
            trie.add(body, body.decode(), (600 - i, 1, 1))
        want = {}
        for i, body in enumerate(bodies):
            want[body.decode()] = (600 - i, want.get(body.decode(), (0, 0))[1] + 1, 1)
        assert dict(trie.owners()) == want


def test_exact(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b"), (5, None), (4, ""), (7, "z"), (7, "z"), (None, "n"), (None, "n"), (9, " a b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sha string").repartition(3)
    got = sorted(exact_dedup.exact_dedup(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.keep_id, r.group_size) for r in got] == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 2), (5, 4, 2), (7, 7, 2), (7, 7, 2), (9, 9, 1), (None, None, 2), (None, None, 2)]
    assert sum(r.kept for r in got) == 5
    assert got[0].text_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert exact_dedup.keep_first(df).columns == df.columns and exact_dedup.keep_first(df).count() == 5


def shuffled(spark, work):
    """The result of ``work`` and how many bytes its stages wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway
    none, numbers = gateway.jvm.java.util.ArrayList(), gateway.new_array(gateway.jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(none, False, False, numbers, none)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    out = work()
    return out, sum(n for stage, n in stages().items() if stage not in before)


def test_kept_rows_are_exchanged_once(spark):
    rng = np.random.default_rng(6)
    texts = [base64.b64encode(rng.bytes(int(rng.integers(1, 30_000)))).decode() for _ in range(200)]
    texts = [*texts, *(f"{t}  " for t in texts[:20]), *(f"{t}\n" for t in texts[10:20])]
    rows = [(1000 - i if i % 7 else None, t, {"a b": [i]}, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `x.y z` map<string, array<int>>, id int").repartition(3).localCheckpoint()
    best = {}
    for row in rows:
        key = " ".join(row[1].split()) + (" " if row[1][-1:].isspace() else "")
        if key not in best or (row[0] is not None and (best[key][0] is None or row[0] < best[key][0])):
            best[key] = row
    size = sum(len(t) for t in texts)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for limit in (128 << 20, 100_000, 1000):
            got, sent = shuffled(spark, lambda limit=limit: exact_dedup.keep_first(df, spill_bytes=limit).collect())
            assert sorted(map(tuple, got), key=str) == sorted(best.values(), key=str)
            assert sent < 1.3 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_trie_of_rows_put_off():
    bodies = [f"{i % 37}-{'pq' * (i % 11)}".encode() for i in range(600)]
    for limit in (1 << 30, 3000, 900):
        trie, first = exact_dedup.OwnerTrie(limit), []
        for i, body in enumerate(bodies):
            if trie.add(body, None, (None, 1, 1), lambda i=i: b"%d" % i):
                first.append(i)
        assert sorted([*first, *map(int, trie.late())]) == [bodies.index(body) for body in dict.fromkeys(bodies)]


def test_one_space():
    for text in ["", " ", "\n\t", "a", " a", "a\r\n", "\x0b\x0ca  b\x1cc\x85d\u00a0\u2003e \t", "a\x00 b"]:
        assert exact_dedup.one_space(text.encode()) == re.sub("[\x20\x09-\x0d]+", " ", text).encode()
    assert exact_dedup.one_space(None) == b""


def test_packing(spark):
    rows = [(i, "w" * (i * 37 % 900), "s0" if i % 3 else None) for i in range(300)] + [(300, "v" * 2500, "s1"), (301, None, "s1"), (302, "w" * 37, "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, capacity=1000, per_source=2, shard_rows=100).collect()
    lengths, bins = {}, {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        bins.setdefault(r.bin_id, []).append(r)
    assert lengths == {i: len(t or "") for i, t, _ in rows}
    texts = {i: t for i, t, _ in rows}
    sources = {i: s for i, _, s in rows}
    for parts in bins.values():
        parts.sort(key=lambda r: (r.offset, r.length))
        assert sum(r.length for r in parts) <= 1000
        assert all(a.offset + a.length <= b.offset for a, b in zip(parts, parts[1:]))
        held = [texts[r.doc_id] for r in parts if texts[r.doc_id]]
        assert len(held) == len(set(held))
        names = [sources[r.doc_id] for r in parts if sources[r.doc_id]]
        assert all(names.count(n) <= 2 for n in names)


def test_language(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "12 !", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.row.doc_id: r for r in lang_id.predict(df, lang_id.learn(df)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_field_marginals():
    rng = np.random.default_rng(2)
    sizes = [1, 4, 2, 7]
    e = rng.standard_normal(sum(sizes))
    moves, start = rng.standard_normal((2, 2)), rng.standard_normal(2)
    first = np.zeros(e.size, bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    q = toxicity.forward_backward(e, first, moves, start)[0]
    at = 0
    for n in sizes:
        total, on = 0.0, np.zeros(n)
        for code in range(2**n):
            tags = [code >> i & 1 for i in range(n)]
            w = np.exp(start[tags[0]] + sum(e[at + i] * t for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            on += w * np.array(tags)
        assert np.allclose(q[at : at + n], on / total)
        at += n


def test_toxic_documents_of_a_small_language(spark):
    rng = np.random.default_rng(6)
    lists = {"a": (300, 60, "abcde"), "z": (60, 6, "uvwxyz")}  # documents, toxic ones, letters
    rows, at = [], 0
    for name, (n, toxic, letters) in lists.items():
        known = ["".join(rng.choice(list(letters), 6)) for _ in range(80)]
        for i in range(n):
            while zlib.crc32(str(at).encode()) % 3 == 1:
                at += 1
            held = list(rng.choice(known, 30))
            if i < toxic:
                held[10:12] = [f"mal{name}on", f"qu{name}erk"]
            rows.append((at, " ".join(held), int(i < toxic), name))
            at += 1
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    for i, text, toxic, name in rows:
        assert (got[i].score >= 0.7) == bool(toxic), name
        assert [text[s.start : s.stop] for s in got[i].spans] == ([f"mal{name}on qu{name}erk"] if toxic else [])


def test_toxic_markers_scale():
    def marked(factor):
        counts = np.zeros((2, toxicity.BUCKETS), np.int64)
        counts[:, :3000] = [[2 * factor], [0]]  # features of others only
        counts[:, 3000] = 0, 6
        counts[:, 3001] = 0, 2
        counts[:, 3002] = 9 * factor, 9 * factor
        return toxicity.markers(counts, np.array([900 * factor, 100 * factor]))[3000:3003].tolist()

    assert marked(1) == marked(4) == [True, False, False]
