"""Directories by recursive query and by prefix sums, against the byte-level code."""

import struct

import pytest
from pyspark.sql import functions as F
from rasterlake.functions import tags as T
from rasterlake.operators import directories as D
from rasterlake.operators.tiff_columns import tiff_tags
from rasterlake.sources import tiff


def chain(order, big, pages, loop=False):
    """A file of directories one behind the other, each with entries (tag, type, count, raw)."""
    head = 16 if big else 8
    sizes = [len(tiff.pack_directory(p, order, 0, big)) for p in pages]
    at = [head + sum(sizes[:i]) for i in range(len(pages))]
    ends = [*at[1:], at[0] if loop else 0]
    magic = next(m for m, v in tiff.MAGICS.items() if v == (order, big))
    start = magic + (struct.pack(order + "HHQ", 8, 0, at[0]) if big else struct.pack(order + "I", at[0]))
    return start + b"".join(tiff.pack_directory(p, order, a, big, e) for p, a, e in zip(pages, at, ends, strict=True))


def exif_file(order="<", big=False):
    """One page with text, a rational and pointers to EXIF and GPS directories behind it."""
    body = [(256, 3, 1, struct.pack(order + "H", 7)), (271, 2, 6, b"maker\0"), (282, 5, 1, struct.pack(order + "II", 300, 1)), (315, 2, 3, b"me\0"), (65000, 99, 1, b"x")]
    inner = {0x8769: [(33434, 5, 1, struct.pack(order + "II", 1, 60)), (36864, 7, 4, b"0231"), (37510, 7, 9, b"a comment")], 0x8825: [(1, 2, 2, b"N\0"), (2, 5, 3, struct.pack(order + "6I", 1, 1, 2, 1, 3, 1))]}
    word, kind = ("Q", 16) if big else ("I", 4)
    base = len(chain(order, big, [sorted(body + [(p, kind, 1, bytes(8 if big else 4)) for p in inner])]))
    base += base % 2
    tail, entries = b"", list(body)
    for p, found in inner.items():
        entries.append((p, kind, 1, struct.pack(order + word, base + len(tail))))
        tail += tiff.pack_directory(found, order, base + len(tail), big)
    first = chain(order, big, [sorted(entries)])
    return first.ljust(base, b"\0") + tail


def files(spark):
    two = [[(256, 3, 1, b"\1\0"), (270, 2, 12, b"long enough\0")], [(257, 4, 1, b"\2\0\0\0")]]
    rows = [chain("<", False, two), chain("<", True, two), chain("<", False, two, loop=True), chain("<", False, two * 60), exif_file("<"), exif_file(">"), exif_file("<", True), exif_file(">", True)]
    rows += [b"II*\0\x08\0\0\0", b"II*\0", b"nothing", b"", None, rows[0][:-5], rows[4][:60], chain("<", False, [[]]), b"II*\0" + struct.pack("<I", 2**32 - 1), b"II+\0" + struct.pack("<HHQ", 8, 0, 2**64 - 1)]
    return spark.createDataFrame(list(enumerate(rows)), "id long, content binary").repartition(3)


KEY = ["id", "page", "dest", "tag", "type", "count", "raw"]


def test_tag_rows_are_those_of_the_bytes(spark):
    df = files(spark).withColumn("after", F.lit("clash")).withColumn("note", F.lit("kept"))
    found = D.tag_rows(df)
    assert "note" in found.columns
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    want = tiff_tags(files(spark)).select("id", "tag.*")
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    got = order(found.select(*KEY).collect())
    assert got == order(want.select(*KEY).collect())
    assert max(r[1] for r in got if r[0] == 3) == 119 and max(r[1] for r in got if r[0] == 2) == 1
    assert D.tag_rows(files(spark).limit(0)).collect() == []


def test_numbers_of_tags(spark):
    found = D.directories(files(spark)).where("id in (4, 5, 6, 7)")
    rows = found.select("id", T.number(F.col("entries"), 256, F.col("little")).alias("w"), T.number(F.col("entries"), 271, F.col("little")).alias("t"), T.number(F.col("entries"), 9, F.col("little")).alias("none")).collect()
    assert sorted(tuple(r) for r in rows) == [(4, 7, None, None), (5, 7, None, None), (6, 7, None, None), (7, 7, None, None)]


def test_exif_blobs_are_those_of_the_bytes(spark):
    df = files(spark)
    got = {r.id: bytes(r.exif) for r in D.exif_blobs(df, "id").collect()}
    want = {}
    for r in df.collect():
        try:
            d, _, big = tiff.first_page(bytes(r.content or b""))
        except tiff.TiffError:
            continue
        if blob := tiff.exif_blob(bytes(r.content), d, big):
            want[r.id] = blob
    assert got == want and set(got) >= {4, 5, 6, 7}


@pytest.mark.parametrize("order", ["<", ">"])
def test_edits_leave_pixels_alone(spark, order):
    pixels = bytes(range(60))
    file = tiff.encode(pixels, 5, 4, "rgb_u8", "deflate") + b"!"
    big = tiff.encode(pixels, 5, 4, "rgb_u8", "lzw", big=True)
    other = exif_file(order)
    df = spark.createDataFrame([(1, file, 0), (2, big, 0), (3, other, 0), (4, file, 0), (5, b"no", 0), (6, None, 0)], "id long, content binary, tag int")
    edits = [(i, 270, 2, 9, b"new text\0") for i in (1, 2, 3, 5, 6, 77)] + [(1, 274, 3, 1, b"\6\0"), (3, 271, 2, 0, None), (3, 282, 5, 1, struct.pack("<II", 72, 1)), (3, 282, 5, 1, struct.pack("<II", 72, 1))]
    got = {r.id: r.content for r in D.edit_tags(df, spark.createDataFrame(edits, "id long, tag int, type int, count long, raw binary"), "id").collect()}
    assert got[4] == file and got[5] == b"no" and got[6] is None
    assert tiff.decode(bytes(got[1]))["pixels"] == pixels and tiff.decode(bytes(got[2]))["pixels"] == pixels
    assert bytes(got[1])[8 : len(file)] == file[8:]
    d = {i: tiff.first_page(bytes(got[i]))[0] for i in (1, 2, 3)}
    assert [d[i].text(270) for i in (1, 2, 3)] == ["new text"] * 3 and d[1].one(274) == 6
    assert d[3].text(271) is None and d[3].pair(282) == (72, 1) and d[3].text(315) == "me"
    assert D._sub is not None and tiff.directory(bytes(got[3]), d[3].one(0x8769), d[3].order) is not None


@pytest.mark.parametrize("order", ["<", ">"])
def test_blobs_are_dealt_over_directories(spark, order):
    blob = exif_file(order)
    pixels = bytes(range(48))
    rows = [(1, tiff.encode(pixels, 4, 4, "rgb_u8", "none"), blob), (2, tiff.encode(pixels, 4, 4, "rgb_u8", "none", big=True), blob), (3, tiff.encode(pixels, 4, 4, "rgb_u8"), b"II*\0bad"), (4, tiff.encode(pixels, 4, 4, "rgb_u8"), None)]
    df = spark.createDataFrame(rows, "id long, content binary, exif binary")
    got = {r.id: bytes(r.content) for r in D.embed_exif(df.select("id", "content"), df.select("id", "exif"), "id").collect()}
    assert got[3] == rows[2][1] and got[4] == rows[3][1]
    want = tiff.decompose_exif(blob)
    for i in (1, 2):
        assert tiff.decode(got[i])["pixels"] == pixels
        d, _, big = tiff.first_page(got[i])
        for pointer, dest in ((0x8769, "exif"), (0x8825, "gps")):
            assert sorted(tiff.directory(got[i], d.one(pointer), "<", big)[0]) == sorted(want[dest])
        assert all(d.entries[e[0]] == e for e in want["ifd0"])


def test_destinations(spark):
    tags = [0xA005, 256, 271, 0x8825, 0x8769, 700, 40000, None]
    got = spark.createDataFrame([(t,) for t in tags], "t int").select(T.exif_destination(F.col("t"))).collect()
    assert [r[0] for r in got] == [None, None, "ifd0", "gps", "exif", "ifd0", "exif", None]
