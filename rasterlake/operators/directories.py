"""TIFF directories as relations: pages by a recursive query, tags as rows, directories written by prefix sums.

Reading: page 0 of a file is a projection; only files with more pages enter a recursive
query, so files of one page are never exchanged. Writing: the tags of an image are rows; the
offsets of values that don't fit their entry are running sums over them, and an ordered
aggregation gives the bytes. Editing joins tags with changes and appends a directory to the
file, whose pixels stay where they are. No Python runs in any of it.

Defined results: null content, and content without a TIFF header, gives no rows; the chain of
pages ends at the first directory that doesn't fit the file or was there already; keys must be
unique and not null where a function says so; empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags as T
from ..plans.dimensions import DESCRIPTIVE

#: A recursive query stops with an error beyond these many pages of a file.
MOST_PAGES = 100_000


def directories(df: DataFrame, content: str = "content", first_only: bool = False) -> DataFrame:
    """One row for every page: the columns of ``df``, then page, entries, little, big, after (the next directory's offset).

    Column names of ``df`` that clash with the new ones are replaced. With ``first_only`` a
    projection gives the first pages, and nothing is chained.
    """
    data = F.col(content)
    taken = ["page", "entries", "little", "big", "after", "_at", "_n", "_seen"]
    # What a generator gives is evaluated once, whatever the expressions behind ``content`` and however often it is named below.
    head = F.struct(data.alias("content"), T.is_little(data).alias("little"), T.is_big(data).alias("big"), T.first_directory(data).alias("at"))
    rest = [f"`{c}`" for c in df.columns if c not in [*taken, content]]
    first = df.select(*rest, F.explode(F.array(head)).alias("_head")).select(*rest, F.col("_head.content").alias(content), "_head.little", "_head.big", F.col("_head.at").alias("_at"))
    first = first.withColumn("_n", T.directory_length(data, F.col("_at"), F.col("little"), F.col("big"))).where("_n is not null")
    first = first.withColumn("page", F.lit(0)).withColumn("after", F.coalesce(_after(data), F.lit(0)))
    found = T.entries(data, F.col("_at"), F.col("_n"), F.col("little"), F.col("big"))
    keep = [f"`{c}`" for c in df.columns if c not in taken]
    if first_only:
        return first.withColumn("entries", found).select(*keep, "page", "entries", "little", "big", "after")
    start = first.where("after > 0").withColumn("_seen", F.array("_at"))
    name = f"pages_{uuid.uuid4().hex}"
    start.createOrReplaceTempView(name)
    shared = ", ".join([*keep, "little", "big"])
    sql = f"""
with recursive chain({shared}, _at, _n, page, after, _seen) max recursion level {MOST_PAGES} as (
  select {shared}, _at, _n, page, after, _seen from {name}
  union all
  select {shared}, after, _m, page + 1, coalesce(_next, 0), array_append(_seen, after) from (
    select *, {_sql_word("after + if(big, 8 + _m * 20, 2 + _m * 12)", content)} as _next from (
      select *, {_sql_length("after", content)} as _m from chain where after > 0 and not array_contains(_seen, after)
    ) where _m is not null
  )
)
select {shared}, _at, _n, page, after from chain where page > 0
"""
    session = df.sparkSession
    # The limit of rows is for queries that never end; this one ends with the pages of the files.
    session.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    rest = session.sql(sql)
    both = first.select(*keep, "little", "big", "_at", "_n", "page", "after").unionByName(rest)
    return both.withColumn("entries", found).select(*keep, "page", "entries", "little", "big", "after")


def _after(data: Column) -> Column:
    return T.next_directory(data, F.col("_at"), F.col("_n"), F.col("little"), F.col("big"))


def _sql_unsigned(at: str, size: str, content: str) -> str:
    """:func:`~rasterlake.functions.tags.unsigned` as SQL text, which a recursive query takes."""
    turned = "if(little, regexp_replace(reverse(d), '(.)(.)', '$2$1'), d)"
    return f"get(transform(array(hex(substr(`{content}`, try_cast({at} + 1 as int), {size}))), d -> if(length(d) = 2 * {size}, try_cast(conv({turned}, 16, 10) as bigint), null)), 0)"


def _sql_word(at: str, content: str) -> str:
    return _sql_unsigned(at, "if(big, 8, 4)", content)


def _sql_length(at: str, content: str) -> str:
    n = _sql_unsigned(at, "if(big, 8, 2)", content)
    return f"get(transform(array({n}), n -> if(n >= 0 and n <= (length(`{content}`) - {at} - if(big, 8, 2)) / if(big, 20, 12), n, null)), 0)"


def _sub(found: Column, pointer: int, content: str, types: tuple[int, ...]) -> Column:
    """The entries that a pointer of one of the field types leads to; none where it leads nowhere."""
    little, big, data = F.col("little"), F.col("big"), F.col(content)
    at = T.number(F.filter(found, lambda e: (e["tag"] != pointer) | e["type"].isin(*types)), pointer, little)
    inner = T.let(at, lambda at: T.let(T.directory_length(data, at, little, big), lambda n: T.entries(data, at, n, little, big)))
    return F.coalesce(inner, F.array().cast(T.ENTRIES))


def tag_rows(df: DataFrame, content: str = "content", pointer_types: tuple[int, ...] = (1, 3, 4, 7, 13, 16, 18), first_only: bool = False) -> DataFrame:
    """One row for every tag of every page and of its EXIF and GPS directories: the columns of ``df``, page, dest, tag, type, count, raw.

    Pointers of other field types than ``pointer_types`` aren't followed.
    """
    pages = directories(df, content, first_only)
    dealt = lambda dest, found: F.transform(found, lambda e: F.struct(F.lit(dest).alias("dest"), e["tag"].alias("tag"), e["type"].alias("type"), e["count"].alias("count"), e["raw"].alias("raw")))
    inner = pages.withColumns({"_exif": _sub(F.col("entries"), T.EXIF_POINTER, content, pointer_types), "_gps": _sub(F.col("entries"), T.GPS_POINTER, content, pointer_types)})
    every = F.concat(dealt("ifd0", F.col("entries")), dealt("exif", F.col("_exif")), dealt("gps", F.col("_gps")))
    keep = [f"`{c}`" for c in pages.columns if c not in ("entries", "little", "big", "after")]
    return inner.select(*keep, F.explode(every).alias("_tag")).select(*keep, "_tag.*")


def pack(rows: DataFrame, key: str, base: str = "base") -> DataFrame:
    """(key, directory, ifd_at): the bytes of an image's directories, written one behind the other from offset ``base`` on.

    ``rows`` has key, base, little, big, part, tag, type, count, raw (in the file's byte
    order), points_to and after. Directories of an image are its parts in order; a row with ``points_to`` is
    written as the offset of that part, which comes earlier; ``after`` is the offset that
    ends the last part (0: no further page). ``ifd_at`` is where the last part stands. All
    tags of an image meet in one task; images are spread by key.
    """
    little, big = F.col("little"), F.col("big")
    head, slot, inline = F.when(big, 8).otherwise(2), F.when(big, 20).otherwise(12), F.when(big, 8).otherwise(4)
    image, part = Window.partitionBy(key), Window.partitionBy(key, "part")
    ordered = part.orderBy("tag", "type", "raw")
    size = F.when(F.col("points_to").isNotNull(), inline).otherwise(F.length("raw"))
    own = rows.withColumn("_pool", F.when(size > inline, size + size % 2).otherwise(0)).withColumn("_rank", F.row_number().over(ordered))
    own = own.withColumn("_n", F.count("*").over(part)).withColumn("_before", F.sum("_pool").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    own = own.withColumn("_size", F.when(F.col("_rank") == 1, head + F.col("_n") * slot + inline + F.sum("_pool").over(part)).otherwise(0))
    # A part stands behind all earlier ones.
    own = own.withColumn("_at", F.col(base) + F.coalesce(F.sum("_size").over(image.orderBy("part").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("_last", F.max("part").over(image)).withColumn("_ends", F.map_from_entries(F.collect_set(F.struct("part", "_at")).over(image)))
    value = F.when(F.col("points_to").isNotNull(), _word_hex(F.element_at("_ends", F.col("points_to")), little, big))
    value = value.when(size > inline, _word_hex(F.col("_at") + head + F.col("_n") * slot + inline + F.coalesce("_before", F.lit(0)), little, big))
    value = value.otherwise(F.rpad(F.hex("raw"), F.when(big, 16).otherwise(8), F.lit("0")))
    line = F.concat(T.as_hex(F.col("tag"), 2, little), T.as_hex(F.col("type"), 2, little), _word_hex(F.col("count"), little, big), value)
    pool = F.when(F.col("_pool") > 0, F.rpad(F.hex("raw"), (2 * F.col("_pool")).cast("int"), F.lit("0"))).otherwise("")
    lines = own.groupBy(key, "part", "little", "big").agg(
        F.first("_at").alias("_at"), F.count("*").alias("_n"), F.max("_last").alias("_last"), F.max("after").alias("after"),
        F.array_sort(F.collect_list(F.struct(F.col("_rank").alias("rank"), line.alias("line"), pool.alias("pool")))).alias("rows"),
    )
    start = F.when(big, T.as_hex(F.col("_n"), 8, little)).otherwise(T.as_hex(F.col("_n"), 2, little))
    end = _word_hex(F.when(F.col("part") == F.col("_last"), F.coalesce("after", F.lit(0))).otherwise(0), little, big)
    digits = F.concat(start, F.array_join("rows.line", ""), end, F.array_join("rows.pool", ""))
    parts = lines.select(key, F.struct("part", digits.alias("digits"), "_at").alias("p"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return whole.select(key, F.unhex(F.array_join("ps.digits", "")).alias("directory"), F.element_at("ps", -1)["_at"].alias("ifd_at"))


def _word_hex(value: Column, little: Column, big: Column) -> Column:
    return F.when(big, T.as_hex(value, 8, little)).otherwise(T.as_hex(value, 4, little))


def _rows(little: Column, big: Column, base: Column, part: int, *more: Column) -> list[Column]:
    return [little.alias("little"), big.alias("big"), base.alias("base"), F.lit(part).alias("part"), *more]


def _no_part() -> Column:
    return F.lit(None).cast("int").alias("points_to")


def exif_blobs(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, exif): the descriptive tags and those of the EXIF directory of each file's first page, as a TIFF of their own.

    ``key`` is unique. Files without such tags give no row.
    """
    tags = tag_rows(df.select(key, F.col(content).alias("content"), T.is_little(F.col(content)).alias("order")), pointer_types=(3, 4, 13, 18), first_only=True)
    found = tags.where(((F.col("dest") == "exif") | ((F.col("dest") == "ifd0") & F.col("tag").isin(*[t for t in DESCRIPTIVE if t != 0x02BC]))))
    first = Window.partitionBy(key, "dest", "tag").orderBy("type", "raw")
    found = found.withColumn("_k", F.row_number().over(first)).where((F.col("dest") == "exif") | (F.col("_k") == 1))
    rows = found.select(key, *_rows(F.col("order"), F.lit(False), F.lit(8), 0, F.col("tag"), F.col("type"), F.col("count"), F.col("raw"), _no_part(), F.lit(0).cast("bigint").alias("after")))
    little = rows.select(key, "little").distinct()
    head = F.when(F.col("little"), F.lit(bytes.fromhex("49492A0008000000"))).otherwise(F.lit(bytes.fromhex("4D4D002A00000008")))
    return pack(rows, key).join(little, key).select(key, F.concat(head, "directory").alias("exif"))


def edit_tags(files: DataFrame, edits: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``files`` (key, content) with tags of the first page changed: ``edits`` has key, tag, type, count and raw.

    Raw values are little-endian, whatever the file's order; a null raw removes the tag. Later
    pages stay chained. The new directory is appended and the header led to it; pixels and all
    else stay where they are. Files without edits, and those that aren't TIFF, stay as they
    are; edits of unknown keys are ignored. ``key`` is unique in ``files``.
    """
    slim = files.select(key, F.col(content).alias("content"))
    asked = edits.select(key, "tag", "type", "count", "raw").dropDuplicates([key, "tag"])
    touched = slim.join(asked.select(key).distinct(), key, "left_semi")
    pages = directories(touched, first_only=True).withColumn("base", F.length("content") + F.length("content") % 2)
    pages = pages.select(key, "entries", "little", "big", "after", F.col("base").cast("bigint").alias("base"))
    kept = pages.select(key, "little", "big", "base", "after", F.explode("entries").alias("e")).select(key, "little", "big", "base", "after", "e.*").join(asked.select(key, "tag"), [key, "tag"], "left_anti")
    added = pages.drop("entries").join(asked.where("raw is not null"), key).withColumn("raw", F.when(F.col("little"), F.col("raw")).otherwise(T.swapped(F.col("raw"), F.col("type"))))
    rows = kept.unionByName(added).withColumn("part", F.lit(0)).withColumn("points_to", _no_part())
    return _appended(files, pack(rows, key), key, content)


def _appended(files: DataFrame, packed: DataFrame, key: str, content: str) -> DataFrame:
    """Files with their directories behind them and the header leading to the last one."""
    data = F.col(content)
    little, big = T.is_little(data), T.is_big(data)
    pad = F.when(F.length(data) % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b""))
    head = F.when(big, F.concat(F.substr(data, F.lit(1), F.lit(8)), F.unhex(T.as_hex(F.col("ifd_at"), 8, little)), F.substr(data, F.lit(17), F.length(data))))
    head = head.otherwise(F.concat(F.substr(data, F.lit(1), F.lit(4)), F.unhex(T.as_hex(F.col("ifd_at"), 4, little)), F.substr(data, F.lit(9), F.length(data))))
    joined = files.join(packed, key, "left")
    return joined.withColumn(content, F.when(F.col("directory").isNull(), data).otherwise(F.concat(head, pad, "directory"))).drop("directory", "ifd_at")


def embed_exif(files: DataFrame, blobs: DataFrame, key: str, content: str = "content", exif: str = "exif") -> DataFrame:
    """``files`` (key, content) with the tags of an EXIF blob (key, exif) dealt over the first page and its EXIF and GPS directories.

    Structural tags and the interoperability pointer are dropped, tags that the page has
    stay as they are. A malformed blob changes nothing. Both keys are unique.
    """
    blob = directories(blobs.select(key, F.col(exif).alias("content")), first_only=True).where("not big").withColumn("blob_little", F.col("little"))
    inner = blob.withColumns({"_exif": _sub(F.col("entries"), T.EXIF_POINTER, "content", (3, 4)), "_gps": _sub(F.col("entries"), T.GPS_POINTER, "content", (3, 4))})
    of = lambda dest, found: F.transform(found, lambda e: F.struct(F.lit(dest).alias("dest"), e["tag"].alias("tag"), e["type"].alias("type"), e["count"].alias("count"), e["raw"].alias("raw")))
    flat = F.filter("entries", lambda e: ~e["tag"].isin(T.EXIF_POINTER, T.GPS_POINTER))
    every = F.concat(of(None, flat), of("exif", F.col("_exif")), of("gps", F.col("_gps")))
    dealt = inner.select(key, "blob_little", F.explode(every).alias("e")).select(key, "blob_little", "e.*")
    dealt = dealt.where(F.col("tag") != T.INTEROPERABILITY).withColumn("dest", F.coalesce("dest", T.exif_destination(F.col("tag")))).where("dest is not null and type <= 12")
    slim = files.select(key, F.col(content).alias("content"))
    pages = directories(slim.join(dealt.select(key).distinct(), key, "left_semi"), first_only=True)
    pages = pages.select(key, "entries", "little", "big", "after", (F.length("content") + F.length("content") % 2).cast("bigint").alias("base"))
    plain = _no_part()
    own = pages.select(key, "little", "big", "base", "after", F.explode(F.filter("entries", lambda e: ~e["tag"].isin(T.EXIF_POINTER, T.GPS_POINTER))).alias("e")).select(key, "little", "big", "base", "after", "e.*")
    number = F.when(F.col("dest") == "exif", 0).when(F.col("dest") == "gps", 1).otherwise(2)
    raw = F.when(F.col("little") == F.col("blob_little"), F.col("raw")).otherwise(T.swapped(F.col("raw"), F.col("type")))
    new = dealt.join(pages.drop("entries"), key).select(key, "little", "big", "base", "after", "tag", F.when(F.col("type") == 7, 1).otherwise(F.col("type")).alias("type"), "count", raw.alias("raw"), number.alias("part"), plain)
    new = new.where("part < 2").unionByName(new.where("part = 2").join(own.select(key, "tag"), [key, "tag"], "left_anti"))
    wide = F.when(F.col("big"), 16).otherwise(4)
    pointer = F.when(F.col("part") == 0, T.EXIF_POINTER).otherwise(T.GPS_POINTER)
    leads = new.where("part < 2").select(key, "little", "big", "base", "after", "part").distinct()
    leads = leads.select(key, "little", "big", "base", "after", pointer.alias("tag"), wide.alias("type"), F.lit(1).cast("bigint").alias("count"), F.lit(b"").alias("raw"), F.lit(2).alias("part"), F.col("part").alias("points_to"))
    rows = own.withColumn("part", F.lit(2)).withColumn("points_to", _no_part()).unionByName(new).unionByName(leads)
    return _appended(files, pack(rows, key), key, content)
