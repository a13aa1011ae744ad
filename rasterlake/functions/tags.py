"""TIFF directories as Column expressions over bytes: headers, entries, tag values, EXIF routing.

All of it stays in the JVM. Entries are ``array<struct<tag, type, count, raw>>`` in file
order, raw values in the byte order of the file; entries of unknown types and those whose
values lie outside the file are left out, and a directory that doesn't fit the file is null.
Nulls give nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.dimensions import DESCRIPTIVE, STRUCTURAL

#: Bytes of a value of each field type from 0 (unknown) to 18, and of the units that byte order concerns.
TYPE_BYTES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8, 4, 0, 0, 8, 8, 8)
UNIT_BYTES = (1, 1, 1, 2, 4, 4, 1, 1, 2, 4, 4, 4, 8, 4, 1, 1, 8, 8, 8)
EXIF_POINTER, GPS_POINTER, INTEROPERABILITY = 0x8769, 0x8825, 0xA005
ENTRIES = "array<struct<tag:int,type:int,count:bigint,raw:binary>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it; plans stay small by it."""
    return F.get(F.transform(F.array(value), body), 0)


def _ordered(digits: Column, little: Column) -> Column:
    """Hexadecimal digits of bytes, turned round if ``little``."""
    return F.when(little, F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")).otherwise(digits)


def unsigned(content: Column, at: Column, size: Column, little: Column) -> Column:
    """The number of ``size`` bytes at an offset as a bigint; null beyond the end or the type."""
    digits = F.hex(F.substr(content, (at + 1).try_cast("int"), size))
    return let(digits, lambda d: F.when(F.length(d) == 2 * size, F.conv(_ordered(d, little), 16, 10).try_cast("bigint")))


def _by(big: Column, wide: int, narrow: int) -> Column:
    return F.when(big, wide).otherwise(narrow)


def as_hex(value: Column, size: int, little: Column) -> Column:
    """A number as hexadecimal digits of ``size`` bytes."""
    return _ordered(F.lpad(F.hex(value), 2 * size, "0"), little)


def is_little(content: Column) -> Column:
    return F.substr(content, F.lit(1), F.lit(2)) == F.lit(b"II")


def is_big(content: Column) -> Column:
    """Whether offsets have 64 bits; null for what has no TIFF header."""
    magic = F.hex(F.substr(content, F.lit(1), F.lit(4)))
    return F.when(magic.isin("49492A00", "4D4D002A"), False).when(magic.isin("49492B00", "4D4D002B"), True)


def word(content: Column, at: Column, little: Column, big: Column) -> Column:
    """An offset or count of the file's width."""
    return unsigned(content, at, _by(big, 8, 4), little)


def first_directory(content: Column) -> Column:
    """Offset of the first directory; null without a header."""
    big = is_big(content)
    return let(big, lambda big: F.when(big.isNotNull(), word(content, _by(big, 8, 4), is_little(content), big)))


def directory_length(content: Column, at: Column, little: Column, big: Column) -> Column:
    """Entries that a directory says it has, if they fit the file."""
    n = unsigned(content, at, _by(big, 8, 2), little)
    return F.when(at > 0, let(n, lambda n: F.when((n >= 0) & (n <= (F.length(content) - at - _by(big, 8, 2)) / _by(big, 20, 12)), n)))


def next_directory(content: Column, at: Column, n: Column, little: Column, big: Column) -> Column:
    """Where the directory after this one stands; 0 or null where the chain ends."""
    return word(content, at + F.when(big, 8 + n * 20).otherwise(2 + n * 12), little, big)


def entries(content: Column, at: Column, n: Column, little: Column, big: Column) -> Column:
    """The entries of a directory of ``n``; null where ``n`` is."""
    head, size, inline = _by(big, 8, 2), _by(big, 20, 12), _by(big, 8, 4)
    sizes, two = F.array(*map(F.lit, TYPE_BYTES)), F.lit(2)

    def slot(place: Column) -> Column:
        return F.struct(unsigned(content, place, two, little).cast("int").alias("tag"), unsigned(content, place + 2, two, little).cast("int").alias("type"), word(content, place + 4, little, big).alias("count"), (place + size - inline).alias("value"))

    def placed(e: Column) -> Column:
        return let(e["count"] * F.get(sizes, e["type"]), lambda length: where(e, length))

    def where(e: Column, length: Column) -> Column:
        return F.struct(e["tag"].alias("tag"), e["type"].alias("type"), e["count"].alias("count"), length.alias("length"), F.when(length <= inline, e["value"]).otherwise(word(content, e["value"], little, big)).alias("at"))

    places = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0))), lambda i: at + head + i * size)
    slots = F.transform(places, slot)
    known = F.filter(slots, lambda e: (F.get(sizes, e["type"]) > 0) & (e["count"] >= 0) & (e["count"] <= F.length(content)))
    inside = F.filter(F.transform(known, placed), lambda e: (e["at"] >= 0) & (e["at"] <= F.length(content) - e["length"]))
    raw = lambda e: F.substr(content, (e["at"] + 1).try_cast("int"), e["length"].try_cast("int"))
    found = F.transform(inside, lambda e: F.struct(e["tag"].alias("tag"), e["type"].alias("type"), e["count"].alias("count"), raw(e).alias("raw")))
    return F.when(n > 0, found).when(n == 0, F.array().cast(ENTRIES))


def entry(found: Column, tag: int) -> Column:
    """The first entry of a tag, or null."""
    return F.get(F.filter(found, lambda e: e["tag"] == tag), 0)


def numbers(e: Column, little: Column) -> Column:
    """The unsigned values of an entry as bigints; null for other types."""
    size = F.get(F.array(*map(F.lit, TYPE_BYTES)), e["type"])
    each = F.transform(F.sequence(F.lit(0).cast("bigint"), e["count"] - 1), lambda i: unsigned(e["raw"], i * size, size, little))
    return F.when(e["type"].isin(1, 3, 4, 7, 13, 16, 18) & (e["count"] > 0), each)


def number(found: Column, tag: int, little: Column) -> Column:
    """The first value of an unsigned tag, or null."""
    return let(entry(found, tag), lambda e: F.get(numbers(e, little), 0))


def swapped(raw: Column, kind: Column) -> Column:
    """Bytes of a value in the opposite byte order."""
    size = F.get(F.array(*map(F.lit, UNIT_BYTES)), kind)
    digits = F.hex(raw)
    unit = lambda i: F.concat_ws("", F.transform(F.sequence(size - 1, F.lit(0)), lambda k: F.substr(digits, (2 * (i * size + k) + 1).cast("int"), F.lit(2))))
    count = (F.length(raw) / size).cast("int")
    return F.when((size == 1) | (F.length(raw) == 0), raw).otherwise(F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), unit), "")))


def exif_destination(tag: Column) -> Column:
    """Where a tag of an EXIF blob goes in a written file: ifd0, exif, gps, or null where it is dropped.

    Pointers name the directory whose tags they lead to.
    """
    dropped = (tag == INTEROPERABILITY) | tag.isin(*STRUCTURAL)
    return F.when(dropped, None).when(tag.isin(*DESCRIPTIVE), "ifd0").when(tag == GPS_POINTER, "gps").when(tag.isNotNull(), "exif")
