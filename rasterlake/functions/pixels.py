"""Planes, palettes, orientations and metadata policy as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interleave(planes: list[Column], n: Column) -> Column:
    """Samples of equally long planes, pixel by pixel; short planes give the samples end to end."""
    whole = F.lit(True)
    for plane in planes:
        whole = whole & (F.size(plane) >= n)
    mixed = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(*[F.get(p, i) for p in planes])))
    return F.when((n > 0) & whole, mixed).otherwise(F.concat(*planes))


def palette(colours: Column, index: Column, bits: Column) -> Column:
    """Array (r, g, b) of an index; null where the map is short or the index beyond it."""
    size = F.call_function("shiftleft", F.lit(1), bits)
    channel = lambda k: F.shiftright(F.get(colours, index + size * k), 8)
    return F.when((F.size(colours) >= size * 3) & (index >= 0) & (index < size), F.array(*[channel(k) for k in range(3)]))


def _corner_map(tag: int) -> tuple[int, int, int]:
    """Transposed, then mirrored across, then mirrored down."""
    return tag > 4, tag in (2, 3, 6, 7), tag in (3, 4, 7, 8)


def compose(first: int, then: int) -> int:
    """The orientation that does one and then another, by their effect on a square's corners."""

    def apply(tag: int, point: tuple[int, int]) -> tuple[int, int]:
        swap, across, down = _corner_map(tag)
        x, y = point[::-1] if swap else point
        return (1 - x if across else x), (1 - y if down else y)

    corners = [(0, 0), (1, 0), (0, 1)]
    want = [apply(then, apply(first, p)) for p in corners]
    return next(tag for tag in range(1, 9) if [apply(tag, p) for p in corners] == want)


COMPOSED = [compose(a, b) for a in range(1, 9) for b in range(1, 9)]


def resolve_orientation(hint: Column, intrinsic: Column, asked: Column) -> Column:
    """preserve: 1; correct: the file's own; exact: the asked; both: the own and then the asked."""
    own = F.when(intrinsic.between(1, 8), intrinsic).otherwise(1)
    both = F.element_at(F.array(*[F.lit(x) for x in COMPOSED]), ((own - 1) * 8 + asked).cast("int"))
    return F.when(hint == "preserve", 1).when(hint == "correct", own).when(hint == "exact", asked).when(hint == "both", both)


def apply_policy(info: Column, icc: bool = True, exif: bool = True, xmp: bool = True) -> Column:
    """The struct of a probe with what the policy forbids set to null."""
    for name, allowed in (("icc", icc), ("exif", exif), ("xmp", xmp)):
        if not allowed:
            info = info.withField(name, F.lit(None).cast("binary"))
    return info


def merge_parameters(override: Column, base: Column, names: list[str]) -> Column:
    """Struct of the override's fields where set, else the base's."""
    return F.struct(*[F.coalesce(override[n], base[n]).alias(n) for n in names])
