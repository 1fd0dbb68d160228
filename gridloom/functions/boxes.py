"""Column expressions on boxes and polygons.

A box is four whole pixel coordinates, x1 <= x2 and y1 <= y2 where it isn't empty; areas count no extra pixel. A polygon is a flat
array x, y, x, y, ... of doubles. Coordinates become whole by truncation.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    def struct(self) -> Column:
        return F.struct(*[c.alias(n) for n, c in self._asdict().items()])


def box(prefix: str = "", alias: str = "") -> Box:
    """The box in the columns <alias.><prefix>x1 ... y2."""
    dot = f"{alias}." if alias else ""
    return Box(*[F.col(f"{dot}{prefix}{n}") for n in ("x1", "y1", "x2", "y2")])


def box_of(struct: Column) -> Box:
    return Box(*[struct[n] for n in ("x1", "y1", "x2", "y2")])


def _at_least_0(c: Column) -> Column:
    return F.greatest(c, F.lit(0))


def width(a: Box) -> Column:
    return a.x2 - a.x1


def height(a: Box) -> Column:
    return a.y2 - a.y1


def area(a: Box) -> Column:
    """0 for an inverted box."""
    return (_at_least_0(width(a)).cast("long") * _at_least_0(height(a))).cast("long")


def raw_area(a: Box) -> Column:
    """Not clamped: an inverted side makes it negative, two make it positive."""
    return (width(a).cast("long") * height(a)).cast("long")


def intersection_area(a: Box, b: Box) -> Column:
    """Null where either box is missing."""
    w = _at_least_0(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = _at_least_0(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return F.when(a.x1.isNotNull() & b.x1.isNotNull(), (w.cast("long") * h).cast("long"))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 without either."""
    both = intersection_area(a, b)
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def contains(outer: Box, inner: Box) -> Column:
    """Borders included."""
    return (outer.x1 <= inner.x1) & (outer.y1 <= inner.y1) & (outer.x2 >= inner.x2) & (outer.y2 >= inner.y2)


def contains_or_missing(outer: Box, inner: Box) -> Column:
    """True as well where either box is missing."""
    missing = outer.x1.isNull() | inner.x1.isNull()
    return F.coalesce(missing | contains(outer, inner), F.lit(True))


def intersect(a: Box, b: Box) -> Column:
    """The common box as a struct, null where there is none."""
    common = Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2))
    return F.when((common.x2 > common.x1) & (common.y2 > common.y1), common.struct())


def clip(a: Box, to: Box) -> Box:
    return Box(F.greatest(a.x1, to.x1), F.greatest(a.y1, to.y1), F.least(a.x2, to.x2), F.least(a.y2, to.y2))


def sanitized(values: Column, w: Column, h: Column, strict: bool = True) -> Column:
    """A box from an array of numbers that a model gave, clamped to w by h; null where it makes no box.

    strict: exactly four numbers, the first corner at most w-1, h-1 and the second at least 1, 1; else the first four of four or
    more, the first corner at least 0, 0 and the second at most w, h.
    """
    v = [F.get(values, F.lit(i)).cast("int") for i in range(4)]
    if strict:
        enough = F.size(values) == 4
        between = lambda c, low, high: F.greatest(F.lit(low), F.least(c, high))
        got = Box(between(v[0], 0, w - 1), between(v[1], 0, h - 1), between(v[2], 1, w), between(v[3], 1, h))
    else:
        enough = F.size(values) >= 4
        got = Box(_at_least_0(v[0]), _at_least_0(v[1]), F.least(v[2], w), F.least(v[3], h))
    return F.when(enough & (got.x2 > got.x1) & (got.y2 > got.y1), got.struct())


def _odd_even(polygon: Column, rest: int) -> Column:
    return F.filter(polygon, lambda v, i: i % 2 == rest)


def xs(polygon: Column) -> Column:
    return _odd_even(polygon, 0)


def ys(polygon: Column) -> Column:
    return _odd_even(polygon, 1)


def is_relative(polygon: Column) -> Column:
    """Whether the coordinates are shares of the page rather than pixels."""
    return F.array_max(polygon) <= 1.5


def scaled(polygon: Column, w: Column, h: Column) -> Column:
    """In pixels: a polygon of shares times the page size, any other as it is."""
    return F.when(is_relative(polygon), F.transform(polygon, lambda v, i: F.when(i % 2 == 0, v * w).otherwise(v * h))).otherwise(polygon)


def relative(polygon: Column, w: Column, h: Column) -> Column:
    """As shares of the page; a polygon that is so already stays."""
    return F.when(is_relative(polygon), polygon).otherwise(F.transform(polygon, lambda v, i: F.when(i % 2 == 0, v / w).otherwise(v / h)))


def polygon_to_box(polygon: Column, w: Column, h: Column, padding: int = 0) -> Column:
    """The box around a polygon, padded and clamped to the page; null if that is empty."""
    got = Box(
        F.greatest(F.lit(0), F.array_min(xs(polygon)).cast("int") - padding),
        F.greatest(F.lit(0), F.array_min(ys(polygon)).cast("int") - padding),
        F.least(w, F.array_max(xs(polygon)).cast("int") + padding),
        F.least(h, F.array_max(ys(polygon)).cast("int") + padding),
    )
    return F.when((F.size(polygon) > 0) & (got.x2 > got.x1) & (got.y2 > got.y1), got.struct())


def box_to_polygon(a: Box) -> Column:
    return F.array(*[c.cast("double") for c in (a.x1, a.y1, a.x2, a.y1, a.x2, a.y2, a.x1, a.y2)])


def page_polygon(w: Column, h: Column) -> Column:
    return box_to_polygon(Box(F.lit(0), F.lit(0), w, h))


def covers_page(a: Box, w: Column, h: Column, tolerance: int = 0) -> Column:
    return (a.x1 <= tolerance) & (a.y1 <= tolerance) & (a.x2 >= w - tolerance) & (a.y2 >= h - tolerance)


def clamped(polygon: Column, to: Box) -> Column:
    return F.transform(
        polygon, lambda v, i: F.when(i % 2 == 0, F.greatest(to.x1, F.least(v, to.x2))).otherwise(F.greatest(to.y1, F.least(v, to.y2))).cast("double")
    )


def centre_inside(polygon: Column, a: Box) -> Column:
    x, y = ((F.array_min(f(polygon)) + F.array_max(f(polygon))) / 2 for f in (xs, ys))
    return (x >= a.x1) & (x <= a.x2) & (y >= a.y1) & (y <= a.y2)


def wraps_around(polygon: Column, w: Column, h: Column) -> Column:
    """Whether a polygon runs around content rather than holding it.

    So it does with a vertex over 10 % off the page, over 80 % wide, over 60 % wide and 30 % high, or if it has four corners
    that turn both ways (cross products over 1 px²). Fewer than three corners never do.
    """
    return _once(polygon, lambda p: _once(scaled(p, w, h), lambda px: _once(F.struct(xs(px).alias("x"), ys(px).alias("y")), lambda v: _around(v["x"], v["y"], w, h))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row; written out, it would be computed wherever ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _around(x: Column, y: Column, w: Column, h: Column) -> Column:
    off = F.exists(x, lambda v: (v < -0.1 * w) | (v > 1.1 * w)) | F.exists(y, lambda v: (v < -0.1 * h) | (v > 1.1 * h))
    sx, sy = (F.array_max(x) - F.array_min(x)) / w, (F.array_max(y) - F.array_min(y)) / h
    at = lambda a, k: F.get(a, F.lit(k % 4))
    turns = [(at(x, i + 1) - at(x, i)) * (at(y, i + 2) - at(y, i + 1)) - (at(y, i + 1) - at(y, i)) * (at(x, i + 2) - at(x, i + 1)) for i in range(4)]
    numbers = F.size(x) + F.size(y)
    mixed = (numbers == 8) & (F.greatest(*turns) > 1) & (F.least(*turns) < -1)
    wraps = off | (sx > 0.8) | ((sx > 0.6) & (sy > 0.3)) | F.coalesce(mixed, F.lit(False))
    return F.when(numbers >= 6, wraps).otherwise(F.lit(False))


def normalized(a: Box, w: Column, h: Column) -> Box:
    """Doubles of any order and unit to a pixel box: shares of the page scaled, corners ordered."""
    share = (F.least(*a) >= 0) & (F.greatest(*a) <= 1)
    x = [F.when(share, c * w).otherwise(c) for c in (a.x1, a.x2)]
    y = [F.when(share, c * h).otherwise(c) for c in (a.y1, a.y2)]
    return Box(*[c.cast("int") for c in (F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y))])


def x_overlap(a: Box, b: Box, tolerance: int = 2) -> Column:
    """Shared width (and a tolerance) by the wider one's width."""
    shared = _at_least_0(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1) + tolerance)
    return shared / F.greatest(width(a), width(b), F.lit(1))


def shifted(a: Box, dx: Column, dy: Column) -> Box:
    return Box(a.x1 + dx, a.y1 + dy, a.x2 + dx, a.y2 + dy)


def centre(a: Box) -> tuple[Column, Column]:
    return (a.x1 + a.x2) / 2, (a.y1 + a.y2) / 2


def holds_name(panel: Box, name: Box, relaxed: bool = True) -> Column:
    """Whether a panel holds its name's box: strictly, or its centre within the panel grown by the name's size."""
    if not relaxed:
        return contains(panel, name)
    x, y = centre(name)
    return (x >= panel.x1 - width(name)) & (x <= panel.x2 + width(name)) & (y >= panel.y1 - height(name)) & (y <= panel.y2 + height(name))


def unscaled(left: Column, top: Column, w: Column, h: Column, sx: Column, sy: Column, page_w: Column, page_h: Column) -> Column:
    """A rectangle drawn on a scaled canvas as a page box; null if nothing is left on the page."""
    got = Box(
        _at_least_0((left / sx).cast("int")),
        _at_least_0((top / sy).cast("int")),
        F.least(page_w, ((left + w) / sx).cast("int")),
        F.least(page_h, ((top + h) / sy).cast("int")),
    )
    return F.when((got.x2 > got.x1) & (got.y2 > got.y1), got.struct())
