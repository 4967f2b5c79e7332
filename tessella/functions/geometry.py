"""Column builders for points (x, y) and rectangles, given by the names of their bounds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect(NamedTuple):
    """The columns of a rectangle's bounds."""

    lx: Column
    ly: Column
    hx: Column
    hy: Column


def window(alias: str = "") -> Rect:
    """A query window's columns lx, ly, hx, hy."""
    return Rect(*(F.col(f"{alias}.{c}" if alias else c) for c in ("lx", "ly", "hx", "hy")))


def box(alias: str = "") -> Rect:
    """A bounding box's columns x_lo, y_lo, x_hi, y_hi."""
    return Rect(*(F.col(f"{alias}.{c}" if alias else c) for c in ("x_lo", "y_lo", "x_hi", "y_hi")))


def contains(r: Rect, x: Column, y: Column) -> Column:
    """Half-open: low <= p < high."""
    return (x >= r.lx) & (x < r.hx) & (y >= r.ly) & (y < r.hy)


def contains_closed(r: Rect, x: Column, y: Column) -> Column:
    return x.between(r.lx, r.hx) & y.between(r.ly, r.hy)


def overlaps(a: Rect, b: Rect) -> Column:
    """Strict: the interiors meet."""
    return (F.greatest(a.lx, b.lx) < F.least(a.hx, b.hx)) & (F.greatest(a.ly, b.ly) < F.least(a.hy, b.hy))


def may_hold(b: Rect, w: Rect) -> Column:
    """Whether a closed box of points may hold points of a half-open window: the safe test for pruning."""
    return (b.lx < w.hx) & (b.hx >= w.lx) & (b.ly < w.hy) & (b.hy >= w.ly)


def covers(a: Rect, b: Rect) -> Column:
    """a's low bounds reach b's, a's high bounds exceed b's (closed) ones."""
    return (a.lx <= b.lx) & (a.hx > b.hx) & (a.ly <= b.ly) & (a.hy > b.hy)


def same(a: Rect, b: Rect) -> Column:
    return (a.lx == b.lx) & (a.hx == b.hx) & (a.ly == b.ly) & (a.hy == b.hy)


def area(r: Rect) -> Column:
    return (r.hx - r.lx) * (r.hy - r.ly)


def perimeter(r: Rect) -> Column:
    return F.lit(2.0) * ((r.hx - r.lx) + (r.hy - r.ly))


def overlap_area(a: Rect, b: Rect) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a.hx, b.hx) - F.greatest(a.lx, b.lx))
    high = F.greatest(F.lit(0.0), F.least(a.hy, b.hy) - F.greatest(a.ly, b.ly))
    return wide * high


def overlap_ratio(a: Rect, b: Rect) -> Column:
    """The share of a that b covers; null for an empty a."""
    return overlap_area(a, b) / F.nullif(area(a), F.lit(0.0))


def stretched(r: Rect, x: Column, y: Column) -> Rect:
    return Rect(F.least(r.lx, x), F.least(r.ly, y), F.greatest(r.hx, x), F.greatest(r.hy, y))


def joined(a: Rect, b: Rect) -> Rect:
    return Rect(F.least(a.lx, b.lx), F.least(a.ly, b.ly), F.greatest(a.hx, b.hx), F.greatest(a.hy, b.hy))


def perimeter_growth(r: Rect, x: Column, y: Column) -> Column:
    """How much the sides' sum grows when the point joins."""
    grown = lambda lo, hi, p: F.abs(hi - p) + F.abs(lo - p) - (hi - lo)
    return grown(r.lx, r.hx, x) + grown(r.ly, r.hy, y)


def area_with(r: Rect, x: Column, y: Column) -> Column:
    """The area of the rectangle when the point has joined, as half-sums of distances and sides."""
    side = lambda lo, hi, p: (F.abs(hi - p) + F.abs(lo - p) + (hi - lo)) / F.lit(2.0)
    return side(r.lx, r.hx, x) * side(r.ly, r.hy, y)


def clip_unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def cell(c: Column, size: int) -> Column:
    """The column's cell among `size` in the unit interval, clamped at both ends."""
    return F.least(F.greatest(F.floor(c * F.lit(float(size))), F.lit(0)), F.lit(size - 1)).cast("bigint")


def area_window(x: Column, y: Column, fraction: float) -> list[Column]:
    """The square window of this share of the unit square around a centre, clipped."""
    half = fraction**0.5 / 2.0
    return [clip_unit(x - F.lit(half)).alias("lx"), clip_unit(y - F.lit(half)).alias("ly"), clip_unit(x + F.lit(half)).alias("hx"), clip_unit(y + F.lit(half)).alias("hy")]


def selectivity_tag(fraction: Column) -> Column:
    """Millionths, padded to five digits; fractions of a millionth are written out with p for the point."""
    scaled = fraction * F.lit(1e6)
    whole = F.round(scaled).cast("int")
    return F.when(F.abs(scaled - whole) < 1e-6, F.format_string("%05d", whole)).otherwise(F.replace(F.format_string("%.9f", fraction), F.lit("."), F.lit("p")))
