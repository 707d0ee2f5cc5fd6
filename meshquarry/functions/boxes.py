"""Half-open boxes as six columns z0, z1, y0, y1, x0, x1, named with a prefix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def side(prefix: str, axis: str) -> tuple[Column, Column]:
    return F.col(f"{prefix}{axis}0"), F.col(f"{prefix}{axis}1")


def overlaps(a: str, b: str) -> Column:
    """True where the boxes share a point; touching half-open boxes don't."""
    parts = []
    for axis in AXES:
        (a0, a1), (b0, b1) = side(a, axis), side(b, axis)
        parts.append((a0 < b1) & (b0 < a1))
    return reduce(Column.__and__, parts)


def overlap_volume(a: str, b: str) -> Column:
    parts = []
    for axis in AXES:
        (a0, a1), (b0, b1) = side(a, axis), side(b, axis)
        parts.append(F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0)))
    return reduce(Column.__mul__, parts)


def signed_gap(a: str, b: str) -> Column:
    """The largest distance along an axis; negative where the boxes overlap along all."""
    parts = []
    for axis in AXES:
        (a0, a1), (b0, b1) = side(a, axis), side(b, axis)
        parts.append(F.greatest(b0 - a1, a0 - b1))
    return F.greatest(*parts)


def gap(a: str, b: str) -> Column:
    return F.greatest(signed_gap(a, b), F.lit(0))


def volume(a: str) -> Column:
    return reduce(Column.__mul__, (F.greatest(hi - lo, F.lit(0)) for lo, hi in (side(a, axis) for axis in AXES)))


def contains(a: str, z: Column, y: Column, x: Column) -> Column:
    at = dict(zip(AXES, (z, y, x), strict=True))
    return reduce(Column.__and__, ((at[axis] >= side(a, axis)[0]) & (at[axis] < side(a, axis)[1]) for axis in AXES))
