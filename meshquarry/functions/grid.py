"""Tiles of a regular grid and their orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spreads the low 21 bits of a number to every third bit: shift, then keep these bits.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def tile_of(position: Column, size: int) -> Column:
    """Floor division, also for negative positions."""
    return F.floor(position / size).cast("long")


def _spread(n: Column) -> Column:
    n = n.cast("long").bitwiseAND(F.lit((1 << 21) - 1))
    for shift, keep in _SPREAD:
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(keep))
    return n


def morton(z: Column, y: Column, x: Column) -> Column:
    """The Z-order place of three numbers below 2^21: z in the lowest bit."""
    return _spread(z).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(x), 2))


def row_major(z: Column, y: Column, x: Column, ny: int, nx: int) -> Column:
    return (z * ny + y) * nx + x


def to_voxel(nm: Column, origin: float, size: float) -> Column:
    """Nearest voxel, halves to even."""
    return F.rint((nm - origin) / size).cast("long")


def to_nm(voxel: Column, origin: float, size: float) -> Column:
    return voxel * size + origin
