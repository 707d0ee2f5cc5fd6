"""Dense volumes as tables of blocks, and what needs the voxels of neighbouring blocks.

A block is a row (volume, bz, by, bx) with arrays of its voxels in C order. Blocks stand on a regular grid, are clipped at the
volume's far ends, and may be absent. What crosses a border travels as slabs: each block sends to each neighbour the voxels that
this one can see, and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = ["volume", "bz", "by", "bx"]
_KEY = "volume long, bz int, by int, bx int"
Triple = tuple[int, int, int]


@dataclass(frozen=True)
class Grid:
    """The volumes' extent in voxels and the blocks', both along z, y, x."""

    shape: Triple
    size: Triple

    def origin(self, block: Sequence[int]) -> Triple:
        return tuple(int(i) * s for i, s in zip(block, self.size, strict=True))

    def extent(self, block: Sequence[int]) -> Triple:
        return tuple(min(s, n - int(i) * s) for i, s, n in zip(block, self.size, self.shape, strict=True))

    def voxels(self, volume: int, block: Sequence[int]) -> np.ndarray:
        """The number of each voxel among those of all volumes, in C order; it doesn't depend on the blocks."""
        z, y, x = (np.arange(o, o + d, dtype=np.int64) for o, d in zip(self.origin(block), self.extent(block), strict=True))
        nz, ny, nx = self.shape
        return (((volume * nz + z)[:, None, None] * ny + y[None, :, None]) * nx + x).ravel()


def as_blocks(voxels: DataFrame, grid: Grid, *columns: str) -> DataFrame:
    """Blocks of voxels (volume, z, y, x, columns...). Every voxel of a block must be there, once."""
    at = {f"b{a}": F.floor(F.col(a) / s).cast("int") for a, s in zip("zyx", grid.size, strict=True)}
    rows = voxels.withColumns(at).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("z", "y", "x", *columns))).alias("__v"))
    return rows.select(*KEY, *(F.col(f"__v.{c}").alias(c) for c in columns))


def as_voxels(blocks: DataFrame, grid: Grid, *columns: str) -> DataFrame:
    """(volume, z, y, x, columns...) of every voxel."""
    z0, y0, x0 = (F.col(f"b{a}") * s for a, s in zip("zyx", grid.size, strict=True))
    dy, dx = (F.least(F.lit(s), F.lit(n) - o) for s, n, o in zip(grid.size[1:], grid.shape[1:], (y0, x0), strict=True))
    rows = blocks.select(*KEY, dy.alias("__dy"), dx.alias("__dx"), F.posexplode(F.arrays_zip(*columns)).alias("__at", "__v"))
    place = {"z": z0 + F.expr("__at div (__dy * __dx)"), "y": y0 + F.expr("__at div __dx % __dy"), "x": x0 + F.expr("__at % __dx")}
    return rows.select("volume", *(v.cast("int").alias(c) for c, v in place.items()), *(F.col(f"__v.{c}").alias(c) for c in columns))


def spread(blocks: DataFrame) -> DataFrame:
    """Dealt out by block, over as many tasks as shuffles have: rows are few and heavy, so adaptive execution must not put them
    together by their size."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)


def slabs(blocks: DataFrame, grid: Grid, columns: Sequence[str], reach: Triple) -> DataFrame:
    """(key of the receiving block, start and extent within its box widened by `reach`, columns...): what each block holds that
    another one sees within `reach`. A block sends to the blocks around it, further ones only where `reach` exceeds a block."""
    steps = [-(-r // s) for r, s in zip(reach, grid.size, strict=True)]
    count = [-(-n // s) for n, s in zip(grid.shape, grid.size, strict=True)]
    around = [d for d in product(*(range(-k, k + 1) for k in steps)) if any(d)]
    kinds = {c: blocks.schema[c].dataType.simpleString() for c in columns}
    names = [*KEY, "z", "y", "x", "dz", "dy", "dx", *columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                block = row[1:4]
                own, d = grid.origin(block), grid.extent(block)
                arrays = [np.asarray(v).reshape(d) for v in row[4:]]
                for step in around:
                    to = [int(i) + s for i, s in zip(block, step, strict=True)]
                    if any(not 0 <= i < n for i, n in zip(to, count, strict=True)):
                        continue
                    low = [o - r for o, r in zip(grid.origin(to), reach, strict=True)]
                    high = [o + e + r for o, e, r in zip(grid.origin(to), grid.extent(to), reach, strict=True)]
                    a = [max(lo, o) for lo, o in zip(low, own, strict=True)]
                    b = [min(hi, o + e) for hi, o, e in zip(high, own, d, strict=True)]
                    if all(p < q for p, q in zip(a, b, strict=True)):
                        cut = tuple(slice(p - o, q - o) for p, q, o in zip(a, b, own, strict=True))
                        out.append((row[0], *to, *(p - lo for p, lo in zip(a, low, strict=True)), *(q - p for p, q in zip(a, b, strict=True)), *(v[cut].ravel() for v in arrays)))
            if out:
                yield pd.DataFrame(out, columns=names)

    schema = f"{_KEY}, z int, y int, x int, dz int, dy int, dx int, " + ", ".join(f"{c} {k}" for c, k in kinds.items())
    return blocks.select(*KEY, *columns).mapInPandas(run, schema)


def with_neighbours(blocks: DataFrame, grid: Grid, columns: Sequence[str], reach: Triple, run: Callable[[pd.Series, dict[str, np.ndarray], np.ndarray], dict], schema: str, sending: DataFrame | None = None) -> DataFrame:
    """A row a block: its key and what `run` says, given the block's row, its columns widened by `reach`, and which of these
    voxels are known. `sending` are the blocks that send slabs, all of them unless told. A task holds a block and its slabs at
    a time."""
    names = StructType.fromDDL(f"{_KEY}, {schema}").fieldNames()
    sent = slabs(blocks if sending is None else sending, grid, columns, reach)

    def one(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=names)
        row = own.iloc[0]
        d = grid.extent(row[KEY[1:]])
        wide = tuple(e + 2 * r for e, r in zip(d, reach, strict=True))
        core = tuple(slice(r, r + e) for e, r in zip(d, reach, strict=True))
        known, padded = np.zeros(wide, bool), {}
        known[core] = True
        for c in columns:
            padded[c] = np.zeros(wide, np.asarray(row[c]).dtype)
            padded[c][core] = np.asarray(row[c]).reshape(d)
        for s in other.itertuples(index=False):
            at = tuple(slice(p, p + e) for p, e in zip((s.z, s.y, s.x), (s.dz, s.dy, s.dx), strict=True))
            known[at] = True
            for c in columns:
                padded[c][at] = np.asarray(getattr(s, c)).reshape(s.dz, s.dy, s.dx)
        return pd.DataFrame([{**{k: row[k] for k in KEY}, **run(row, padded, known)}], columns=names)

    return spread(blocks).groupBy(*KEY).cogroup(sent.groupBy(*KEY)).applyInPandas(one, f"{_KEY}, {schema}")


#: Voxels that a step of a task holds, where blocks are smaller: a call costs as much as thousands of voxels.
BRICK = 1 << 15


def coarse(grid: Grid) -> Grid:
    """Whole blocks put together to bricks of at most BRICK voxels, as near to cubes as the volume lets them be."""
    size = list(grid.size)
    while (short := [a for a in range(3) if size[a] < grid.shape[a]]) and 2 * prod(size) <= BRICK:
        size[min(short, key=lambda a: size[a])] *= 2
    return Grid(grid.shape, tuple(size))


def bricks(blocks: DataFrame, grid: Grid, columns: Sequence[str], run: Callable[[tuple, dict[str, np.ndarray], np.ndarray], dict], schema: str) -> tuple[DataFrame, Grid]:
    """A row a brick: its key and what `run` says, given the key, the columns of the brick's blocks, zero where a block is absent, and
    which voxels are known; and the bricks' grid. A task holds a brick at a time."""
    wide = coarse(grid)
    names = StructType.fromDDL(f"{_KEY}, {schema}").fieldNames()
    factor = [w // s for w, s in zip(wide.size, grid.size, strict=True)]

    def one(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        key = tuple(int(k) for k in key)
        known, whole = np.zeros(wide.extent(key[1:]), bool), {}
        first = wide.origin(key[1:])
        for row in own.itertuples(index=False):
            at = tuple(slice(o - f, o - f + e) for o, f, e in zip(grid.origin(row[1:4]), first, grid.extent(row[1:4]), strict=True))
            known[at] = True
            for c, v in zip(columns, row[4:], strict=False):
                v = np.asarray(v)
                if c not in whole:
                    whole[c] = np.zeros(known.shape, v.dtype)
                whole[c][at] = v.reshape(known[at].shape)
        return pd.DataFrame([{**dict(zip(KEY, key, strict=True)), **run(key, whole, known)}], columns=names)

    by = ["volume", *(F.floor(F.col(b) / f).cast("int").alias(f"__{b}") for b, f in zip(KEY[1:], factor, strict=True))]
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.select(*KEY, *columns).repartition(n, *by).groupBy(*by).applyInPandas(one, f"{_KEY}, {schema}"), wide


def cut_up(key: Sequence[int], wide: Grid, grid: Grid, known: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """A brick's known blocks, with their voxels of the columns."""
    first, d, out = wide.origin(key[1:]), wide.extent(key[1:]), []
    known, columns = known.reshape(d), {c: v.reshape(d) for c, v in columns.items()}
    for block in product(*(range(f // s, -(-(f + e) // s)) for f, e, s in zip(first, d, grid.size, strict=True))):
        at = tuple(slice(o - f, o - f + e) for o, f, e in zip(grid.origin(block), first, grid.extent(block), strict=True))
        if known[at].any():
            out.append((key[0], *block, *(v[at].ravel() for v in columns.values())))
    return pd.DataFrame(out, columns=[*KEY, *columns])


def gaussian_kernel(sigma: float, truncate: float = 3.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return k / k.sum()


def _along(v: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r, n = len(kernel) // 2, v.shape[axis]
    parts = [k * np.take(v, range(i, n - 2 * r + i), axis=axis) for i, k in enumerate(kernel)]
    return sum(parts[1:], parts[0])


def smoothed(blocks: DataFrame, grid: Grid, column: str, sigma: tuple[float, float, float], out: str = "smooth", truncate: float = 3.0) -> DataFrame:
    """(key, out): a separable Gaussian of each voxel's surroundings, cut at `truncate` deviations. Only what is known counts, its
    weights made to add up to one, so neither the volume's ends nor absent blocks darken a voxel, and the result doesn't depend
    on where the volume is cut."""
    kernels = [gaussian_kernel(s, truncate) for s in sigma]
    reach = tuple(len(k) // 2 for k in kernels)

    def run(_: pd.Series, padded: dict[str, np.ndarray], known: np.ndarray) -> dict:
        value, weight = np.where(known, padded[column], 0.0), known.astype(np.float64)
        for axis, kernel in enumerate(kernels):
            value, weight = _along(value, kernel, axis), _along(weight, kernel, axis)
        return {out: (value / weight).ravel()}

    return with_neighbours(blocks, grid, [column], reach, run, f"{out} array<double>")


def gradient(blocks: DataFrame, grid: Grid, column: str, out: str = "gradient") -> DataFrame:
    """(key, out): the length of the gradient; central differences, one-sided where one neighbour is not known, 0 where both
    are not."""

    def run(_: pd.Series, padded: dict[str, np.ndarray], known: np.ndarray) -> dict:
        v, core, total = padded[column].astype(np.float64), (slice(1, -1),) * 3, 0.0
        for axis in range(3):
            at = lambda s, axis=axis: tuple(s if i == axis else slice(1, -1) for i in range(3))
            before, after = at(slice(None, -2)), at(slice(2, None))
            one = np.where(known[after], v[after], v[core]) - np.where(known[before], v[before], v[core])
            both = known[before] & known[after]
            total = total + np.where(both, one / 2, one) ** 2
        return {out: np.sqrt(total).ravel()}

    return with_neighbours(blocks, grid, [column], (1, 1, 1), run, f"{out} array<double>")
