"""Tiles, neighbourhoods and box joins, as equi joins over grid cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions import boxes
from meshquarry.functions.grid import morton, row_major, tile_of
from meshquarry.operators.metrics import with_quantiles
from meshquarry.storage import cut


def tiles(spark: SparkSession, shape: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """(tile, iz, iy, ix, morton, z0, z1, ..., voxels): a regular grid, clipped at the far ends. Generated on the executors."""
    n = [-(-a // b) for a, b in zip(shape, size, strict=True)]
    rows = spark.range(n[0] * n[1] * n[2]).select(F.col("id").alias("tile"))
    rows = rows.withColumns({"iz": F.expr(f"tile div {n[1] * n[2]}"), "iy": F.expr(f"tile div {n[2]} % {n[1]}"), "ix": F.expr(f"tile % {n[2]}")})
    for axis, whole, step in zip(boxes.AXES, shape, size, strict=True):
        rows = rows.withColumns({f"{axis}0": F.col(f"i{axis}") * step, f"{axis}1": F.least((F.col(f"i{axis}") + 1) * step, F.lit(whole))})
    return rows.withColumns({"morton": morton(F.col("iz"), F.col("iy"), F.col("ix")), "voxels": boxes.volume("")})


def in_morton_order(df: DataFrame, partitions: int) -> DataFrame:
    """Rows with a column morton, neighbours in space in the same partition, in order within it."""
    return df.repartitionByRange(partitions, "morton").sortWithinPartitions("morton")


def covered_tiles(rows: DataFrame, size: tuple[int, int, int], prefix: str = "") -> DataFrame:
    """Rows with (iz, iy, ix) of each tile that the row's box meets: a range condition as keys."""
    for axis, step in zip(boxes.AXES, size, strict=True):
        lo, hi = boxes.side(prefix, axis)
        rows = rows.where(hi > lo).withColumn(f"i{axis}", F.explode(F.sequence(tile_of(lo, step), tile_of(hi - 1, step))))
    return rows


def neighbours(grid: DataFrame, reach: int = 1) -> DataFrame:
    """(tile, neighbour) of all tiles of a grid within `reach` steps along each axis, the tile itself excepted."""
    steps = [s for s in product(range(-reach, reach + 1), repeat=3) if any(s)]
    moved = grid.select("tile", F.explode(F.array(*(F.struct((F.col("iz") + a).alias("iz"), (F.col("iy") + b).alias("iy"), (F.col("ix") + c).alias("ix")) for a, b, c in steps))).alias("at")).select("tile", "at.*")
    return moved.join(grid.select(F.col("tile").alias("neighbour"), "iz", "iy", "ix"), ["iz", "iy", "ix"]).select("tile", "neighbour")


def _cell(sides: DataFrame, most: tuple[int, int, int]) -> tuple[int, int, int]:
    """Cells of the mean sides of boxes (dz, dy, dx), `most` at the most: of all sizes these give the fewest comparisons."""
    means = sides.agg(*(F.avg(f"d{x}").alias(x) for x in boxes.AXES)).first()
    return tuple(max(1, min(m, round(means[x] or m))) for x, m in zip(boxes.AXES, most, strict=True))


def box_pairs(a: DataFrame, b: DataFrame, cell: tuple[int, int, int], within: int = 0, same: Sequence[str] = (), unlike: Sequence[str] = (), ordered: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(a_id, b_id, volume, gap) of boxes (id, z0, z1, y0, y1, x0, x1) that overlap, or whose gap along the axes is below
    `within`. Boxes meet in the grid cells that both cover, widened by `within`, so only neighbours are compared; a pair that
    meets in several cells is kept in the first of them. Cells are of the boxes' mean size, and no larger than `cell`, which
    keeps both the copies and the comparisons few. Empty boxes meet nothing.

    Pairs may be held to equal columns `same` (then a key with the cell), to unequal ones `unlike`, and to a_id < b_id
    (`ordered`, for boxes joined with themselves): what doesn't count is never a row. Columns to `carry` travel with the boxes and
    come with each pair as a_... and b_..., so that pairs, which are many, need no joins to get them."""
    sides = [f"{x}{k}" for x in boxes.AXES for k in (0, 1)]
    named = lambda df, p: df.select(*same, *(F.col(c).alias(f"{p}_{c}") for c in ("id", *sides, *unlike, *carry))).where(boxes.volume(f"{p}_") > 0)
    a, b = named(a, "a"), named(b, "b")
    wide = a.select("*", *(((F.col(f"a_{x}{k}") + (within if k else -within)).alias(f"w_{x}{k}")) for x in boxes.AXES for k in (0, 1)))
    size = lambda df, p: df.select(*((hi - lo).alias(f"d{x}") for x in boxes.AXES for lo, hi in [boxes.side(p, x)]))
    cell = _cell(size(wide, "w_").unionByName(size(b, "b_")), cell)
    # Boxes are small and their pairs many: the sizes of files say nothing of the work, so neither one task nor a broadcast.
    n, keys = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*same, "iz", "iy", "ix"]
    left, right = (covered_tiles(df.repartition(n, f"{p}_id"), cell, q).repartition(n, *keys) for df, p, q in ((wide, "a", "w_"), (b, "b", "b_")))
    keep = boxes.overlaps("a_", "b_") if within == 0 else boxes.signed_gap("a_", "b_") < within
    for axis, step in zip(boxes.AXES, cell, strict=True):
        keep = keep & (F.col(f"i{axis}") == tile_of(F.greatest(F.col(f"w_{axis}0"), F.col(f"b_{axis}0")), step))
    for c in unlike:
        keep = keep & (F.col(f"a_{c}") != F.col(f"b_{c}"))
    if ordered:
        keep = (F.col("a_id") < F.col("b_id")) & keep
    pairs = left.join(right.hint("merge"), keys).where(keep)
    return pairs.select("a_id", "b_id", boxes.overlap_volume("a_", "b_").alias("volume"), boxes.gap("a_", "b_").alias("gap"), *(f"{p}_{c}" for p in "ab" for c in carry))


def buffer_violations(regions: DataFrame, cell: tuple[int, int, int], buffer: int) -> DataFrame:
    """(a_id, b_id, gap): pairs of regions (id, split, box) of different splits with a gap below the buffer, a_id < b_id."""
    return box_pairs(regions, regions, cell, buffer, unlike=["split"], ordered=True).select("a_id", "b_id", "gap")


def missing_tiles(grid: DataFrame, seen: DataFrame) -> DataFrame:
    """Tiles of the grid with the status observed for them, `absent` where there is none."""
    return grid.join(seen.select("tile", "status"), "tile", "left").withColumn("status", F.coalesce("status", F.lit("absent")))


def coverage(tiles_: DataFrame, done: tuple[str, ...]) -> DataFrame:
    """One row: tiles and voxels, and the shares of both that are done."""
    ok = F.col("status").isin(*done)
    return tiles_.agg(F.count("*").alias("tiles"), F.count_if(ok).alias("done"), F.avg(ok.cast("double")).alias("share_tiles"), (F.sum(F.when(ok, F.col("voxels")).otherwise(0)) / F.sum("voxels")).alias("share_voxels"))


#: Points in order that a round shows to a block's task.
HEAD = 1 << 16
#: A block's side in cells of half the radius.
SIDE = 16


def _walked(pdf: pd.DataFrame, side: int, radius: float) -> np.ndarray:
    """Places in the frame of the points that the walk surely keeps, of one block's first points (rank, cells from two before
    the block on, z, y, x), in order of rank. A point of the block is sure once none is before it in the cells within reach; what is near it goes."""
    wide = side + 4
    flat = np.ravel_multi_index(tuple(pdf[f"__c{a}"].to_numpy(np.int64) for a in boxes.AXES), (wide,) * 3)
    z, y, x = (pdf[a].to_numpy(np.float64) for a in boxes.AXES)
    live, kept = np.arange(len(pdf)), []
    while len(live):
        best = np.full(wide**3, len(pdf))
        best[flat[live[::-1]]] = live[::-1]  # of a cell's points the first in order is written last
        best = most = best.reshape((wide,) * 3)
        for axis in range(3):
            most = np.min([np.take(most, range(i, i + most.shape[axis] - 4), axis) for i in range(5)], axis=0)
        own = best[2:-2, 2:-2, 2:-2]
        sure = own[(own == most) & (own < len(pdf))]
        if not len(sure):
            break
        kept.append(sure)
        for i in sure:
            dz, dy, dx = z[live] - z[i], y[live] - y[i], x[live] - x[i]
            live = live[dz * dz + dy * dy + dx * dx >= radius * radius]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def separated(points: DataFrame, group: str, radius: float, limit: int | None = None, side: int = SIDE, head: int = HEAD) -> DataFrame:
    """Of points (group, id, score, z, y, x), by group, the ones a greedy walk keeps: best score first, then the smallest id,
    each at least `radius` from all kept before; the first `limit` of them. Ids are numbers, unique within a group; points
    with a null have no place and are left out.

    The walk goes in rounds over all groups at once. A task has a block of `side` cells of half the radius, and two cells more
    around it: there it takes all points that nothing undecided can stand before. What lies near them goes, and the rest decides
    anew. So chains of points that wait for each other end within a block, and there are about as many rounds as such a chain
    crosses borders. Of a crowded block a round shows the first `head` points: none of the others stands before these. The best
    of each group goes in every round, so they end; no group is collected, and a round costs in proportion to what is undecided.
    """
    if side < 4 or head < 1:
        raise ValueError("a block must have four cells or more, and its head a point")
    cells = [f"__c{a}" for a in boxes.AXES]
    rest = points.dropna(subset=["id", "score", *boxes.AXES]).withColumns({c: F.floor(F.col(a) / (radius / 2)).cast("long") for c, a in zip(cells, boxes.AXES, strict=True)})
    rest = whole = cut(rest.withColumn("__g", F.coalesce(F.col(group).cast("string"), F.lit("\0"))))
    at = ["__g", *(f"__b{a}" for a in boxes.AXES)]
    order = W.partitionBy(*at).orderBy(F.desc("score"), F.asc("id"))
    kind = f"__g string, id {points.schema['id'].dataType.simpleString()}, z double, y double, x double"

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__r")
        return pdf.iloc[_walked(pdf, side, radius)][["__g", "id", *boxes.AXES]]

    picked = None
    while not rest.isEmpty():
        shown = rest.select("__g", "id", "score", *(F.col(a).cast("double").alias(a) for a in boxes.AXES), *cells)
        for a, c in zip(boxes.AXES, cells, strict=True):
            block = lambda d, c=c: F.floor((F.col(c) + d) / side).cast("long")
            shown = shown.withColumn(f"__b{a}", F.explode(F.array_distinct(F.array(block(-2), block(2)))))
        shown = shown.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= head).drop("score")
        shown = shown.withColumns({c: F.col(c) - F.col(f"__b{a}") * side + 2 for a, c in zip(boxes.AXES, cells, strict=True)})
        taken = cut(shown.groupBy(*at).applyInPandas(settle, kind))
        picked = taken if picked is None else picked.unionByName(taken)
        rest = cut(clear_of(rest, taken, radius))
    kept = points.limit(0) if picked is None else whole.join(picked.select("__g", "id"), ["__g", "id"], "left_semi").select(*points.columns)
    if limit is None:
        return kept
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), "id"))
    return kept.withColumn("__at", rank).where(F.col("__at") <= limit).drop("__at")


def clear_of(rows: DataFrame, picks: DataFrame, radius: float) -> DataFrame:
    """The rows no closer than the radius to a pick of their group __g. They meet in cells of the radius's size, so a large group is
    spread over its cells."""
    cell = {f"__k{a}": F.floor(F.col(a) / radius).cast("long") for a in boxes.AXES}
    reach = F.explode(F.array(*(F.struct(*(F.lit(d).alias(c) for c, d in zip(cell, s, strict=True))) for s in product((-1, 0, 1), repeat=3)))).alias("__d")
    near = picks.withColumns(cell).select(F.col("__g").alias("__h"), *(F.col(a).alias(f"__{a}") for a in boxes.AXES), *cell, reach)
    near = near.select("__h", *(f"__{a}" for a in boxes.AXES), *((F.col(c) + F.col(f"__d.{c}")).alias(c) for c in cell))
    own = rows.withColumns(cell)
    square = sum(((F.col(a) - F.col(f"__{a}")) * (F.col(a) - F.col(f"__{a}")) for a in ("y", "x")), (F.col("z") - F.col("__z")) * (F.col("z") - F.col("__z")))
    return own.join(near, [own["__g"] == near["__h"], *(own[c] == near[c] for c in cell), square < radius * radius], "left_anti").drop(*cell)


def faces(voxels: DataFrame, *keys: str) -> DataFrame:
    """(keys, lo, hi, n): contacts of unlike labels across voxel faces; label 0 is background. voxels: (keys, z, y, x, label),
    whole within the keys. Three windows with lead(), one an axis, instead of self joins."""
    parts = []
    for axis in boxes.AXES:
        rest = [a for a in boxes.AXES if a != axis]
        w = W.partitionBy(*keys, *rest).orderBy(axis)
        rows = voxels.withColumns({"next": F.lead("label").over(w), "step": F.lead(axis).over(w) - F.col(axis)})
        rows = rows.where("step = 1 AND label <> next AND label <> 0 AND next <> 0")
        parts.append(rows.select(*keys, F.least("label", "next").alias("lo"), F.greatest("label", "next").alias("hi")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys, "lo", "hi").agg(F.count("*").alias("n"))


def objects(voxels: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, n, centre and box) of each label but 0."""
    parts = [f for a in boxes.AXES for f in (F.avg(a).alias(f"c{a}"), F.min(a).alias(f"{a}0"), (F.max(a) + 1).alias(f"{a}1"))]
    return voxels.where("label <> 0").groupBy(*keys, "label").agg(F.count("*").alias("n"), *parts)


def unrolled(blocks: DataFrame, id_: str, values: str, shape: tuple[int, int, int]) -> DataFrame:
    """(id, z, y, x, value) of dense blocks held as arrays in C order."""
    _, ny, nx = shape
    rows = blocks.select(id_, F.posexplode(values).alias("at", "value"))
    return rows.select(id_, F.expr(f"at div {ny * nx}").cast("int").alias("z"), F.expr(f"at div {nx} % {ny}").cast("int").alias("y"), F.expr(f"at % {nx}").cast("int").alias("x"), "value")


def smoothed(blocks: DataFrame, id_: str, values: str, shape: tuple[int, int, int]) -> DataFrame:
    """(id, values): each block's mean over a voxel and its face neighbours (a border voxel stands in for its absent ones).
    Dense arithmetic stays within a block, in numpy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.pad(np.stack(pdf[values].to_list()).reshape(-1, *shape).astype(np.float64), ((0, 0), (1, 1), (1, 1), (1, 1)), mode="edge")
                core = v[:, 1:-1, 1:-1, 1:-1]
                total = core + v[:, :-2, 1:-1, 1:-1] + v[:, 2:, 1:-1, 1:-1] + v[:, 1:-1, :-2, 1:-1] + v[:, 1:-1, 2:, 1:-1] + v[:, 1:-1, 1:-1, :-2] + v[:, 1:-1, 1:-1, 2:]
                yield pd.DataFrame({id_: pdf[id_], values: list((total / 7).reshape(len(pdf), -1))})

    return blocks.select(id_, values).mapInPandas(run, f"{id_} {blocks.schema[id_].dataType.simpleString()}, {values} array<double>")


def row_major_key(df: DataFrame, ny: int, nx: int) -> DataFrame:
    return df.withColumn("key", row_major(F.col("iz"), F.col("iy"), F.col("ix"), ny, nx))


def steps(voxels: DataFrame, key: str, value: str, *more: str) -> DataFrame:
    """(key, axis, value, next, and next of more columns): each voxel with the one after it along each axis. Voxels meet by
    their places, in one exchange for all axes."""
    shift = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), *((F.col(b) - (1 if a == b else 0)).alias(b) for b in boxes.AXES)) for a in boxes.AXES)))
    after = voxels.select(key, F.col(value).alias("next"), *(F.col(m).alias(f"next_{m}") for m in more), shift.alias("at")).select(key, "next", *(f"next_{m}" for m in more), "at.*")
    return voxels.select(key, *boxes.AXES, value, *more).join(after, [key, *boxes.AXES]).drop(*boxes.AXES)


def contacts(voxels: DataFrame, key: str, value: str) -> DataFrame:
    """(key, lo, hi, value): a row for each face between unlike labels other than 0, with the mean of the two values."""
    rows = steps(voxels, key, value, "label").where("label <> next_label AND label <> 0 AND next_label <> 0")
    return rows.select(key, F.least("label", "next_label").alias("lo"), F.greatest("label", "next_label").alias("hi"), ((F.col(value) + F.col("next")) / 2).alias("value"))


def contact_figures(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, mean, low, high, percentiles) of the values of contacts."""
    rows = cut(rows)
    figures = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return with_quantiles(figures, rows, by, "value", {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})


def with_halo(grid: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], halo: tuple[int, int, int]) -> DataFrame:
    """Tiles with the box to read (r...), wider by the halo within the volume, and how many tiles share a face with them."""
    faces = F.lit(0)
    for axis, whole, step, more in zip(boxes.AXES, shape, size, halo, strict=True):
        grid = grid.withColumns({f"r{axis}0": F.greatest(F.lit(0), F.col(f"{axis}0") - more), f"r{axis}1": F.least(F.lit(whole), F.col(f"{axis}1") + more)})
        faces = faces + (F.col(f"i{axis}") > 0).cast("int") + (F.col(f"i{axis}") < -(-whole // step) - 1).cast("int")
    return grid.withColumn("faces", faces)


def far_from(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """The points (id, z, y, x) with none of the others closer than the radius. Points meet in cells of the radius's size."""
    cell = {f"c{a}": F.floor(F.col(a) / radius).cast("long") for a in boxes.AXES}
    own = points.withColumns(cell)
    reach = F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for a, d in zip(boxes.AXES, s, strict=True))) for s in product((-1, 0, 1), repeat=3)))).alias("d")
    near = others.distinct().withColumns(cell).select(*(F.col(a).alias(f"o{a}") for a in boxes.AXES), *cell, reach)
    near = near.select(*(f"o{a}" for a in boxes.AXES), *((F.col(f"c{a}") + F.col(f"d.d{a}")).alias(f"c{a}") for a in boxes.AXES))
    square = sum(((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in ("y", "x")), (F.col("z") - F.col("oz")) * (F.col("z") - F.col("oz")))
    close = [own[c] == near[c] for c in cell]
    return own.join(near, [*close, square < radius * radius], "left_anti").drop(*cell)
