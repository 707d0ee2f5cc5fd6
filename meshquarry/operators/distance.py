"""Exact distances to the border of an object in volumes of many blocks, and what they say about its shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.operators import segments
from meshquarry.operators.blocks import _KEY, KEY, Grid, as_voxels, bricks, cut_up, spread, with_neighbours
from meshquarry.storage import stored

#: Stands for no border on any line so far.
FAR = np.int64(1 << 40)
#: Stands for voxels that are not there.
VOID = np.iinfo(np.int64).min
#: How far around a brick its distances are looked for first.
REACH = 8


def envelope(labels: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Of lines (rows are places, columns are lines) the least f[j] + (i - j)^2 over the j that the line reaches from i
    within the same label; the first voxel of another label on either side counts as f = 0, the lines' ends and VOID do not.

    The lower envelope of the parabolas of each stretch (Felzenszwalb and Huttenlocher, 2012), all lines side by side.
    """
    n, lines = f.shape
    every = np.arange(lines)
    place = np.zeros((3 * n + 2, lines), np.int64)  # the parabolas of the envelope, stretch after stretch
    height = np.zeros((3 * n + 2, lines), np.int64)
    since = np.zeros((3 * n + 2, lines), np.float64)  # from where on each is the lowest
    top, base = np.full(lines, -1), np.zeros(lines, np.int64)
    first, last = np.zeros((n, lines), np.int64), np.zeros((n, lines), np.int64)

    def push(who: np.ndarray, at: int, value: np.ndarray) -> None:
        at_from = np.full(len(who), -np.inf)
        open_ = np.arange(len(who))
        while len(open_):
            w = who[open_]
            some = top[w] >= base[w]
            open_, w = open_[some], w[some]
            k = top[w]
            v = place[k, w]
            s = (value[open_] + at * at - height[k, w] - v * v) / (2.0 * (at - v))
            beaten = s <= since[k, w]
            at_from[open_[~beaten]] = s[~beaten]
            top[w[beaten]] -= 1
            open_ = open_[beaten]
        top[who] += 1
        place[top[who], who], height[top[who], who], since[top[who], who] = at, value, at_from

    begun = np.zeros(lines, np.int64)  # where the stretch began
    for q in range(n):
        if q:
            new = np.flatnonzero(labels[q] != labels[q - 1])
            if len(new):
                met = new[(labels[q, new] != VOID) & (labels[q - 1, new] != VOID)]
                push(met, q, np.zeros(len(met), np.int64))
                for w in new:
                    last[begun[w] : q, w] = top[w]
                base[new], begun[new] = top[new] + 1, q
                push(met, q - 1, np.zeros(len(met), np.int64))
        near = every[f[q] < FAR]
        push(near, q, f[q, near])
        first[q] = base
    for w in every:
        last[begun[w] :, w] = top[w]
    out, p = np.full((n, lines), FAR), np.full(lines, -1)
    for i in range(n):
        p = np.maximum(p, first[i])
        while True:
            further = (p < last[i]) & (since[np.minimum(p + 1, 3 * n + 1), every] < i)
            if not further.any():
                break
            p = p + further
        some = every[p <= last[i]]
        out[i, some] = height[p[some], some] + (i - place[p[some], some]) ** 2
    return np.minimum(out, FAR)


def _pass(rows: DataFrame, grid: Grid, axis: int) -> DataFrame:
    """One axis: lines are put together from blocks, a bundle of one row of a block's cross-section at a time, worked off, and
    dealt back. A bundle is as long as the volume and as wide as a block."""
    other = [a for a in range(3) if a != axis]

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                block, d = [int(i) for i in row[1:4]], grid.extent(row[1:4])
                label, f = (np.moveaxis(np.asarray(v).reshape(d), (axis, *other), (1, 0, 2)) for v in row[4:6])
                out += [(row[0], block[other[0]], block[other[1]], r, block[axis], label[r].ravel(), f[r].ravel()) for r in range(len(label))]
            yield pd.DataFrame(out, columns=["volume", "p", "q", "r", "at", "label", "f"])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        """Stretches between absent blocks stand alone."""
        pdf = pdf.sort_values("at")
        at, out = pdf["at"].to_numpy(), []
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 1) + 1):
            extent = [grid.extent([0 if a != axis else k for a in range(3)])[axis] for k in at[part]]
            label, f = (np.concatenate([np.asarray(v).reshape(e, -1) for v, e in zip(pdf[c].iloc[part], extent, strict=True)]) for c in ("label", "f"))
            done = envelope(label, f)
            ends = np.cumsum(extent)
            out += [done[e - n : e].ravel() for e, n in zip(ends, extent, strict=True)]
        return pdf.assign(f=out)

    def put_back(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        one = pdf.iloc[0]
        block = [0, 0, 0]
        block[axis], block[other[0]], block[other[1]] = int(one["at"]), int(one["p"]), int(one["q"])
        d = grid.extent(block)
        whole = [np.moveaxis(np.stack([np.asarray(v) for v in pdf[c]]).reshape(d[other[0]], d[axis], d[other[1]]), (1, 0, 2), (axis, *other)).ravel() for c in ("label", "f")]
        return pd.DataFrame([(one["volume"], *block, *whole)], columns=[*KEY, "label", "f"])

    lines = "volume long, p int, q int, r int, at int, label array<bigint>, f array<bigint>"
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    worked = rows.mapInPandas(cut_up, lines).repartition(n, "volume", "p", "q", "r").groupBy("volume", "p", "q", "r").applyInPandas(work, lines)
    return worked.repartition(n, "volume", "p", "q", "at").groupBy("volume", "p", "q", "at").applyInPandas(put_back, f"{_KEY}, label array<bigint>, f array<bigint>")


def _along_lines(rows: DataFrame, grid: Grid) -> DataFrame:
    """(key, label, f): the distances over lines as long as the volume. One pass an axis, each with two shuffles; a task holds one
    bundle of lines."""
    rows = rows.withColumn("f", F.transform("label", lambda _: F.lit(int(FAR))))
    for axis in (2, 1, 0):
        rows = stored(_pass(rows, grid, axis), "distances")
    return rows


def _nearby(rows: DataFrame, grid: Grid, reach: int) -> tuple[DataFrame, Grid]:
    """Bricks (key, label, known, f, settled) with the distances that lines of a brick, widened by `reach`, tell; and the bricks' grid.
    The way to a nearest voxel of another label leaves no axis further than its distance, so what is found at most reach + 1 away
    is exact."""
    hold = lambda key, whole, known: {"label": whole["label"].ravel(), "known": known.ravel()}
    rows, wide = bricks(rows, grid, ["label"], hold, "label array<bigint>, known array<boolean>")

    def run(row: pd.Series, padded: dict[str, np.ndarray], known: np.ndarray) -> dict:
        there = known & padded["known"]
        label, f = np.where(there, padded["label"], VOID), np.full(there.shape, FAR)
        inside = tuple(slice(int(p.min()), int(p.max()) + 1) for p in np.nonzero(there))
        for axis in (2, 1, 0):
            turned = [np.moveaxis(v[inside], axis, 0) for v in (label, f)]
            done = envelope(*(v.reshape(len(v), -1) for v in turned))
            f[inside] = np.moveaxis(done.reshape(turned[1].shape), 0, axis)
        core = (slice(reach, -reach),) * 3
        label, f, here = label[core], f[core], there[core]
        at = [int(row[b]) for b in KEY[1:]]
        whole = all(o <= reach and o + e + reach >= n for o, e, n in zip(wide.origin(at), wide.extent(at), wide.shape, strict=True))
        sure = whole or bool((f[here & (label != 0)] <= (reach + 1) ** 2).all())
        return {"label": row["label"], "known": row["known"], "f": f.ravel(), "settled": sure}

    kinds = "label array<bigint>, known array<boolean>, f array<bigint>, settled boolean"
    return with_neighbours(stored(rows, "bricks"), wide, ["label", "known"], (reach,) * 3, run, kinds), wide


def squared_distances(blocks: DataFrame, grid: Grid, column: str) -> DataFrame:
    """(key, label, d2): of each voxel of a label other than 0 the squared distance to the nearest voxel of another label, exact,
    across all blocks; 0 on label 0, null where the volume has no other label in reach of its lines. The volume's ends and absent
    blocks are no border.

    A task works a brick of blocks off with REACH voxels around it. Where an object is so thick that this doesn't settle all,
    the lines of the whole volume are worked off, a bundle a task."""
    rows = blocks.select(*KEY, F.col(column).cast("array<bigint>").alias("label"))
    near, wide = _nearby(rows, grid, REACH)
    near = stored(near, "distances")
    if near.where("NOT settled").isEmpty():

        def back(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            known, label, f = (np.asarray(own[c].iloc[0]) for c in ("known", "label", "f"))
            return cut_up([int(k) for k in key], wide, grid, known, label=label, f=f)

        rows = spread(near.drop("settled")).groupBy(*KEY).applyInPandas(back, f"{_KEY}, label array<bigint>, f array<bigint>")
    else:
        rows = _along_lines(rows, grid)
    d2 = F.transform(F.arrays_zip("label", "f"), lambda v: F.when(v["label"] == 0, F.lit(0).cast("long")).when(v["f"] < int(FAR), v["f"]))
    return rows.select(*KEY, "label", d2.alias("d2"))


def slice_table(blocks: DataFrame, grid: Grid, column: str) -> DataFrame:
    """(volume, label, z, area, radius, edge): a row a slice of each label: voxels, the largest distance to the border in it (null
    where none has one), and how many of its voxels lie on the volume's ends."""
    rows = as_voxels(squared_distances(blocks, grid, column), grid, "label", "d2").where("label <> 0")
    end = F.lit(False)
    for a, n in zip("zyx", grid.shape, strict=True):
        end = end | (F.col(a) == 0) | (F.col(a) == n - 1)
    return rows.groupBy("volume", "label", "z").agg(F.count("*").alias("area"), F.sqrt(F.max("d2")).alias("radius"), F.count_if(end).alias("edge"))


def morphology(blocks: DataFrame, grid: Grid, column: str, tiny: int, jump: float, neck: float, apart: float = 0.0) -> DataFrame:
    """(volume, label, n, pieces, share, slices, radius, and flags): a row a label.

    tiny: fewer than `tiny` voxels. disconnected: several pieces of which the largest holds less than 1 - `apart`. orphan:
    doesn't reach an end of the volume. jumps: consecutive slices whose diameters (of circles with their areas) differ by
    a factor of `jump` or more. necks: slices, neither the first nor the last, whose radius and diameter are both at most
    `neck` times the largest ones before them and after them."""
    s = stored(slice_table(blocks, grid, column), "slices")
    w = W.partitionBy("volume", "label").orderBy("z")
    width = 2 * F.sqrt(F.col("area") / F.lit(np.pi))
    sides = [w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)]
    narrow = lambda c: F.col(c) <= neck * F.least(*(F.max(c).over(side) for side in sides))
    ratio = F.greatest("width", F.col("last")) / F.least("width", F.col("last"))
    rows = s.withColumn("width", width)
    neck_here = F.row_number().over(w).between(2, F.count("*").over(W.partitionBy("volume", "label")) - 1) & narrow("radius") & narrow("width")
    rows = rows.withColumns({"last": F.when(F.lag("z").over(w) == F.col("z") - 1, F.lag("width").over(w)), "neck": neck_here})
    by = rows.groupBy("volume", "label").agg(
        F.sum("area").alias("n"), F.count("*").alias("slices"), F.max("radius").alias("radius"), (F.sum("edge") == 0).alias("orphan"),
        F.count_if(ratio >= jump).alias("jumps"), F.count_if("neck").alias("necks"),
    )
    whole = segments.label_pieces(blocks, grid, column).select("volume", "label", "pieces", "share")
    return by.join(whole, ["volume", "label"]).withColumns({"tiny": F.col("n") < tiny, "disconnected": (F.col("pieces") > 1) & (F.col("share") < 1 - apart)})


def flagged(table: DataFrame) -> Column:
    """An array with the names of a morphology() row's flags."""
    names = {"tiny": F.col("tiny"), "disconnected": F.col("disconnected"), "orphan": F.col("orphan"), "jump": F.col("jumps") > 0, "neck": F.col("necks") > 0}
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in names.items())))
