"""Objects in volumes of many blocks: connected components, flooding from markers, agglomeration of regions.

Each works within a block in numpy and settles what crosses borders by joins over faces or slabs, in rounds that end in the
shared folder; results are those of one undivided volume.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquarry.operators import graph
from meshquarry.operators.blocks import _KEY, KEY, Grid, bricks, coarse, cut_up, spread, with_neighbours
from meshquarry.operators.relational import numbered
from meshquarry.storage import cut, stored


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n things linked by pairs (a, b), each one's component, named by its smallest member."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def block_components(labels: np.ndarray) -> np.ndarray:
    """Of a block's voxels the component, as the first voxel's place in C order; -1 for label 0. Faces link equal labels."""
    at = np.arange(labels.size).reshape(labels.shape)
    pairs = []
    for axis in range(3):
        lo, hi = (tuple(s if i == axis else slice(None) for i in range(3)) for s in (slice(None, -1), slice(1, None)))
        same = (labels[lo] == labels[hi]) & (labels[lo] != 0)
        pairs.append((at[lo][same], at[hi][same]))
    root = joined(labels.size, *(np.concatenate(p) for p in zip(*pairs, strict=True)))
    return np.where(labels.ravel() != 0, root, -1)


def _parts(blocks: DataFrame, grid: Grid, column: str) -> tuple[DataFrame, Grid]:
    """Bricks of blocks with node, of each voxel the number of the first voxel of its component within the brick, or -1; the
    components' nodes, labels and sizes; labels and nodes of the two faces along each axis. And the bricks' grid."""
    wide = coarse(grid)

    def run(key: tuple, whole: dict[str, np.ndarray], known: np.ndarray) -> dict:
        label = whole["label"]
        own = block_components(label)
        node = np.where(own >= 0, wide.voxels(key[0], key[1:])[own], -1)
        some = np.flatnonzero(own >= 0)
        at, n = np.unique(own[some], return_counts=True)
        faces = [[v.reshape(label.shape).take(side, axis).ravel() for axis in range(3) for side in (0, -1)] for v in (label, node)]
        return {"known": known.ravel(), "node": node, "first": node[at], "label": label.ravel()[at], "n": n, "labels": faces[0], "nodes": faces[1]}

    rows = blocks.select(*KEY, F.col(column).cast("array<bigint>").alias("label"))
    kinds = "known array<boolean>, node array<bigint>, first array<bigint>, label array<bigint>, n array<bigint>, labels array<array<bigint>>, nodes array<array<bigint>>"
    return bricks(rows, grid, ["label"], run, kinds)


def _face_links(parts: DataFrame) -> DataFrame:
    """(a, b): nodes of equal labels that meet where two bricks touch. Only the faces are shuffled."""

    def side(far: int, p: str) -> DataFrame:
        found = None
        for axis, b in enumerate(KEY[1:]):
            face = parts.withColumn(b, F.col(b) + far).select(*KEY, F.lit(axis).alias("axis"), *(F.col(c)[2 * axis + far].alias(f"{p}{c}") for c in ("labels", "nodes")))
            found = face if found is None else found.unionByName(face)
        return found

    both = side(1, "a").join(side(0, "b"), [*KEY, "axis"])
    pairs = both.select(F.explode(F.arrays_zip("alabels", "anodes", "blabels", "bnodes")).alias("f")).select("f.*")
    return pairs.where("alabels = blabels AND anodes >= 0 AND bnodes >= 0").select(F.col("anodes").alias("a"), F.col("bnodes").alias("b")).distinct()


def _members(parts: DataFrame) -> DataFrame:
    """(key, node, label, root, n): the components' parts in each brick, with the component that they belong to, named by its first
    voxel."""
    rows = parts.select(*KEY, F.explode(F.arrays_zip("first", "label", "n")).alias("p")).select(*KEY, F.col("p.first").alias("node"), "p.label", "p.n")
    return rows.join(graph.components(_face_links(parts)), "node", "left").withColumn("root", F.coalesce("root", "node"))


def component_table(blocks: DataFrame, grid: Grid, column: str) -> DataFrame:
    """(volume, component, label, n): connected components of equal labels other than 0, across all blocks; faces connect.
    A component is named by the number of its first voxel (Grid.voxels). Blocks go into bricks, and after that no voxels are sent but those of the bricks' faces."""
    rows = _members(stored(_parts(blocks, grid, column)[0], "parts"))
    return rows.groupBy("volume", F.col("root").alias("component")).agg(F.first("label").alias("label"), F.sum("n").alias("n"))


def components(blocks: DataFrame, grid: Grid, column: str, least: int = 1, dense: bool = True) -> DataFrame:
    """(key, component): for each voxel its component, among those with at least `least` voxels; else 0. Dense numbers go from 1
    in order of the first voxels, over all volumes; otherwise a component is its first voxel's number plus one."""
    parts, wide = _parts(blocks, grid, column)
    parts = stored(parts, "parts")
    members = stored(_members(parts), "members")
    kept = members.groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("root")
    kept = numbered(kept, ["root"], "component") if dense else kept.withColumn("component", F.col("root") + 1)
    named = members.join(kept, "root").select(*KEY, "node", "component")

    def paint(own: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=[*KEY, "component"])
        node = np.asarray(own["node"].iloc[0])
        names = names.sort_values("node")
        known, number = names["node"].to_numpy(np.int64), names["component"].to_numpy(np.int64)
        out = np.zeros(len(node), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, node), len(known) - 1)
            out = np.where(known[at] == node, number[at], 0)
        return cut_up([int(k) for k in own[KEY].iloc[0]], wide, grid, np.asarray(own["known"].iloc[0]), component=out)

    return spread(parts.select(*KEY, "known", "node")).groupBy(*KEY).cogroup(named.groupBy(*KEY)).applyInPandas(paint, f"{_KEY}, component array<bigint>")


def label_pieces(blocks: DataFrame, grid: Grid, column: str) -> DataFrame:
    """(volume, label, n, pieces, largest, share): into how many components a label falls, and how much the largest holds."""
    by = component_table(blocks, grid, column).groupBy("volume", "label").agg(F.sum("n").alias("n"), F.count("*").alias("pieces"), F.max("n").alias("largest"))
    return by.withColumn("share", F.col("largest") / F.col("n"))


# Flooding. A voxel is reached at a level (the least that the highest voxel of a path from a marker can be) after a number of
# steps at that level; markers are reached before all levels. Both are kept in one number.
_STEPS = 1 << 32
_NEVER = np.int64((1 << 62) - 1)


def _next(cost: np.ndarray, level: np.ndarray) -> np.ndarray:
    """When a voxel of that level is reached from one reached at `cost`."""
    at = cost // _STEPS  # markers: 0, level l: l + 1
    return np.where(cost == _NEVER, _NEVER, np.where(level + 1 > at, (level + 1) * _STEPS + 1, cost + 1))


def _flood(level: np.ndarray, cost: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Costs after all paths within a widened block, with what is known of its surroundings; only `free` voxels change. Buckets
    of equal cost are settled in order."""
    wide = level.shape
    strides = np.array([wide[1] * wide[2], wide[2], 1])
    level, cost, free = level.ravel(), cost.ravel().copy(), free.ravel()
    some = np.flatnonzero(cost < _NEVER)
    buckets = {int(k): [some[cost[some] == k]] for k in np.unique(cost[some])}
    queue = list(buckets)
    heapq.heapify(queue)
    while queue:
        key = heapq.heappop(queue)
        at = np.concatenate(buckets.pop(key))
        at = at[cost[at] == key]
        to = (at[:, None] + np.concatenate([strides, -strides])).ravel()
        to = np.unique(to[(to >= 0) & (to < len(cost))])  # the rim is never free, so no step leads around it
        to = to[free[to]]
        then = _next(np.full(len(to), key, np.int64), level[to])
        better = then < cost[to]
        to, then = to[better], then[better]
        cost[to] = then
        for k in np.unique(then).tolist():
            if k not in buckets:
                heapq.heappush(queue, k)
                buckets[k] = []
            buckets[k].append(to[then == k])
    return cost.reshape(wide)


def _claim(level: np.ndarray, cost: np.ndarray, label: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Labels under final costs: each free voxel takes the smallest label among the voxels that it was reached from."""
    wide = level.shape
    strides = np.array([wide[1] * wide[2], wide[2], 1])
    level, cost, label, free = level.ravel(), cost.ravel(), label.ravel().copy(), free.ravel()
    todo = np.flatnonzero(free & (cost < _NEVER) & (cost > 0))
    label[todo] = 0
    todo = todo[np.argsort(cost[todo], kind="stable")]
    ends = np.flatnonzero(np.r_[np.diff(cost[todo]) != 0, True]) + 1 if len(todo) else []
    begin = 0
    none = np.iinfo(np.int64).max
    for end in ends:
        at = todo[begin:end]
        begin = end
        nearby = at[:, None] + np.concatenate([strides, -strides])
        here = (nearby >= 0) & (nearby < len(cost))
        nearby = np.where(here, nearby, 0)
        source = here & (label[nearby] > 0) & (_next(cost[nearby], level[at][:, None]) == cost[at][:, None])
        best = np.where(source, label[nearby], none).min(1)
        label[at] = np.where(best == none, 0, best)
    return label.reshape(wide)


def watershed(blocks: DataFrame, grid: Grid, level: str, marker: str) -> DataFrame:
    """(key, basin): every voxel taken by a marker (a number over 0) as water rises level by level (whole numbers from 0; below 0
    is never flooded). At a level, basins grow in steps over faces through all voxels of at most that level; where
    several arrive at a voxel in the same step, the smallest marker takes it. Voxels that no marker reaches are 0.

    First the step at which each voxel is reached is settled, then who takes it, each in rounds: a brick of blocks floods
    itself, and sends its outermost voxels to its neighbours where they changed. There are about as many rounds as bricks on
    the longest way from a marker; the result is that of one block.
    """
    reach = (1, 1, 1)
    core = (slice(1, -1),) * 3

    def settle(row: pd.Series, padded: dict[str, np.ndarray], known: np.ndarray) -> dict:
        # of a neighbour the costs are known; its levels don't matter
        cost = np.where(known, padded["cost"], _NEVER)
        free = np.zeros(known.shape, bool)
        levels = np.full(known.shape, -1, np.int64)
        levels[core] = np.asarray(row["level"]).reshape(cost[core].shape)
        free[core] = (levels[core] >= 0) & (cost[core] > 0)
        after = _flood(levels, cost, free)
        return {"level": row["level"], "marker": row["marker"], "cost": after[core].ravel(), "changed": bool((after[core] != cost[core]).any())}

    def begin(key: tuple, whole: dict[str, np.ndarray], known: np.ndarray) -> dict:
        marker = np.where(known, np.maximum(whole["marker"], 0), -1)  # -1: of absent blocks, which nothing reaches
        return {"level": np.where(known, whole["level"], -1).ravel(), "marker": marker.ravel(), "cost": np.where(marker > 0, 0, _NEVER).ravel(), "changed": True}

    kinds = "level array<bigint>, marker array<bigint>, cost array<bigint>, changed boolean"
    rows = blocks.select(*KEY, F.col(level).cast("array<bigint>").alias("level"), F.col(marker).cast("array<bigint>").alias("marker"))
    small, (state, grid) = grid, bricks(rows, grid, ["level", "marker"], begin, kinds)
    state = stored(state, "levels")
    while True:
        state = stored(with_neighbours(state, grid, ["cost"], reach, settle, kinds, state.where("changed")), "levels")
        if state.where("changed").isEmpty():
            break

    def claim(row: pd.Series, padded: dict[str, np.ndarray], known: np.ndarray) -> dict:
        cost = np.where(known, padded["cost"], _NEVER)
        free = np.zeros(known.shape, bool)
        levels = np.full(known.shape, -1, np.int64)
        levels[core] = np.asarray(row["level"]).reshape(cost[core].shape)
        free[core] = cost[core] > 0
        after = _claim(levels, cost, padded["basin"], free)
        return {"level": row["level"], "cost": row["cost"], "basin": after[core].ravel(), "changed": bool((after[core] != padded["basin"][core]).any())}

    kinds = "level array<bigint>, cost array<bigint>, basin array<bigint>, changed boolean"
    state = state.select(*KEY, "level", "cost", F.col("marker").alias("basin"))
    while True:
        state = stored(with_neighbours(state, grid, ["cost", "basin"], reach, claim, kinds), "basins")
        if state.where("changed").isEmpty():
            break
        state = state.drop("changed")

    def back(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        basin = np.asarray(own["basin"].iloc[0])
        return cut_up([int(k) for k in key], grid, small, basin >= 0, basin=basin)

    return spread(state.select(*KEY, "basin")).groupBy(*KEY).applyInPandas(back, f"{_KEY}, basin array<bigint>")


def log_odds(mean: Column, least: float = 1e-6) -> Column:
    """Of a mean affinity between 0 and 1; over 0 speaks for one object."""
    p = F.least(F.greatest(mean, F.lit(least)), F.lit(1 - least))
    return F.log(p / (1 - p))


#: Affinities are added up as whole numbers of this fraction, so that sums don't depend on their order.
UNIT = 1 << 20


def region_edges(contacts: DataFrame, *keys: str) -> DataFrame:
    """(keys, lo, hi, total, n) from contacts (keys, lo, hi, value): the affinities between two regions, added up in UNITs."""
    return contacts.groupBy(*keys, "lo", "hi").agg(F.sum(F.round(F.col("value") * UNIT).cast("long")).alias("total"), F.count("*").alias("n"))


def touching(blocks: DataFrame, grid: Grid, region: str, affinity: str) -> DataFrame:
    """(volume, lo, hi, total, n) of every two regions (numbers other than 0) that share voxel faces, over all blocks: how many
    faces, and the sum in UNITs of the smaller affinity of the two voxels at each. A block counts the faces within it and those to the
    blocks after it, and sends sums alone on."""

    def run(row: pd.Series, padded: dict[str, np.ndarray], known: np.ndarray) -> dict:
        core, found = (slice(1, -1),) * 3, []
        for axis in range(3):
            after = tuple(slice(2, None) if i == axis else slice(1, -1) for i in range(3))
            a, b = padded[region][core], padded[region][after]
            some = known[after] & (a != b) & (a != 0) & (b != 0)
            value = np.rint(np.minimum(padded[affinity][core], padded[affinity][after])[some] * UNIT).astype(np.int64)
            found.append(np.stack([np.minimum(a, b)[some], np.maximum(a, b)[some], value]))
        lo, hi, value = np.concatenate(found, axis=1)
        pairs, at = np.unique(np.stack([lo, hi]), axis=1, return_inverse=True)
        n, total = np.bincount(at.ravel(), minlength=pairs.shape[1]), np.zeros(pairs.shape[1], np.int64)
        np.add.at(total, at.ravel(), value)
        return {"faces": [dict(zip(("lo", "hi", "total", "n"), map(int, x), strict=True)) for x in zip(*pairs, total, n, strict=True)]}

    whole = lambda key, columns, known: {c: v.ravel() for c, v in columns.items()}  # noqa: E731  absent: region 0
    rows, grid = bricks(blocks.select(*KEY, F.col(region).cast("array<bigint>").alias(region), F.col(affinity).cast("array<double>").alias(affinity)), grid, [region, affinity], whole, f"{region} array<bigint>, {affinity} array<double>")
    rows = with_neighbours(stored(rows, "regions"), grid, [region, affinity], (1, 1, 1), run, "faces array<struct<lo: long, hi: long, total: long, n: long>>")
    by = rows.select("volume", F.explode("faces").alias("f")).groupBy("volume", "f.lo", "f.hi")
    return by.agg(F.sum("f.total").alias("total"), F.sum("f.n").alias("n"))


def agglomerated(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """(node, root) of every region on an edge (lo, hi, total, n): regions joined greedily while the best mean affinity of two is
    at least `least`. Joining adds up parallel edges. Of equal means the edge goes first whose first original pair of
    regions is first. A root is the smallest region of its object.

    In a round every pair that is the best of both its regions is joined. A joined edge's mean is never above the better of
    its two, and of equal ones it keeps the earlier place; so such a pair stays best whatever else is joined, and the result is
    that of joining one at a time. A round costs in proportion to the edges left; a chain of ever better edges takes the most rounds.
    """
    mean = F.col("total") / UNIT / F.col("n")
    rest = cut(edges.where("lo <> hi").groupBy(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).agg(F.sum("total").alias("total"), F.sum("n").alias("n")).withColumn("first", F.struct("lo", "hi")))
    nodes = rest.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()
    merged = None
    while True:
        good = rest.where(mean >= least).select("lo", "hi", F.struct((-mean).alias("m"), "first").alias("rank"))
        best = good.select(F.explode(F.array("lo", "hi")).alias("node"), "rank").groupBy("node").agg(F.min("rank").alias("best"))
        pairs = good.join(best.withColumnsRenamed({"node": "lo", "best": "a"}), "lo").where("rank = a").join(best.withColumnsRenamed({"node": "hi", "best": "b"}), "hi").where("rank = b").select("lo", "hi")
        pairs = cut(pairs)
        if pairs.isEmpty():
            break
        merged = pairs if merged is None else merged.unionByName(pairs)
        to = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("to"))
        for end in ("lo", "hi"):
            rest = rest.join(to.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        rest = rest.where("lo <> hi").groupBy(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("first").alias("first"))
        rest = cut(rest)
    if merged is None:
        return nodes.withColumn("root", F.col("node"))
    roots = graph.components(merged.toDF("a", "b"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
