"""Volumes of several blocks against plain walks over one undivided array."""

import random
from itertools import product

import numpy as np
import pytest

from meshquarry.operators import blocks as B
from meshquarry.operators import distance as D
from meshquarry.operators import segments as S

SHAPE = (9, 11, 10)
GRIDS = [B.Grid(SHAPE, size) for size in ((4, 4, 4), (3, 5, 10), (9, 11, 10))]
STEPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def table(spark, grid, volumes, **columns):
    """Blocks of whole arrays, one array a volume and column."""
    kinds = {"f": "double", "i": "bigint"}
    names, rows = list(columns), []
    for v in range(volumes):
        for block in product(*(range(-(-n // s)) for n, s in zip(grid.shape, grid.size, strict=True))):
            at = tuple(slice(o, o + d) for o, d in zip(grid.origin(block), grid.extent(block), strict=True))
            rows.append((v, *block, *(columns[c][v][at].ravel().tolist() for c in names)))
    return spark.createDataFrame(rows, B._KEY + "".join(f", {c} array<{kinds[columns[c][0].dtype.kind]}>" for c in names))


def whole(df, grid, column):
    out = {}
    for r in B.as_voxels(df, grid, column).collect():
        out.setdefault(r.volume, np.full(grid.shape, -9, object))[r.z, r.y, r.x] = r[column]
    return out


def around(p, shape):
    for d in STEPS:
        q = tuple(a + b for a, b in zip(p, d, strict=True))
        if all(0 <= a < n for a, n in zip(q, shape, strict=True)):
            yield q


def walk_components(labels):
    seen, out = set(), []
    for p in np.ndindex(labels.shape):
        if labels[p] and p not in seen:
            part, todo = [], [p]
            seen.add(p)
            while todo:
                c = todo.pop()
                part.append(c)
                for q in around(c, labels.shape):
                    if q not in seen and labels[q] == labels[p]:
                        seen.add(q)
                        todo.append(q)
            out.append((labels[p], part))
    return out


@pytest.fixture(scope="module")
def labels():
    rng = np.random.default_rng(4)
    return [rng.choice(3, SHAPE, p=p).astype(np.int64) for p in ((0.6, 0.3, 0.1), (0.1, 0.5, 0.4))]


@pytest.mark.parametrize("grid", GRIDS)
def test_components_over_blocks(spark, labels, grid):
    df = table(spark, grid, 2, label=labels)
    parts = [(v, k, part) for v in range(2) for k, part in walk_components(labels[v])]
    number = lambda v, p: v * labels[0].size + int(np.ravel_multi_index(p, SHAPE))
    got = {(r.volume, r.component, r.label, r.n) for r in S.component_table(df, grid, "label").collect()}
    assert got == {(v, number(v, min(part)), k, len(part)) for v, k, part in parts}
    for least in (1, 3) if grid is GRIDS[2] else (3,):
        kept = sorted((number(v, min(part)), v, part) for v, _, part in parts if len(part) >= least)
        want = {v: np.zeros(SHAPE, object) for v in range(2)}
        for i, (_, v, part) in enumerate(kept, 1):
            for p in part:
                want[v][p] = i
        found = whole(S.components(df, grid, "label", least), grid, "component")
        assert all((found[v] == want[v]).all() for v in range(2))
    pieces = {(r.volume, r.label): (r.n, r.pieces, r.largest) for r in S.label_pieces(df, grid, "label").collect()}
    for v in range(2):
        for k in (1, 2):
            sizes = [len(part) for a, b, part in parts if (a, b) == (v, k)]
            assert pieces[v, k] == (sum(sizes), len(sizes), max(sizes))


def test_components_that_wind_through_blocks(spark):
    """One long thread, and absent blocks."""
    grid, a = B.Grid((1, 12, 12), (1, 3, 3)), np.zeros((1, 12, 12), np.int64)
    for y in range(0, 12, 2):
        a[0, y] = 1
        if y + 1 < 12:
            a[0, y + 1, 11 if y % 4 == 0 else 0] = 1
    df = table(spark, grid, 1, label=[a])
    assert [tuple(r) for r in S.component_table(df, grid, "label").collect()] == [(0, 0, 1, int(a.sum()))]
    assert S.component_table(df.where("bx <> 1"), grid, "label").count() > 1
    assert S.component_table(df.limit(0), grid, "label").collect() == S.components(df.limit(0), grid, "label").collect() == []


def flooded(level, marker):
    """One level at a time, one step at a time, over the whole array."""
    basin = marker.copy()
    for now in range(int(level.max()) + 1):
        while True:
            grown = {}
            for p in np.ndindex(level.shape):
                if basin[p] == 0 and 0 <= level[p] <= now:
                    near = [basin[q] for q in around(p, level.shape) if basin[q]]
                    if near:
                        grown[p] = min(near)
            if not grown:
                break
            for p, k in grown.items():
                basin[p] = k
    return basin


@pytest.mark.parametrize("grid", GRIDS)
def test_watershed_does_not_depend_on_blocks(spark, grid):
    rng = np.random.default_rng(8)
    level = [rng.integers(0, 5, SHAPE), rng.integers(-1, 3, SHAPE)]
    marker = [np.zeros(SHAPE, np.int64) for _ in range(2)]
    for v in range(2):
        for i in range(1, 8):
            marker[v][tuple(rng.integers(0, n) for n in SHAPE)] = i if v else 8 - i
    level[1][:, 5] = -1  # a wall
    marker[1][:, 6:] = 0
    df = table(spark, grid, 2, level=level, marker=marker)
    found = whole(S.watershed(df, grid, "level", "marker"), grid, "basin")
    for v in range(2):
        assert (found[v] == flooded(level[v], marker[v])).all()
    assert (found[1][:, 6:] == 0).all()


def test_watershed_plateau_over_many_blocks(spark):
    """Later news of a shorter way changes who takes a voxel that is reached at the same step."""
    grid = B.Grid((1, 8, 24), (1, 4, 4))
    level, marker = np.zeros((1, 8, 24), np.int64), np.zeros((1, 8, 24), np.int64)
    level[0, 3, 2:22] = 4
    level[0, :, 11] = 2
    marker[0, 0, 0], marker[0, 7, 23], marker[0, 7, 0] = 9, 2, 5
    df = table(spark, grid, 1, level=[level], marker=[marker])
    assert (whole(S.watershed(df, grid, "level", "marker"), grid, "basin")[0] == flooded(level, marker)).all()
    assert S.watershed(df.limit(0), grid, "level", "marker").collect() == []


def one_at_a_time(edges, least):
    """Always the best edge of all, over regions as sets."""
    e = {(a, b): (t, n, (a, b)) for a, b, t, n in edges}
    owner = {}
    while True:
        good = [(-(t / S.UNIT / n), f, k) for k, (t, n, f) in e.items() if t / S.UNIT / n >= least]
        if not good:
            break
        lo, hi = min(good)[2]
        owner[hi] = lo
        new = {}
        for (a, b), (t, n, f) in e.items():
            a, b = sorted(lo if x == hi else x for x in (a, b))
            if a != b:
                t0, n0, f0 = new.get((a, b), (0, 0, f))
                new[a, b] = t + t0, n + n0, min(f, f0)
        e = new
    find = lambda x: find(owner[x]) if x in owner else x
    return {x: find(x) for a, b, _, _ in edges for x in (a, b)}


@pytest.mark.parametrize("seed", range(4))
def test_agglomeration_like_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    nodes, edges = 40, {}
    for _ in range(110):
        a, b = sorted(rng.sample(range(nodes), 2))
        n = rng.randint(1, 6)
        edges[a, b] = (round(rng.choice([0.2, 0.5, 0.6, 0.9, rng.random()]) * n * S.UNIT), n)  # many equal means
    rows = [(a, b, t, n) for (a, b), (t, n) in edges.items()]
    df = spark.createDataFrame(rows, "lo long, hi long, total long, n long")
    assert {r.node: r.root for r in S.agglomerated(df, 0.55).collect()} == one_at_a_time(rows, 0.55)
    assert all(r.node == r.root for r in S.agglomerated(df, 2.0).collect()) and S.agglomerated(df.limit(0)).collect() == []


def nearest(labels):
    out = np.full(labels.shape, None, object)
    points = list(np.ndindex(labels.shape))
    for p in points:
        if labels[p] == 0:
            out[p] = 0
        else:
            other = [sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in points if labels[q] != labels[p]]
            out[p] = min(other) if other else None
    return out


@pytest.mark.parametrize("grid", GRIDS)
def test_distances_like_all_pairs(spark, grid):
    rng = np.random.default_rng(6)
    solid = np.zeros(SHAPE, np.int64)
    solid[1:8, 2:10, 1:9] = 3
    solid[4, 4, 4] = 0
    solid[2:5, 5:9, 2:6] = 7
    labels = [solid, np.full(SHAPE, 2, np.int64), rng.choice(3, SHAPE, p=(0.05, 0.9, 0.05)).astype(np.int64)]
    df = table(spark, grid, 3, label=labels)
    found = whole(D.squared_distances(df, grid, "label"), grid, "d2")
    for v in range(3):
        assert (found[v] == nearest(labels[v])).all()


def test_envelope_like_all_places():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, lines = rng.integers(1, 20), 7
        labels = np.repeat(rng.integers(0, 3, (20, lines)), rng.integers(1, 4), axis=0)[:n]
        f = np.where(rng.random((n, lines)) < 0.3, D.FAR, rng.integers(0, 40, (n, lines)))
        want = np.full((n, lines), D.FAR)
        for w in range(lines):
            for i in range(n):
                for way in (1, -1):
                    j = i
                    while 0 <= j < n:
                        same = labels[j, w] == labels[i, w]
                        want[i, w] = min(want[i, w], (f[j, w] if same else 0) + (i - j) ** 2)
                        if not same:
                            break
                        j += way
        assert (D.envelope(labels, f) == want).all()


def test_morphology_flags(spark):
    a = np.zeros((12, 9, 9), np.int64)
    a[1:5, 1:8, 1:8] = 1
    a[5:7, 4, 4] = 1  # a neck between two bodies
    a[7:11, 1:8, 1:8] = 1
    a[0, 0, 0] = 2
    a[11, 8, 8] = 2
    grid = B.Grid((12, 9, 9), (4, 4, 4))
    got = {r.label: r for r in D.morphology(table(spark, grid, 1, label=[a]), grid, "label", tiny=5, jump=3.0, neck=0.5).withColumn("flags", D.flagged(None)).collect()}
    assert got[1].flags == ["orphan", "jump", "neck"] and (got[1].pieces, got[1].jumps, got[1].necks, got[1].n) == (1, 2, 2, int((a == 1).sum()))
    assert got[2].flags == ["tiny", "disconnected"] and got[2].pieces == 2 and got[2].share == 0.5


@pytest.mark.parametrize("grid", GRIDS)
def test_smoothing_and_gradients_do_not_depend_on_blocks(spark, grid):
    rng = np.random.default_rng(3)
    v = rng.normal(size=SHAPE)
    df = table(spark, grid, 1, value=[v])
    sigma = (0.8, 1.5, 1.0)
    kernels = [B.gaussian_kernel(s) for s in sigma]
    want, r = np.zeros(SHAPE), [len(k) // 2 for k in kernels]
    for p in np.ndindex(SHAPE):
        total = weight = 0.0
        for d in product(*(range(-k, k + 1) for k in r)):
            q = tuple(a + b for a, b in zip(p, d, strict=True))
            if all(0 <= a < n for a, n in zip(q, SHAPE, strict=True)):
                w = np.prod([k[x + c] for k, x, c in zip(kernels, d, r, strict=True)])
                total, weight = total + w * v[q], weight + w
        want[p] = total / weight
    assert np.allclose(whole(B.smoothed(df, grid, "value", sigma), grid, "smooth")[0].astype(float), want)
    grad = np.sqrt(sum(g * g for g in np.gradient(v)))
    assert np.allclose(whole(B.gradient(df, grid, "value"), grid, "gradient")[0].astype(float), grad)


def test_blocks_and_voxels_are_inverse(spark, labels):
    for grid in GRIDS:
        df = table(spark, grid, 2, label=labels)
        again = B.as_blocks(B.as_voxels(df, grid, "label"), grid, "label")
        assert {tuple(r[:4]): list(r.label) for r in again.collect()} == {tuple(r[:4]): list(r.label) for r in df.collect()}




def test_watershed_and_region_queries_like_plain_walks(spark):
    """The queries on the given table, against one undivided volume."""
    import duckdb

    from meshquarry.plans import volume_catalog as V

    sf = "/root/testdata/sf0.001"
    rows = duckdb.connect().execute("WITH " + V.VOLUME.replace("FROM embeddings", f"FROM '{sf}/embeddings.parquet'") + " SELECT z, y, x, value FROM vol").fetchall()
    shape = (max(r[0] for r in rows) + 1, 8, 8)
    assert len(rows) == np.prod(shape)
    value = np.zeros(shape)
    for z, y, x, v in rows:
        value[z, y, x] = v
    level = np.clip(np.floor((value + 0.5) * 16), 0, 15).astype(np.int64)
    marker = np.where(value <= -0.27, np.arange(value.size).reshape(shape) + 1, 0)
    want = flooded(level, marker)
    found = np.zeros(shape, np.int64)
    for r in V.volume_watershed(spark, sf).collect():
        found[r.z, r.y, r.x] = r.basin
    assert (found == want).all() and (want > 0).all()
    affinity, edges = np.clip(0.5 - value, 0, 1), {}
    for p in np.ndindex(shape):
        for d in STEPS[::2]:
            q = tuple(a + b for a, b in zip(p, d, strict=True))
            if all(a < n for a, n in zip(q, shape, strict=True)) and want[p] != want[q]:
                k = tuple(sorted((int(want[p]), int(want[q]))))
                t, n = edges.get(k, (0, 0))
                edges[k] = t + round(min(affinity[p], affinity[q]) * S.UNIT), n + 1
    joined = one_at_a_time([(*k, *v) for k, v in edges.items()], 0.5)
    got = {r.basin: r.object for r in V.volume_regions(spark, sf).collect()}
    assert got == joined and len(set(joined.values())) < len(joined)


def test_paths_up_a_long_chain_and_over_forks(spark):
    """A chain of 3,000 nodes with a side arm, a second root, and a cycle that is refused."""
    from meshquarry.operators import graph as G

    nodes = [(1, i, i - 1 if i else None, float(i), 0.0, 0.0) for i in range(3000)] + [(1, 5000 + i, 5000 + i - 1 if i else 1000, 1000.0, i + 1.0, 0.0) for i in range(40)]
    nodes += [(1, 9000, None, 0.0, 0.0, 0.0), (1, 9001, 9000, 5.0, 0.0, 0.0), (2, 1, None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, z double, y double, x double")
    edges = G.tree_edges(df)
    pairs = G.leaf_pairs(df, edges, 12)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2999, 5039), (1, 2999, 9001), (1, 5039, 9001)}
    more = pairs.unionByName(spark.createDataFrame([(1, 7, 7), (1, 0, 2999), (1, 5003, 1000)], "tree long, a long, b long"))
    got = {(r.a, r.b): (r.meet, r.steps, r.length, r.tortuosity) for r in G.tortuosity(more, df, edges).collect()}
    assert got[2999, 5039][:3] == (1000, 1999 + 40, 1999.0 + 40.0) and abs(got[2999, 5039][3] - 2039 / (1999**2 + 40**2) ** 0.5) < 1e-9
    assert got[7, 7] == (7, 0, 0.0, None) and got[0, 2999][:3] == (0, 2999, 2999.0) and got[5003, 1000][:3] == (1000, 4, 4.0) and len(got) == 4
    assert len(G.lifted(edges)) == 12
    with pytest.raises(ValueError, match="cycle"):
        G.lifted(spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 1, 1.0)], "tree long, child long, parent long, length double"))


def test_bricks_do_not_change_results(spark, labels, monkeypatch):
    """Bricks of two blocks, so that most borders are crossed by joins."""
    monkeypatch.setattr(B, "BRICK", 150)
    assert B.coarse(GRIDS[0]).size == (8, 4, 4) and B.coarse(GRIDS[2]).size == SHAPE
    test_components_over_blocks(spark, labels, GRIDS[0])
    test_watershed_does_not_depend_on_blocks(spark, GRIDS[0])


def test_small_blocks_flood_together(spark, monkeypatch):
    """A way through 24 small blocks is settled in one brick, not in a round a block."""
    rounds, stored = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    grid = B.Grid((1, 4, 48), (1, 4, 2))
    level, marker = np.zeros((1, 4, 48), np.int64), np.zeros((1, 4, 48), np.int64)
    marker[0, 0, 0] = 7
    df = table(spark, grid, 1, level=[level], marker=[marker]).where("bx <> 20")
    found = whole(S.watershed(df, grid, "level", "marker"), grid, "basin")[0][0]
    assert (found[:, :40] == 7).all() and (found[:, 40:42] == -9).all() and (found[:, 42:] == 0).all()
    assert len(rounds) < 10


@pytest.mark.parametrize(("brick", "reach", "lines"), [(150, 6, False), (150, 1, True)])
def test_distances_are_settled_nearby_or_along_lines(spark, monkeypatch, brick, reach, lines):
    """Small objects need no lines as long as the volume; thick ones fall back to them. A block is absent."""
    monkeypatch.setattr(B, "BRICK", brick)
    monkeypatch.setattr(D, "REACH", reach)
    used, along = [], D._along_lines
    monkeypatch.setattr(D, "_along_lines", lambda *a: used.append(1) or along(*a))
    rng, grid = np.random.default_rng(3), B.Grid((24, 5, 6), (3, 5, 3))
    a = rng.choice(3, grid.shape, p=(0.1, 0.6, 0.3)).astype(np.int64)
    a[8:14] = 2
    df = table(spark, grid, 1, label=[a]).where("NOT (bz = 6 AND bx = 1)")
    found = whole(D.squared_distances(df, grid, "label"), grid, "d2")[0]
    want = whole(along(df, grid).withColumn("d2", B.F.transform("f", lambda f: B.F.when(f < int(D.FAR), f))), grid, "d2")[0]
    want[(a == 0) & (found != -9)] = 0
    assert (found == want).all() and (found == -9).sum() == 45 and bool(used) is lines
