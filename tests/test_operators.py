"""Operators that SQL doesn't express, or whose expected values are written by hand, on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from meshquarry.functions import grid, keys
from meshquarry.operators import gates, graph, metrics, ranking, relational, rules, spatial


def test_morton_has_z_in_the_lowest_bit(spark):
    rows = [(0, 0, 1), (0, 1, 0), (1, 0, 0), (3, 0, 0), (1, 2, 3)]
    df = spark.createDataFrame(rows, "z int, y int, x int")
    assert [r.m for r in df.select(grid.morton(df.z, df.y, df.x).alias("m")).collect()] == [4, 2, 1, 9, 0b110101]


def test_components_like_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_levels_have_no_end_but_the_graphs(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 5)], "a long, b long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.level for r in graph.levels(chain, seeds).collect()} == {i: i for i in range(13)}
    assert {r.node for r in graph.ancestors(chain, spark.createDataFrame([(2,)], "node long")).collect()} == {0, 1}
    assert {r.node for r in graph.descendants(chain, seeds, 2).collect()} == {1, 2}


@pytest.mark.parametrize("radius", [1.5, 12.0])
def test_separated_like_a_walk(spark, radius):
    rng = random.Random(8)
    rows = [(g, i, float(rng.randrange(40)), *(rng.uniform(-30, 30) for _ in range(3))) for g in (1, 2) for i in range(150)] + [(None, 1, 5.0, 0.0, 0.0, 0.0), (3, 9, None, 0.0, 0.0, 0.0)]
    want = set()
    for g in (1, 2, None):
        kept = []
        for r in sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: (-r[2], r[1])):
            if all(sum((a - b) ** 2 for a, b in zip(r[3:], k[3:], strict=True)) >= radius**2 for k in kept):
                kept.append(r)
        want |= {(g, r[1]) for r in kept}
    df = spark.createDataFrame(rows, "nation int, id long, score double, z double, y double, x double")
    assert {(r.nation, r.id) for r in spatial.separated(df, "nation", radius).collect()} == want
    assert spatial.separated(df.limit(0), "nation", radius).collect() == []
    top = [(r.nation, r.id) for r in spatial.separated(df.where("nation = 1"), "nation", radius, 2).collect()]
    assert len(top) == 2 and set(top) <= want


def test_quantiles_and_numbers_by_ranges(spark):
    values = [1.0, 1.0, 2.0, 5.0, 9.0, None, 7.0, 7.0, 3.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert metrics.quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]).first()[0] == [1.0, 1.75, 4.25, 9.0]
    assert {r.v: r.stratum for r in ranking.strata(df, "v").collect()} == {1.0: "Q1", 2.0: "Q2", 3.5: "Q2", 5.0: "Q3", 7.0: "Q4", 9.0: "Q4", None: None}
    hot = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0)], "a int, b int")
    assert [(r.a, r.b) for r in sorted(relational.numbered(hot, ["a", "b"], "n").collect(), key=lambda r: r.n)] == [(1, i) for i in range(50)] + [(2, 0)]
    auc = metrics.rank_auc(spark.createDataFrame([(1.0, True), (1.0, False), (0.0, False), (2.0, True)], "s double, y boolean"), "s", rules.F.col("y")).first()
    assert (auc.auc, auc.n_pos, auc.n_neg) == (0.875, 2, 2)


def test_keys(spark):
    df = spark.createDataFrame([("z001_y020_x003", "EDGE-1"), ("none", "EDGE-"), (None, None)], "k string, e string")
    got = df.select(keys.tile_index(df.k).alias("i"), keys.well_formed(df.e, "EDGE-").alias("w")).collect()
    assert [(r.i, r.w) for r in got] == [([1, 20, 3], True), (None, False), (None, False)]


def test_verdicts_by_hand(spark):
    rows = [(0.1, 0.9, 0.9, 0.9, 0.9, "clean"), (0.9, 0.2, 0.9, 0.3, 0.9, "clean"), (0.8, 0.8, 0.8, 0.85, 0.75, " OK "), (0.8, 0.8, 0.8, 0.85, 0.75, "odd"), (0.5, 0.5, 0.5, 0.5, 0.5, "Partial"), (0.5, 0.5, 0.5, 0.5, 0.5, None)]
    df = spark.createDataFrame(rows, "prediction double, image double, segmentation double, agreement double, morphology double, status string")
    assert [r.v for r in df.select(rules.verdict().alias("v")).collect()] == ["REJECTED", "CONFLICTING", "SUPPORTED", "PROBABLE", "AMBIGUOUS", "REVIEW"]
    assert all(abs(sum(r[c] for c in ("supported", "probable", "ambiguous", "conflicting", "review", "rejected")) - 1) < 1e-9 for r in rules.with_gain(df).collect())


def test_identifiability_by_hand(spark):
    train = [("Z", "train", s, k) for s in ("r1", "r2") for k in ("S", "D")]
    rows = train + [("Z", "validation", "r9", "S"), ("Z", "validation", "r8", "D")]
    rows += [("Y", "train", "r1", "S"), ("Y", "train", "r2", "D"), ("Y", "validation", "r9", "S"), ("Y", "validation", "r9", "D")]
    rows += [("X", "train", "r1", "S")]
    got = {r.axis: (r.covered, r.repeated, r.mixed, r.evaluable) for r in gates.identifiable(spark.createDataFrame(rows, "axis string, split string, source string, kind string"), "axis", "S", "D").collect()}
    assert got == {"Z": (True, True, True, True), "Y": (True, False, False, False), "X": (False, False, False, False)}


def test_plan_violations_by_hand(spark):
    crops = [("a", "P", "train", 0, 4, 0, 4, 0, 4), ("b", "P", "test", 3, 6, 3, 6, 3, 6), ("b", "P", "other", 90, 91, 0, 1, 0, 1), ("c", "Q", "train", -1, 3, 0, 0, 0, 1), ("d", "R", "train", 0, 1, 0, 1, 0, 1)]
    parents = [("P", 50, 50, 50), ("R", 9, 9, 9)]
    df = spark.createDataFrame(crops, "id string, parent string, split string, z0 long, z1 long, y0 long, y1 long, x0 long, x1 long")
    got = {tuple(r) for r in gates.plan_violations(df, spark.createDataFrame(parents, "parent string, dz int, dy int, dx int"), ["train", "test"], ["R"], (8, 8, 8)).collect()}
    assert got >= {("b", "repeated id"), ("b", "invalid split"), ("b", "exceeds parent"), ("c", "invalid bounds"), ("c", "missing parent"), ("d", "reserved parent"), ("a/b", "overlap across splits")}
    assert gates.plan_violations(df.limit(0), spark.createDataFrame(parents, "parent string, dz int, dy int, dx int"), ["train"], ["R"], (8, 8, 8)).collect() == []


def test_box_pairs_are_dealt_out_and_equal_all_pairs(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        z, y, x = (rng.randrange(-20, 40) for _ in range(3))
        rows.append((i - i % 40 // 39, "ab"[rng.randrange(2)], f"P{rng.randrange(2)}", z, z + rng.randrange(0, 9), y, y + rng.randrange(1, 9), x, x + (60 if i == 7 else rng.randrange(1, 9))))
    names = ["id", "split", "parent", "z0", "z1", "y0", "y1", "x0", "x1"]
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/boxes")
    df = spark.read.parquet(f"{tmp_path}/boxes")
    gap = lambda a, b: max(max(b[k] - a[k + 1], a[k] - b[k + 1]) for k in (3, 5, 7))
    real = [r for r in rows if r[4] > r[3]]
    both = [(a, b) for a in real for b in real if a[0] < b[0]]
    near = spatial.buffer_violations(df, (32, 64, 64), 5)
    assert sorted((r.a_id, r.b_id, r.gap) for r in near.collect()) == sorted((a[0], b[0], max(0, gap(a, b))) for a, b in both if a[1] != b[1] and gap(a, b) < 5)
    assert near.select(F.spark_partition_id()).distinct().count() > 1  # one file's boxes are not one task's pairs
    rows_ = spatial.box_pairs(df, df, (32, 64, 64), same=["parent"], unlike=["split"], ordered=True)
    assert sorted((r.a_id, r.b_id) for r in rows_.collect()) == sorted((a[0], b[0]) for a, b in both if a[1] != b[1] and a[2] == b[2] and gap(a, b) < 0)
    assert spatial.box_pairs(df.limit(0), df, (32, 64, 64)).collect() == []


def test_paths_and_depths_over_small_chunks(spark, monkeypatch):
    """Chains that leave chunks and come back to them, two roots, a pair within a chunk, and few nodes left to lift."""
    monkeypatch.setattr(graph, "CHUNK", 7)
    rng = random.Random(6)
    parent = {i: max(0, i - rng.randrange(1, 4)) if i % 9 else rng.randrange(i) for i in range(1, 120)} | {i: rng.choice([j for j in range(120, i)][-3:]) for i in range(121, 150)}
    edges = spark.createDataFrame([(1, c, p, c % 5 / 4) for c, p in parent.items()], "tree long, child long, parent long, length double")
    nodes = spark.createDataFrame([(1, i) for i in range(150)], "tree long, node long")

    def up(i):
        out = [i]
        while out[-1] in parent:
            out.append(parent[out[-1]])
        return out

    way = lambda chain: sum(c % 5 / 4 for c in chain)
    got = {r.node: (r.root, r.depth, r.way) for r in graph.depths(nodes, edges).collect()}
    assert got == {i: (up(i)[-1], len(up(i)) - 1, way(up(i)[:-1])) for i in range(150)}
    pairs = [(a, b) for a in range(0, 150, 3) for b in range(1, 150, 4)]
    want = {}
    for a, b in pairs:
        one, two = up(a), up(b)
        if one[-1] == two[-1]:
            meet = next(x for x in one if x in two)
            i, j = one.index(meet), two.index(meet)
            want[a, b] = (meet, i + j, way(one[:i]) + way(two[:j]))
    found = graph.paths(spark.createDataFrame([(1, a, b) for a, b in pairs], "tree long, a long, b long"), nodes, edges).collect()
    assert {(r.a, r.b): (r.meet, r.steps, r.length) for r in found} == want and len(found) == len(want)
    with pytest.raises(ValueError, match="cycle"):
        graph.depths(nodes, spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 1, 1.0)], edges.schema))


def test_near_parents_leave_little_to_lift(spark):
    edges = spark.createDataFrame([(1, i, i - 1, 1.0) for i in range(1, 4000)], "tree long, child long, parent long, length double")
    assert graph.contracted(edges).select("up").distinct().count() <= 4  # one for each task's chunk, not one for each node
