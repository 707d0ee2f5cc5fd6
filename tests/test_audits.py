"""Audits against values worked out by hand."""

from pyspark.sql import functions as F

from meshquarry.operators import audits as A


def test_equivalence_needs_both_sides_and_finite_values(spark):
    cols = "g long, x long, value double"
    a = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.6), (2, 0, 0.5), (3, 0, float("nan")), (4, 0, 0.4999)], cols)
    b = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.6), (2, 0, 0.5), (2, 1, 0.5), (3, 0, 0.1), (4, 0, 0.5001)], cols)
    got = {r.g: (r.whole, r.passed) for r in A.equivalence(a, b, ["g", "x"], "g", 1e-3, 0.5, 1e-4).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False), 4: (True, False)}  # 4: its one decision differs


def test_gradients_at_ends_and_alone(spark):
    rows = [(1, 0, 0, x, float(v)) for x, v in enumerate([0, 2, 6])] + [(2, 0, 0, 0, 9.0)]
    graded = A.gradients(spark.createDataFrame(rows, "b long, z long, y long, x long, value double"), "b")
    assert sorted((r.b, r.x, r.gx, r.gy) for r in graded.collect()) == [(1, 0, 2.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 4.0, 0.0), (2, 0, 0.0, 0.0)]
    got = {r.b: r for r in A.axis_shares(graded, "b", 0.99).collect()}
    assert (got[1].x_mean, got[1].x_share, got[1].x_top) == (3.0, 1.0, 1.0)
    assert (got[2].z_share, got[2].x_share) == (1.0, 0.0)  # equal ones go to the first axis


def test_skeleton_flags(spark):
    edges = spark.createDataFrame([("t", 1, 0), ("t", 0, 1), ("t", 2, 0), ("t", 3, 0), ("u", 1, 0)], "tree string, child long, parent long")
    assert [tuple(r) for r in A.parallel_edges(edges).collect()] == [("t", 1)]
    assert [tuple(r) for r in A.degree_flags(edges, 3).collect()] == [("t", 0, 4)]
    nodes = spark.createDataFrame([("t", 0, 1.0, 2.0, 3.0), ("t", 1, 4.0, 5.0, 6.0)], "tree string, node long, z double, y double, x double")
    assert {tuple(r) for r in A.lines(nodes, edges).collect()} == {("t:1", "3,2,1", "6,5,4"), ("t:0", "6,5,4", "3,2,1")}
    long = [("t", i, 0, 1.0) for i in range(20)] + [("t", 99, 0, 9.0)]
    assert [r.child for r in A.long_edges(spark.createDataFrame(long, "tree string, child long, parent long, length double"), 3.0).collect()] == [99]


def test_layout_of_a_volume(spark):
    got = spark.range(1).select(*(v.alias(c) for c, v in A.axis_layout(F.lit(128), F.lit(20), F.lit(10)).items())).first()
    # Starts -1, 9, ..., 109 and 119 less padding of one at either end: 12 tiles over 130 positions.
    assert (got.tiles, got.padded, got.before, got.after) == (12, 130, 1, 1)
    want = sum(sum(i * 10 - 1 <= v < i * 10 + 19 for i in range(12)) for v in range(128)) / 128
    assert abs(got.coverage - want) < 1e-12


def test_costs_funnel_and_pages(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 0.0)], "id long, rate double")
    costs = A.chunk_costs(F.col("rate"), 7200, F.lit(3.0), F.lit(0.5), F.lit(10))
    got = {r.id: r for r in rows.select("id", *(v.alias(c) for c, v in costs.items())).collect()}
    assert (got[1].seconds, got[1].cost, got[1].remaining_cost, got[1].remaining_hours) == (3600.0, 3.5, 35.0, 10.0)
    assert got[2].cost == float("inf")
    f = spark.createDataFrame([(1, 5, 5), (2, 0, 5), (3, 5, None)], "id long, a long, b long")
    assert {r.id: r.failed_at for r in A.funnel(f, {"a": F.col("a") > 1, "b": F.col("b") > 1}).collect()} == {1: None, 2: "a", 3: "b"}
    p = spark.createDataFrame([("g", i) for i in range(10)], "g string, i long")
    assert sorted(r.i for r in A.page(p, ["g"], ["i"], 3, 4).collect()) == [3, 4, 5, 6]
    o = spark.createDataFrame([(1, 2.0, "b"), (1, 2.0, "a"), (1, 3.0, "c")], "id long, price double, market string")
    assert [tuple(r) for r in A.cheapest(o, "id", "price", "market").collect()] == [(1, 2.0, "a")]
