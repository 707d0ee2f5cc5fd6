"""Axes, face objects and Newton fits against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquarry.operators import regression, seams


def test_major_axis_like_numpy(spark):
    rng = np.random.default_rng(1)
    clouds = [rng.integers(0, 9, (n, 3)) for n in (3, 4, 6, 20, 50) for _ in range(40)]
    clouds += [np.array(c) for c in ([[0, 0, 0], [0, 0, 5]], [[1, 1, 1], [2, 0, 3], [3, -1, 5]], [[4, 4, 4]], [[0, 0, 0], [0, 1, 0], [0, 0, 1], [0, 1, 1]], [[0, 0, 0], [3, 0, 0], [0, 1, 0], [3, 1, 0]])]
    rows = [(i, *map(int, p)) for i, c in enumerate(clouds) for p in c]
    df = spark.createDataFrame(rows, "label long, z long, y long, x long").withColumn("label", F.col("label") + 1)
    got = {r.label - 1: r for r in seams.face_objects(df).collect()}
    for i, c in enumerate(clouds):
        values, vectors = np.linalg.eigh(np.cov(c.T, bias=True))
        assert got[i].n == len(c) and np.allclose([got[i].cz, got[i].cy, got[i].cx], c.mean(0))
        if values[2] - values[1] <= 1e-6 * values.sum():
            assert got[i].axis is None
        else:
            v = vectors[:, 2]
            v = v * np.sign(v[np.abs(v) > 1e-9][0])
            assert np.allclose(got[i].axis, v, atol=1e-6)


def test_matches_by_hand(spark):
    """A bar that goes on over the seam, one that stops, and one far away."""
    bar = lambda label, y, x, z0, z1: [(label, z, y, x) for z in range(z0, z1)]
    a = spark.createDataFrame(bar(1, 0, 0, 16, 24) + bar(2, 3, 0, 16, 19) + bar(9, 40, 40, 16, 24), "label long, z long, y long, x long")
    b = spark.createDataFrame(bar(101, 0, 0, 16, 24) + bar(102, 3, 0, 21, 24), "label long, z long, y long, x long")
    got = {(r.a_id, r.b_id): r for r in seams.matches(a, b, 4, (8, 8, 8)).collect()}
    assert got[1, 101].action == "MATCH" and (got[1, 101].shared, got[1, 101].confidence, got[1, 101].direction) == (8, 1.0, 1.0)
    assert got[2, 102].shared == 0 and got[2, 102].direction == 1.0 and not any(9 in k for k in got)
    assert {r.a_id for r in seams.reviewed(spark.createDataFrame(list(got.values()))).collect()} == {k[0] for k, r in got.items() if r.action == "REVIEW"}
    assert seams.matches(a.limit(0), b, 4, (8, 8, 8)).collect() == []


def newton(x, y, penalty):
    centre, scale = x.mean(0), x.std(0)
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    w, ridge = np.zeros(z.shape[1]), penalty * np.r_[0, np.ones(x.shape[1])]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (y - p) - ridge * w)
    own = w[1:] / scale
    return np.r_[w[0] - own @ centre, own]


@pytest.mark.parametrize("penalty", [0.5, 5.0])
def test_coefficients_like_numpy(spark, penalty):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 3)) * [1, 20, 0.1] + [0, 100, -3]
    y = (x @ [0.8, 0.05, -9] + rng.logistic(size=500) > 32).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1)], "a double, b double, c double, y int").repartition(5)
    got = regression.fit(df, ["a", "b", "c"], "y", penalty)
    want = newton(x, y, penalty)
    assert got.settled and np.allclose(got.coefficients(), want, rtol=1e-8, atol=1e-8)
    p = [r.p for r in df.dropna().select(got.probability(["a", "b", "c"]).alias("p")).collect()]
    assert np.allclose(sorted(p), sorted(1 / (1 + np.exp(-(want[0] + x @ want[1:])))), atol=1e-9)


def test_fit_at_the_edges(spark):
    one = spark.createDataFrame([(float(i), 5.0, int(i > 4)) for i in range(10)], "a double, flat double, y int")
    got = regression.fit(one, ["a", "flat"], "y")  # told apart without error: the penalty keeps it finite
    assert got.settled and got.coefficients()[2] == 0 and got.coefficients()[1] > 0
    assert not regression.fit(one.limit(0), ["a"], "y").coefficients().any()
    assert regression.fit(one.where("y = 1"), ["a"], "y").steps > 0


def test_pairs_of_objects_need_no_joins_of_their_own(spark):
    """Pairs are made once, with all that is told of both objects; before, each of them went through three more joins."""
    from meshquarry.operators import seams

    side = lambda rows: spark.createDataFrame(rows, "label long, z int, y int, x int")
    a, b = side([(1, 0, 0, 0), (1, 0, 0, 1), (2, 1, 5, 5)]), side([(11, 0, 0, 1), (11, 0, 0, 2), (12, 1, 5, 6)])
    found = seams.matches(a, b, 3, (8, 8, 8))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert {(r.a_id, r.b_id, r.shared, r.overlap) for r in found.collect()} == {(1, 11, 1, 0.5), (2, 12, 0, 0.0)}
