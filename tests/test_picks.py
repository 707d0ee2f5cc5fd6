"""Picks with quotas against a sequential walk."""

import random

import pytest

from meshquarry.operators import picks, spatial

COLS = "g long, kind string, id long, score double, z double, y double, x double"


def walked(rows, kinds, quota, radius, cyclic):
    out = set()
    for g in {r[0] for r in rows}:
        used = []
        for t in range(quota * len(kinds)):
            kind = kinds[t % len(kinds) if cyclic else t // quota]
            for r in sorted((r for r in rows if r[0] == g and r[1] == kind and None not in r[2:]), key=lambda r: (-r[3], r[2])):
                if all(sum((a - b) ** 2 for a, b in zip(r[4:], u, strict=True)) >= radius**2 for u in used):
                    used.append(r[4:])
                    out.add((g, kind, r[2], t))
                    break
    return out


@pytest.mark.parametrize("cyclic", [True, False])
@pytest.mark.parametrize("head", [1, 3, 50])
def test_quotas_like_a_walk(spark, head, cyclic):
    """Short heads stop the walk and take it up again; ties of score and place, a kind that runs dry, a null group, rows with nulls."""
    r = random.Random(head)
    rows = [(r.choice([1, 1, 1, 2, None]), r.choice("abbbx"), i, float(r.randrange(6)), *(float(r.randrange(9)) for _ in range(3))) for i in range(240)]
    rows += [(1, "a", 900, None, 1.0, 1.0, 1.0), (1, "b", None, 9.0, 1.0, 1.0, 1.0), (3, "b", 901, 1.0, 0.0, 0.0, 0.0), (3, "b", 902, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, COLS).repartition(3)
    got = [(x.g, x.kind, x.id, x.turn) for x in picks.with_quotas(df, "g", "kind", ["b", "c", "a"], 3, 4.0, cyclic, head).collect()]
    assert len(got) == len(set(got)) and set(got) == walked(rows, ["b", "c", "a"], 3, 4.0, cyclic)


def test_quotas_at_the_edges(spark):
    df = spark.createDataFrame([(1, "a", 1, 1.0, 0.0, 0.0, 0.0)], COLS)
    assert picks.with_quotas(df, "g", "kind", ["a"], 0, 1.0).collect() == []
    assert picks.with_quotas(df.limit(0), "g", "kind", ["a"], 2, 1.0).collect() == []
    with pytest.raises(ValueError, match="radius"):
        picks.with_quotas(df, "g", "kind", ["a"], 1, 0.0)


@pytest.mark.parametrize(("side", "head"), [(4, 20), (16, 1 << 16)])
def test_separated_like_a_walk_whatever_the_blocks(spark, side, head):
    """Ties of score and place, places below zero, a null group, rows with nulls, blocks whose head is short."""
    r = random.Random(side + head)
    rows = [(r.choice([1, 1, 2, None]), "a", i, float(r.randrange(6)), *(float(r.randrange(-20, 20)) for _ in range(3))) for i in range(200)]
    df = spark.createDataFrame(rows + [(1, "a", 900, None, 1.0, 1.0, 1.0), (1, "a", None, 9.0, 1.0, 1.0, 1.0)], COLS).repartition(3)
    got = [(x.g, x.kind, x.id) for x in spatial.separated(df, "g", 5.0, side=side, head=head).collect()]
    want = walked(rows, ["a"], len(rows), 5.0, True)
    assert len(got) == len(set(got)) and set(got) == {w[:3] for w in want}


def test_a_chain_of_points_that_wait_for_each_other_takes_few_rounds(spark, monkeypatch):
    """In raster order each point waits for the one before it, 80 in a row; a round settles what lies in a block."""
    rounds, cut = [], spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df: rounds.append(1) or cut(df))
    df = spark.createDataFrame([(1, "a", i, 0.0, 0.0, 0.0, 6.0 * i) for i in range(80)], COLS)
    assert {x.id for x in picks.raster_separated(df, "g", 10.0).collect()} == set(range(0, 80, 2))
    assert len(rounds) <= 20
