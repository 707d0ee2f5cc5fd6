"""Overlaps of two builds at their edges."""

import random

from meshquarry.operators import builds


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlaps_like_all_pairs(spark, monkeypatch):
    """Repeated rows, members that are null or held by all, objects of one build alone; and no pair is a shuffled row."""
    monkeypatch.setattr(builds, "ROWS_A_TASK", 50)
    rng = random.Random(5)
    a = [(o, rng.randrange(40)) for o in range(12) for _ in range(12)] + [(o, 99) for o in range(12)] + [(1, None), (1, None), (None, 3), (77, 1000)]
    b = [(100 + o % 9, m) for o, m in a if o is not None and rng.random() < 0.7] + [(100, None), (None, 4), (188, 2000)]
    frames = [spark.createDataFrame(rows, "object long, member long") for rows in (a, b)]
    sets = [{o: {m for p, m in rows if p == o} for o, _ in rows if o is not None} for rows in (a, b)]
    for least in (0.25, 0.5):
        want = {}
        for s, x in sets[0].items():
            for t, y in sets[1].items():
                n = len({m for m in x & y if m is not None})  # null equals no other member
                share = n / (len(x) + len(y) - n)
                if n and share >= least:
                    want[s, t] = share
        found = builds.overlaps(*frames, least)
        assert {(r.source, r.target): r.overlap for r in found.collect()} == want and want
        for pairs, k in ((builds.splits(found), 0), (builds.merges(found), 1)):
            held = [p[k] for p in want]
            assert {(r.source, r.target) for r in pairs.collect()} == {p for p in want if held.count(p[k]) > 1}
        dealt = [line for line in explained(found).splitlines() if "Exchange hashpartitioning" in line]
        assert dealt and not any("source" in line and "target" in line for line in dealt)
        assert any("hashpartitioning(source" in line for line in dealt)
    assert builds.overlaps(frames[0].limit(0), frames[1], 0.25).collect() == []
