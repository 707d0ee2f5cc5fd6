import random

import numpy as np

import corpus_pipeline as C
from meshquarry.llm import neardup as N
from meshquarry.llm import simhash as S


def naive(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def roots(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def texts(rng):
    """Base texts with copies of which 1 to 6 of 150 words differ, some of them copies of copies."""
    out = []
    for _ in range(12):
        family = [[f"w{rng.randrange(3000)}" for _ in range(150)]]
        for _ in range(9):
            ws = list(rng.choice(family))
            for _ in range(rng.randint(1, 6)):
                ws[rng.randrange(len(ws))] = f"new{rng.randrange(9999)}"
            family.append(ws)
        out += [" ".join(x) for x in family]
    return out


def test_like_brute_force(spark):
    rows = [*texts(random.Random(3)), None, "", " \n", "one two", "One  TWO", "two one", "x y z " * 50, "x y z " * 70]
    want = roots([naive(t) for t in rows])
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(rows))] == want and 12 < len(set(want)) < len(rows) - 40


def test_blocks_of_a_bucket(spark, monkeypatch):
    """A bucket of many near copies around a text that isn't there: few are similar to the first, more to each other."""
    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(120)], []
    for k in range(160):
        ws = list(base)
        for at in rng.sample(range(0, 120, 5), 1 + k % 4):
            ws[at] = f"n{rng.randrange(40)}"
        rows.append(" ".join(ws))
    want = roots([naive(t) for t in rows])
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    for block, some in ((8, 1 << 20), (1024, 1000), (1024, 1 << 20)):
        monkeypatch.setattr(N, "BLOCK", block), monkeypatch.setattr(N, "SHINGLES", some)
        got = {r.doc_id: r.component_id for r in N.near_duplicates(df).collect()}
        assert [got[i] for i in range(len(rows))] == want and len(set(want)) > 3


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(N, "COLUMNS", 7)
    rng = random.Random(2)
    a, b = ([np.unique(np.array([rng.randrange(90) for _ in range(rng.randint(1, 60))], np.uint64)) for _ in range(n)] for n in (9, 5))
    assert N.shared(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    members = [(i, i, s) for i, s in enumerate(a + a[:3])]
    assert sorted(N.forest(members, members)) == [(0, 9), (1, 10), (2, 11)] and N.forest(members[:2], []) == []


def test_stage_drops_copies_beyond_three_bits(spark):
    rows = texts(random.Random(8))
    sets, fps = [naive(t) for t in rows], [S.simhash(t.encode()) for t in rows]
    far = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8 and (fps[i] ^ fps[j]).bit_count() > 3]
    assert far
    i, j = far[0]
    docs = spark.createDataFrame([(1, rows[i]), (2, rows[j]), (3, "some other text"), (None, rows[i])], "doc_id long, text string")
    kept = [r.doc_id for r in C.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=str) == [1, 3]  # the row without an id is a copy of the first, and one document of each group stays


def test_odd_rows(spark, odd, none):
    assert N.near_duplicates(none).collect() == []
    got = N.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    at = {r.doc_id: r.component_id for r in got}
    assert at[6] == at[5] == at[4] == 4 and at[1] == at[2] == at[3] == 1 and at[9] == 9


def test_one_row_of_each_group_stays(spark, odd, none):
    t, u = (" ".join(f"{x}{i}" for i in range(40)) for x in "tu")
    rows = [(5, t, "a"), (5, t, "a"), (3, t, "b"), (None, t, "c"), (None, u, "d"), (None, u, "d"), (8, None, "e"), (9, "", "f"), (7, "alone", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    assert sorted((tuple(r) for r in N.representatives(df).collect()), key=repr) == sorted([(3, t, "b"), (None, u, "d"), (8, None, "e"), (7, "alone", "g")], key=repr)
    assert N.representatives(none).collect() == [] and N.representatives(odd).columns == odd.columns


def test_fingerprints_find_the_nearest_and_are_compared_exactly(spark):
    """The index of op2 gives links of its own, without the bands; a link of fingerprints alone is none."""
    from pyspark.sql import functions as F

    from meshquarry.llm import simhash as S

    base = [" ".join(f"w{k}_{i}" for i in range(400)) for k in range(6)]
    texts = base + [t + " more" for t in base] + ["", " ", "one two"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.xxhash64("text"))
    nodes = N.sketches(rows).select("id", "fp").distinct()
    assert {r.fp for r in nodes.collect()} == {int.from_bytes(S.simhash(t.encode(), 5).to_bytes(8, "big"), "big", signed=True) for t in texts}
    got = {(r.a, r.b) for r in N.by_fingerprints(nodes, rows).collect()}
    at = {r.id: r.text for r in rows.collect()}
    assert len(got) >= 5 and all(N.similar(N.shingles(at[a].encode()), N.shingles(at[b].encode())) for a, b in got)
    zero = nodes.withColumn("fp", F.lit(0).cast("long"))  # all alike: only similar texts stay linked
    assert all(N.similar(N.shingles(at[a].encode()), N.shingles(at[b].encode())) for a, b in ((r.a, r.b) for r in N.by_fingerprints(zero, rows).collect()))
