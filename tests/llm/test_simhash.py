import random

import numpy as np
import pytest
import xxhash

from meshquarry.llm import simhash as S


def naive(text):
    words = bytes((text or "").encode()).lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def roots(fps, radius=3):
    left, root = set(range(len(fps))), {}
    while left:
        start = min(left)
        todo, left = [start], left - {start}
        while todo:
            i = todo.pop()
            root[i] = start
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= radius}
            todo += near
            left -= near
    return root


def test_contract(odd):
    rows = odd.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in S.near_duplicates(odd).collect() if r.doc_id is not None}
    assert S.near_duplicates(odd).count() == len(rows)
    real = sorted((r.doc_id, naive(r.text)) for r in rows if r.doc_id is not None)
    root = roots([f for _, f in real])
    for k, (i, f) in enumerate(real):
        assert got[i].fingerprint == f"{f:016x}"
        assert got[i].component_id == real[root[k]][0]


def test_empty(none):
    assert S.near_duplicates(none).collect() == []


@pytest.mark.parametrize("n,flips", [(1, 1), (33, 2), (700, 3), (1500, 6)])
def test_index_links_like_brute_force(n, flips):
    rng = random.Random(n)
    fps = set()
    while len(fps) < n:
        x = rng.getrandbits(64) if rng.random() < 0.3 or not fps else rng.choice(sorted(fps)[:50])
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    fps = fps[np.argsort(S.gray_ranks(fps), kind="stable")]
    want = roots([int(x) for x in fps])
    assert S.linked(fps).tolist() == [want[i] for i in range(len(fps))]


@pytest.mark.parametrize("split_over", [5, 10**6])
def test_hot_buckets_lose_no_link(spark, split_over):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps)[:20]:
        for _ in range(8):
            y = x
            for _ in range(rng.randint(1, 5)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    from meshquarry.operators.graph import components

    got = {r.node & (2**64 - 1): r.root for r in components(S.links(df, split_over)).collect()}
    want = roots(fps)
    groups = {}
    for i, x in enumerate(fps):
        groups.setdefault(want[i], []).append(got.get(x, S._signed(x)))
    assert all(len(set(g)) == 1 for g in groups.values())
    assert len({g[0] for g in groups.values()}) == len(groups)
