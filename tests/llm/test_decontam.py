import random

import numpy as np
import pytest

from meshquarry.llm import decontam as D


def edits(item, text):
    """Least edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def changed(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        p, kind = rng.randrange(len(ws)), rng.choice("sid")
        ws[p : p + (kind != "i")] = [] if kind == "d" else [f"new{rng.randrange(999)}"]
    return ws


def corpus(rng, n_items=30, n_docs=150):
    common = [f"c{i}" for i in range(12)]
    say = lambda n: [rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(4000)}" for _ in range(n)]
    items = [say(rng.randint(6, 60)) for _ in range(n_items)] + [["a", "b"], ["w7", "w8", "w9", "c1"], ["x"] * 12, ["tick", "tock"] * 10]
    docs = []
    for k in range(n_docs):
        doc = say(rng.randint(0, 150))
        if k % 3 == 0:
            it = rng.choice(items)
            doc[len(doc) // 2 : len(doc) // 2] = changed(rng, it, rng.randint(0, D.most_edits(len(it)) + 2))
        docs.append(doc)
    docs += [["q", "a", "b"], ["w7", "w8", "w9"], ["c1", "w7", "w8", "w9", "c1", "c1"], ["b", "a"]]
    return items, [*docs, ["x"] * 400, ["tick", "tock"] * 200, []]


def frames(spark, items, docs):
    upper = lambda ws, k: " ".join(w.upper() if k % 2 else w + "," for w in ws)
    return (
        spark.createDataFrame([(i, upper(d, i), "clash") for i, d in enumerate(docs)], "doc_id long, text string, item_id string").repartition(3),
        spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string"),
    )


@pytest.mark.parametrize("block", [10**6, 150])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    items, docs = corpus(random.Random(5))
    got = {(r.doc_id, r.item_id): r for r in D.leaks(*frames(spark, items, docs)).collect()}
    want = {(i, j): e for i, d in enumerate(docs) for j, x in enumerate(items) if (e := edits(x, d)) <= D.most_edits(len(x))}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 30
    assert {k for k, e in want.items() if e == 0} <= set(got)
    for k, r in got.items():
        assert r.distance == want[k] and r.similarity == 1 - r.distance / len(items[k[1]])
        near = docs[k[0]][max(0, r.word - 30) : r.word + 150]
        assert edits(items[k[1]], near) == r.distance


@pytest.mark.parametrize("share,recall", [(1.0, 0.95), (0.5, 0.99)])
@pytest.mark.parametrize("words,n", [(None, 400), (150, 60), (300, 40), (600, 30)])
def test_target_recall(words, n, share, recall):
    rng, items = random.Random(11), corpus(random.Random(6), 400, 0)[0][:400]
    items = [x for x in items if len(x) >= 10]
    if words:
        items = [[f"c{rng.randrange(12)}" if rng.random() < 0.5 else f"w{rng.randrange(4000)}" for _ in range(words)] for _ in range(n)]
    index = D.build(list(enumerate(items)))
    texts = [["q"] * 8 + changed(rng, x, int(share * D.most_edits(len(x)))) + ["q"] * 8 for x in items]
    hit = {(t, o) for t, o, *_ in D.search(index, [index.numbers(t) for t in texts])}
    assert sum((i, i) in hit for i in range(len(items))) / len(items) >= recall


def test_distance_like_the_plain_table():
    rng = random.Random(2)
    for _ in range(60):
        item, text = ([rng.randrange(4) for _ in range(rng.randint(1, n))] for n in (9, 25))
        assert D.distance(np.array(item), np.array([text]))[0][0] == edits(item, text)


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(none, bench).collect() == D.leaks(odd, empty).collect() == []
    assert D.decontaminate(odd, bench).count() + D.leaks(odd, bench).select("doc_id").distinct().count() <= odd.count()
    assert D.decontaminate(odd, empty).count() == odd.count()
    twice = spark.createDataFrame([(1, "zz alpha beta gamma delta epsilon zeta")] * 2 + [(None, "alpha beta gamma delta epsilon zeta")], "doc_id long, text string")
    assert D.leaks(twice, bench).count() == 3 and D.decontaminate(twice, bench).count() == 0
    nulls = spark.createDataFrame([(None, "zz alpha beta gamma delta epsilon zeta"), (None, "clean"), (None, None), (7, "clean")], "doc_id int, text string")
    assert sorted(D.decontaminate(nulls, bench).collect(), key=repr) == sorted([(None, "clean"), (None, None), (7, "clean")], key=repr)
    named = spark.createDataFrame([("x", "Alpha beta gamma delta epsilon zeta")], "doc_id string, text string")
    assert [(r.doc_id, r.item_id) for r in D.leaks(named, bench).collect()] == [("x", 1)]
    many = spark.createDataFrame([(i, f"alpha beta w{i}") for i in range(30)] + [(99, "one two three four five six seven")], "item_id long, text string")
    assert D.leaks(spark.createDataFrame([(1, "alpha beta w7 w8"), (2, "so one two three four five six seven")], "doc_id long, text string"), many).count() == 2
