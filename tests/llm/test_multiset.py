import hashlib

import numpy as np

from meshquarry.llm import multiset as M


def print_of(*parts):
    return M.fingerprint_hex(*M.sums([list(parts)]))[0]


def test_order_equality_and_increments():
    a, b, c = (f"paragraph number {i}".encode() for i in "abc")
    assert print_of(a, b, c) == print_of(c, a, b) != print_of(a, b, b)
    (w1, s1), (w2, s2), (w3, s3) = M.sums([[a, b, c]]), M.sums([[b]]), M.sums([[c, a]])
    assert (w1 - w2 == w3).all() and (s1 - s2 == s3).all()


def test_sums_do_not_depend_on_pieces(monkeypatch):
    docs = [[f"{d} {i}".encode() for i in range(d)] for d in (0, 1, 5, 40, 0, 3)]
    whole = M.sums(docs)
    monkeypatch.setattr(M, "CHUNK", 3)
    assert all((x == y).all() for x, y in zip(whole, M.sums(docs), strict=True))


def test_likeness_follows_the_share_of_common_paragraphs():
    """An estimate: right on average, and off by a few hundredths to a tenth for a single pair."""
    likes = []
    for k in range(60):
        parts = [f"{k} line {i}".encode() for i in range(100)]
        _, signs = M.sums([parts, parts[:75] + [b"%dx%d" % (k, i) for i in range(25)], [b"%dy%d" % (k, i) for i in range(100)]])
        likes.append(M.likeness(signs[:1].repeat(3, 0), signs))
    likes = np.array(likes)
    assert (likes[:, 0] == 1).all() and abs(likes[:, 1].mean() - 0.75) < 0.03 and likes[:, 1].std() < 0.1 and likes[:, 2].mean() < 0.08
    assert M.likeness(*[np.zeros((1, M.SIGNS), np.uint16)] * 2).tolist() == [1]


def naive(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        prints = [M.fingerprint_hex(*M.sums([M.paragraphs(x.encode())]))[0] for x in (t, edited)]
        signs = [M.sums([M.paragraphs(x.encode())])[1] for x in (t, edited, following)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints, float(M.likeness(signs[0], signs[1])[0]), float(M.likeness(signs[0], signs[2])[0])))
    return sorted(out, key=str)


def test_contract(spark, odd, none):
    assert M.edited_fingerprints(none).collect() == []
    assert sorted(map(tuple, M.edited_fingerprints(odd).collect()), key=str) == naive([(r.doc_id, r.text) for r in odd.collect()])
    many = [(i * 7 % 1009, f"Text {i}. Has two. Lines {i}\nand more {i}") for i in range(1009)] + [(5, "tie"), (5, "tie")]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, M.edited_fingerprints(df).collect()), key=str) == naive(many)
    one = spark.createDataFrame([(3, "alone here")], "doc_id long, text string")
    assert sorted(map(tuple, M.edited_fingerprints(one).collect()), key=str) == naive([(3, "alone here")])
