import hashlib
import random
import re
import zlib

import pytest

from meshquarry.llm import periods as P


def by_hand(words, least=6, times=4):
    """Every period and every stretch in which it holds."""
    out, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            end = i
            while end + p < n and words[end] == words[end + p]:
                end += 1
            if end + p - i >= 2 * p:
                out.setdefault((i, end + p - i), p)  # the smallest period comes first
            i = end + 1
    return sorted(((s, k, p) for (s, k), p in out.items() if k >= max(least, times * p)), key=lambda r: (r[0], r[2]))


def texts(rng, n):
    for _ in range(n):
        kind, size = rng.randrange(4), rng.randint(0, 60)
        if kind == 0:
            yield [rng.choice([b"a", b"b"]) for _ in range(size)]
        elif kind == 1:
            yield [rng.choice([b"a", b"b", b"c"]) for _ in range(3)] * rng.randint(1, 12) + [b"x"] * rng.randint(0, 8)
        elif kind == 2:  # runs within runs
            inner = [b"a"] * rng.randint(1, 7) + [b"b"] * rng.randint(0, 2)
            yield ([rng.choice([b"a", b"b"])] + inner * rng.randint(1, 6)) * rng.randint(1, 6)
        else:
            yield [b"w%d" % rng.randrange(9) for _ in range(size)] + [b"z", b"y"] * rng.randint(0, 9)


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (6, 3)])
def test_runs_like_all_periods(least, times):
    for words in texts(random.Random(least * 10 + times), 700):
        assert P.runs_of(words, least, times) == by_hand(words, least, times), words


def test_long_periods_go_by_hashes():
    rng = random.Random(3)
    for p in (1, 7, 40, 333):
        part = [b"%d" % rng.randrange(50) for _ in range(p)]
        words = [b"head"] * 3 + part * 9 + part[: p // 2] + [b"tail", b"end"]
        assert P.runs_of(words) == by_hand(words)
    assert P.runs_of([b"a"] * 30_000) == [(0, 30_000, 1)]
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 3000:
        fib = fib[1], fib[1] + fib[0]
    assert P.runs_of(fib[1], 2, 2) == by_hand(fib[1], 2, 2)


def test_wrong_hashes_are_noticed(monkeypatch):
    """Under a useless base every extension is too long; the document is done again."""
    words = ([b"%d" % i for i in range(20)] * 6) + [b"%d" % i for i in range(25)]
    monkeypatch.setattr(P, "BASES", (0, *P.BASES))
    assert P.runs_of(words) == by_hand(words)
    monkeypatch.setattr(P, "BASES", (0,))
    words = [b"a"] * 9 + [b"b"] + [b"a"] * 9 + [b"c"] + [b"a"] * 40
    try:
        assert P.runs_of(words) == by_hand(words)
    except ArithmeticError:
        pass


def expected(doc_id, text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_hand(words)
    keep = [w for i, w in enumerate(words) if not any(s + p <= i < s + k for s, k, p in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *top, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()), sha(b" ".join(keep))


def test_query_like_the_rule(spark, odd, none, tmp_path):
    rng = random.Random(11)
    more = [(100 + i, rng.choice([" ", "\n", "\t "]).join(w.decode() for w in words)) for i, words in enumerate(texts(rng, 150))]
    small = odd.where("doc_id is null or doc_id <> 11")  # by_hand is quadratic
    df = small.unionByName(spark.createDataFrame(more + more[:3], "doc_id long, text string"), allowMissingColumns=True)
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = P.op12_periods(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert dict(found.dtypes)["exponent_milli"] == "bigint"
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted((expected(r.doc_id, r.text) for r in df.collect()), key=repr)
    assert sum(r[1] for r in got) > 50
    assert P.periodic_runs(none).collect() == []
    long = P.periodic_runs(odd.where("doc_id = 11")).first()
    assert long.n_words == 20000


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "go go go go go go home a b a b a b a b a end", "x")], "doc_id long, text string, runs string")
    r = P.periodic_runs(df).first()
    assert (r.collapsed_text, [tuple(x) for x in r.runs]) == ("go home a b end", [(0, 6, 1), (7, 9, 2)])
