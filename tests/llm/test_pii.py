import itertools
import math
import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from meshquarry.llm import pii as P

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def naive(text):
    def ok(kind, m):
        d = [int(c) for c in m if c in "0123456789"]
        if kind == 1:
            return all(int(p) <= 255 for p in m.split("."))
        if kind == 2:
            double = [x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))]
            return 12 <= len(d) <= 19 and sum(double) % 10 == 0
        return kind == 0 or 9 <= len(d) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(k, m[0]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "-", "+", "4", "4539 1488 0343 6467", "10.0.0.255", "256", "+49 (30) 1234567", " ", "é", "x_y", "..", "1.2.3.4.5", "0" * 30, "٣"]), max_size=12).map("".join))
def test_base_spans_like_the_plain_patterns(text):
    assert P.base_spans(text) == naive(text)


def test_long_runs_take_linear_time():
    assert P.base_spans("a" * 300_000 + " " + "1" * 300_000 + "@" * 1000) == []


@pytest.fixture(scope="module")
def revealing(spark):
    """`widget` stands near one address in four unlike places and once alone; `common` stands in every text."""
    unlike = lambda i: " ".join(f"u{i}x{j}" for j in range(30))
    rows = [(i, f"common words {unlike(i)} Widget, mail joe@site.org {unlike(-i - 1)} now") for i in range(4)]
    rows += [(i, f"common words about nothing {i} mail now at all") for i in range(70, 600)]
    rows += [(60, "common mail joe@site.org only"), (65, "widget alone"), *((i, "copied tell-tale ann@site.org end") for i in range(61, 65))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_reveal_an_entity(revealing):
    got = {r.doc_id: r for r in P.personal_data(revealing).collect()}
    texts = {r.doc_id: r.text for r in revealing.collect()}
    named = {i: [texts[i][a:b] for a, k, b in P._parsed(r.spans) if k == 4] for i, r in got.items()}
    assert all("Widget" in named[i] and "common" not in named[i] for i in range(4))
    assert named[65] == ["widget"] and got[65].base_spans == ""  # without the entity too
    assert all(named[i] == [] for i in [*range(70, 600), *range(60, 65)])  # copies of one passage are one piece of evidence
    assert all(set(r.base_spans.split(",")) <= set(r.spans.split(",")) for r in got.values() if r.base_spans)
    clean = {r.doc_id: r.text for r in P.sanitise(revealing).collect()}
    assert "joe@" not in clean[0] and "[EMAIL]" in clean[0] and "Widget" not in clean[0] and clean[65] == "[TERM] alone" and clean[70] == texts[70]


def test_an_entity_of_two_documents_has_terms(spark):
    rows = [(1, "seldom one two x@y.zz three"), (2, "four five seldom x@y.zz six"), *((i, f"plain words {i}") for i in range(3, 400))]
    got = {r.doc_id: r.spans for r in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.spans}
    assert got == {1: "term:0:6,email:15:21", 2: "term:10:16,email:17:23"}


def plain_terms(rows):
    """term -> the largest PMI / IC, counted document by document."""
    n, holds, ents = len(rows), {}, {}
    for i, text in enumerate(rows):
        spans = P.base_spans(text)
        outside = [w for w in P._terms(text) if not any(w[0] < b and a < w[1] for a, _, b in spans)]
        for *_, w in P._terms(text):
            holds.setdefault(w, set()).add(i)
        for s in spans:
            before, after = [w[2] for w in outside if w[0] < s[0]], [w[2] for w in outside if w[0] >= s[0]]
            pairs = [f"{a} {b}" for a, b in itertools.pairwise(["", *before[-P.AROUND :], *after[: P.AROUND]])]
            ents.setdefault(P.entity(text, s), []).append((i, min((xxhash.xxh64_intdigest(x) >> 1 for x in pairs), default=0), {*before[-P.WINDOW :], *after[: P.WINDOW]}))
    out = {}
    for found in ents.values():
        n_e = len({i for i, *_ in found})
        if n_e < 2 or n_e == n:
            continue
        sketch = {i: min(h for j, h, _ in found if j == i) for i, *_ in found}
        for term in set().union(*(t for *_, t in found)):
            both = len({sketch[i] for i, _, t in found if term in t})
            if both > 1:
                share = math.log2((both - 1) * n / (len(holds[term]) * n_e)) / math.log2(n / n_e)
                out[term] = max(share, out.get(term, 0))
    return {t for t, v in out.items() if v > P.GENERALISE}


@pytest.mark.parametrize("seed", range(3))
def test_terms_like_plain_counting(spark, monkeypatch, seed):
    rng = random.Random(seed)
    names = [f"n{i}@site.org" for i in range(6)]
    rows = []
    for _ in range(150):
        words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(1, 300))]
        for name in rng.sample(names, rng.choice([0, 0, 0, 1, 2])):
            words.insert(rng.randrange(len(words) + 1), name)
            words.insert(rng.randrange(len(words) + 1), f"of-{name[:2]}-{rng.randrange(3)}")
        rows.append(" ".join(words))
    want = plain_terms(rows)
    assert len(want) > 3
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for sent in (P.SENT, 0):
        monkeypatch.setattr(P, "SENT", sent)
        got = {rows[r.doc_id][a:b] for r in P.personal_data(df).collect() for a, k, b in P._parsed(r.spans) if k == 4}
        assert got == want


def test_term_counts_like_plain_words(spark, odd):
    rows = [(900, "--a-- (b) ... c.d , ,x' \\y\\ [z] ^&- A a"), (901, "..."), (902, " \t lead\ntrail. ")]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {}
    for r in df.collect():
        for term in {w for *_, w in P._terms(r.text or "")}:
            want[term] = want.get(term, 0) + 1
    assert {r.term: r.n_term for r in P.term_counts(df).collect()} == want


def test_odd_rows(spark, odd, none):
    assert P.personal_data(none).collect() == [] and P.sanitise(none).collect() == []
    assert P.personal_data(odd).count() == P.sanitise(odd).count() == odd.count()
    rows = [(1, "x@y.zz " * 3000), (1, "x@y.zz " * 3000), (None, "x@y.zz"), (2, None)]
    got = P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_email for r in got) == [0, 1, 3000, 3000]


def test_parts_of_very_many_zeros():
    text = "at " + "0" * 6000 + "7.0.0.1"
    assert P.base_spans(text)[0] == (3, 1, len(text))
