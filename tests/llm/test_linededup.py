import hashlib

from meshquarry.llm import linededup as L


def naive(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and i is not None:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(key(x)) < 10 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in L.dedup_lines(df).collect()), key=str)


def test_contract(odd):
    assert result(odd) == naive([(r.doc_id, r.text) for r in odd.collect()])


def test_hot_line(spark, monkeypatch):
    rows = [(i, f"the same line everywhere\nown line number {i}\nthe same line everywhere") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(L, "SAMPLE", 2)
    assert result(df) == naive(rows)


def test_repeated_rows_and_empty(spark, none):
    assert L.dedup_lines(none).collect() == []
    rows = [(1, "a line of some length")] * 2 + [(2, "a line of some length\nb")] * 2 + [(2, "something else here\na line of some length")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == naive(rows)


def test_bitmaps_are_runs(spark):
    rows = [(1, "line number one\nline number two"), (2, "line number one\nb\nline number two\nLINE number one")]
    got = {r.doc_id: r.runs for r in L.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: [0, 1, 1, 2]}
