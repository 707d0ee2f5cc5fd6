import hashlib

import duckdb
import regex

from meshquarry.llm import infill as I
from meshquarry.llm.sql import SQL


def plain_way(doc_id, text):
    """By the rule, with slices of the text itself."""
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i * 8 : i * 8 + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out = "plain", text
    elif h[3] % 100 < 20:
        form, out = "spm", "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    else:
        form, out = "psm", "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, n, form, *((None, None) if form == "plain" else (a, b - a)), sha(out), sha(text)


def rows():
    return [(i, t) for i, t in enumerate(["", None, "a", "<P>x", "tail <S>", "<M>", "<", "<P", "S>", "<<S><M", "é€𝄞" * 40, "line\nline\r\n", "x" * 70_000] + [f"text {'<P' * (k % 3)} number {k} é" * (k % 7 + 1) for k in range(300)])]


def test_query_like_the_rule_and_sql(spark, odd, none, tmp_path):
    df = odd.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in rows()] + [(1003, "<P>x")], "doc_id long, text string"), allowMissingColumns=True)
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = I.op13_infill(spark, str(tmp_path))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert got == sorted((plain_way(r.doc_id, r.text) for r in df.collect()), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(db.execute(SQL["op13_infill"]).fetchall(), key=repr)
    assert I.fill_in_middle(none).collect() == []


def test_any_unit_is_restored(spark):
    text = "<é<S é́ two words, <P and <M more\n" * 3
    for unit in (I.CODE_POINTS, I.GRAPHEMES, r"\w+\s*", r"[^\n]*\n", "nothing"):
        plan, pattern = I.Plan(unit=unit, seed=5, suffix_first=50), regex.compile(unit)
        forms = set()
        for i in range(200):
            n, form, prefix, middle, out = I.infilled(text, i, plan, pattern)
            forms.add(form)
            assert I.rebuilt(out, form) == text and n == len(list(pattern.finditer(text)))
            if form != "plain":
                edges = {0, *(m.end() for m in pattern.finditer(text))}
                assert {prefix, prefix + middle} <= edges
        assert forms == {"plain", "psm", "spm"}


def test_text_next_to_marks():
    for text in ("<S", "S><P", "<M<P<S", "P>S>M>", "<"):
        for i in range(60):
            _, form, _, _, out = I.infilled(text, i, I.Plan(transformed=100, suffix_first=50), regex.compile(I.CODE_POINTS))
            assert I.rebuilt(out, form) == text


def test_output_column(spark):
    df = spark.createDataFrame([(7, "hello world, this is text", "x")], "doc_id long, text string, output string")
    r = I.fill_in_middle(df, I.Plan(transformed=100)).first()
    assert sorted(r.output.replace("<P>", "").replace("<S>", "").replace("<M>", "")) == sorted("hello world, this is text") and len(r.output) == 25 + 9
