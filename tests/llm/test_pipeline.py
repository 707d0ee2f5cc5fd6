import random

import pytest

import corpus_pipeline as C
from meshquarry.llm import decontam as D
from meshquarry.llm import langid as L
from meshquarry.llm.tokens import encoder, public_path
from tests.llm.test_neardup import naive, roots
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    say = {"en": ["the", "an", "ing", "wh", "er"], "de": ["sch", "ein", "ü", "der", "ß"]}
    text = lambda lang, n: " ".join("".join(rng.choice(say[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "de"])
        rows.append((i, "\n".join(text(lang, 12) for _ in range(rng.randint(1, 6))), lang))
    items = [text("en", 25) for _ in range(4)]
    rows += [(200, rows[3][1], "en"), (201, rows[4][1] + " more", "de"), (202, text("en", 30) + " " + items[0].upper() + " " + text("en", 20), "en"), (203, "12 34 --", "en"), (204, None, None), (205, "", "en")]
    rows += [(210 + k, f"a line that all of these share\n{text('de', 40)}", None) for k in range(6)]
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()  # noqa: E731  no upper case outside A-Z here
    first = {}
    for i, t in sorted(rows.items()):
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                first.setdefault(key(x), i)
    return {i: "\n".join(x for x in t.split("\n") if first.get(key(x), i) == i) for i, t in rows.items()}


def test_each_stage_and_run_like_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [D.words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    at = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            at = {i: t for i, t in at.items() if t and L._LETTER.search(t)}
        elif name == "line_dedup":
            at = lines(at)
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near_dedup":
            ids = sorted(at)
            root = roots([naive(at[i]) for i in ids])
            at = {ids[k]: at[ids[k]] for k in range(len(ids)) if root[k] == k}
        else:
            from tests.llm.test_decontam import edits

            at = {i: t for i, t in at.items() if not any(edits(x, D.words(t)) <= D.most_edits(len(x)) for x in items)}
        assert {i: r.text for i, r in got.items()} == at, name
    assert not {202, 203, 204} & set(at) and at.get(200, "") == "" and 89 in at
    plain = encoder(public_path()).tokenizer
    pieces = C.run(spark, folder)
    check(list(at.items()), pieces.collect(), lambda t: plain.encode(t, add_special_tokens=False).ids, 4)


def test_empty_tables(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
