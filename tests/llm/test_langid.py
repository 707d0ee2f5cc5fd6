import math
import random
import zlib

import numpy as np

from meshquarry.llm import langid as L


def text(rng, syllables, n=60):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


LANGS = {"aa": ["the", "an", "ing", "wh"], "bb": ["sch", "ein", "ü", "der"], "cc": ["que", "é", "oui", "aux"]}


def rows(n=240):
    rng = random.Random(1)
    return [(i, text(rng, LANGS[lang]), lang) for i in range(n) for lang in [rng.choice(list(LANGS))]]


def test_held_out_accuracy(spark, odd, none):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = L.fit(df)
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    out = [(i, lang) for i, _, lang in rows() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(out) > 50 and sum(got[i].lang_pred == lang for i, lang in out) / len(out) > 0.98
    for r in L.identify(odd, model).collect():
        assert 0 <= r.score <= 1
    blank = {r.doc_id: r.lang_pred for r in L.identify(odd, model).collect()}
    assert [blank[i] for i in (1, 2, 3)] == ["und"] * 3 and blank[4] in LANGS
    assert L.identify(odd, model).count() == odd.count() and L.identify(none, model).collect() == []
    assert L.fit(none) is None and {r.lang_pred for r in L.identify(odd, None).collect()} == {"und"}


def test_only_rows_that_are_not_held_out_teach(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    kept = df.where(~L.held_out(df.doc_id))
    a, b = L.fit(df), L.fit(kept)
    assert all((x.codes == y.codes).all() and (x.bits == y.bits).all() and (x.escapes == y.escapes).all() for x, y in zip(a.levels, b.levels, strict=True))


def test_a_language_of_long_documents_is_learned(spark):
    long = [(i, t * 400 if lang == "aa" else t, lang) for i, t, lang in rows(60)]
    assert len(L._piece(long[0][1].encode() * 2 + b"x" * 200_000)) == L.ORDER + L.TRAIN_BYTES and min(len(t) for _, t, lang in long if lang == "aa") > L.TRAIN_BYTES
    df = spark.createDataFrame(long, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.identify(df, L.fit(df)).collect()}
    assert sum(got[i] == lang for i, _, lang in long) / len(got) > 0.95


def test_letters(spark):
    model = L.fit(spark.createDataFrame(rows(), "doc_id long, text string, lang string"))
    odd = [(1, "½ ² 12"), (2, "_ 7 !"), (3, "Ⅷ ①"), (4, "é"), (5, "字")]
    got = {r.doc_id: r.lang_pred for r in L.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert [got[i] == "und" for i in range(1, 6)] == [True, True, True, False, False]


def test_query_columns(spark, tmp_path):
    df = spark.createDataFrame([(*r, "s", 1) for r in [*rows(), (None, None, "aa"), (9001, "", None)]], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op4_langid(spark, str(tmp_path)).collect()
    assert len(got) == df.count() and {"doc_id", "held_out", "lang_pred", "score"} <= set(got[0].asDict())
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_code_lengths_like_a_plain_tree():
    """Against a walk over the text with dictionaries, with all byte values."""
    texts = {"aa": [b"abracadabra", b"banana", bytes(range(256)) * 2], "bb": [b"xyzzy xyz", "字文字".encode()]}
    langs, codes, n = [], [], []
    for lang, ts in texts.items():
        for t in ts:
            for c in L._codes(np.frombuffer(L._PAD + t, np.uint8)).tolist():
                langs.append(lang), codes.append(c), n.append(1)
    model = L.build(np.array(langs, object), np.array(codes), np.array(n))

    def cost(lang, text):
        seen = {}
        for t in texts[lang]:
            t = L._PAD + t
            for i in range(3, len(t)):
                for k in range(4):
                    seen.setdefault(t[i - k : i], []).append(t[i])
        bits, t = 0.0, L._PAD + text
        for i in range(3, len(t)):
            for k in (3, 2, 1, 0, -1):
                if k < 0:
                    bits += 8
                elif at := seen.get(t[i - k : i]):
                    if t[i] in at:
                        bits -= math.log2(at.count(t[i]) / (len(at) + len(set(at))))
                        break
                    bits -= math.log2(len(set(at)) / (len(at) + len(set(at))))
        return bits

    tries = ["字 ab 文".encode(), bytes(range(250, 256)), b"banana", b"xyz", b"abz", b"", b"zzzz", b"abracadabra" * 9]
    want = [[cost(lang, t) for lang in ("aa", "bb")] for t in tries]
    assert np.allclose(model.bits(tries), want, rtol=1e-5)
    old, L.CHUNK = L.CHUNK, 5
    assert np.allclose(model.bits(tries), want, rtol=1e-5)
    L.CHUNK = old
