import zlib

import numpy as np
import pytest

from meshquarry.llm import packing as K
from meshquarry.llm.tokens import Encoder, encoder, public_path


@pytest.fixture(scope="module")
def plain():
    tok = encoder(public_path()).tokenizer
    return lambda t: tok.encode(t, add_special_tokens=False).ids


TEXTS = ["", "Hello, world. Hello", "ÉCOLE école. Straße İstanbul ǅ Σς", "a  b\t\tc\r\nd e f\x1cg", "don't we'll 'tis 12.5 ... ?!, x., (y)", "é ́x café", "<|endoftext|> </w> 日本語 text", "!" * 300, "word, " * 50]


def test_encoder_equals_the_tokenizer(plain, monkeypatch):
    enc = Encoder(public_path())
    for _ in range(2):
        got = [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(TEXTS)]
        assert got == [plain(t) for t in TEXTS]
    assert enc.by_word
    for name in ("byte_bpe_50k.json",):
        enc = Encoder(public_path(name))
        assert [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(TEXTS)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


def check(docs, rows, plain, parts):
    ids = {i: [*plain(t or ""), K.END] for i, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            piece = ids[i][r.start : r.start + r.length]
            assert r.start == at and r.length == len(piece) > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    short = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= K.WINDOW
        short += at < K.WINDOW
    assert short <= parts  # a partition's last sequence


@pytest.mark.parametrize("shard", [10**6, 500])
def test_contract(odd, none, plain, monkeypatch, shard):
    monkeypatch.setattr(K, "SHARD_IDS", shard)
    docs = odd.where("doc_id IS NOT NULL")
    check([(r.doc_id, r.text) for r in docs.collect()], K.pack(docs).collect(), plain, 4)
    assert K.pack(none).collect() == []
    assert sum(r.length for r in K.pack(odd).collect()) == sum(len(plain(r.text or "")) + 1 for r in odd.collect())


def test_neighbours_like_plain_bm25():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(30)]
    unused = np.ones(30, bool)
    unused[[3, 4]] = False
    sets, mean = [d.tolist() for d in docs], np.mean([len(d) for d in docs])
    df = {t: sum(t in s for s in sets) for t in range(60)}
    shard = K.Shard(docs, K.Corpus(30, mean, np.array([np.log1p((30 - df[t] + 0.5) / (df[t] + 0.5)) for t in range(60)])))
    weight = lambda t, d: np.log1p((30 - df[t] + 0.5) / (df[t] + 0.5)) * sets[d].count(t) * 2.2 / (sets[d].count(t) + 1.2 * (0.25 + 0.75 * len(sets[d]) / mean))
    terms = [t for t in set(sets[7]) if df[t] > 1]
    score = {d: sum(weight(t, d) for t in terms if t in sets[d]) for d in range(30) if unused[d]}
    got = shard.neighbours(7, unused).tolist()
    assert set(got) == {d for d, s in score.items() if s > 0}
    assert all(score[a] >= score[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))


def test_statistics_are_of_all_documents(spark, plain):
    rows = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, None)] * 5, "doc_id int, text string").repartition(4)
    stats = K.corpus(K.tokenized(rows, public_path()), public_path())
    lengths = [len(plain(t)) + 1 for t in ("alpha beta beta", "alpha", "")]
    assert stats.n == 15 and abs(stats.mean - sum(lengths) / 3) < 1e-9
    for word, held in (("alpha", 10), ("beta", 5)):
        assert all(abs(stats.idf[i] - np.log1p((15 - held + 0.5) / (held + 0.5))) < 1e-9 for i in plain(word))
    assert {r.doc_id for r in K.pack(rows).collect()} == {1, 2, 3}


def test_neighbours_share_a_window(spark):
    whole = sorted(w[:-4] for w in encoder(public_path()).tokenizer.get_vocab() if w.endswith("</w>") and w[:-4].isalpha() and w.isascii() and len(w) > 10)
    topics = [whole[k * 30 : k * 30 + 30] for k in range(6)]  # each word one id
    rows = [(i, " ".join(topics[i % 6][(i * 7 + j) % 30] for j in range(60))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same = total = 0
    by = {}
    for r in K.pack(df).collect():
        by.setdefault(r.sequence_id, []).append(r.doc_id % 6)
    for topics_ in by.values():
        same += sum(a == b for a, b in zip(topics_, topics_[1:], strict=False))
        total += len(topics_) - 1
    assert same > 0.7 * total
