import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquarry.llm import mixcoder as M
from meshquarry.llm import tokenfile as T
from meshquarry.llm.tokens import encoder, public_path


@pytest.mark.parametrize("sizes", [[0], [1], [31, 0, 33], [5000, 1, 700], [70_000]])
@pytest.mark.parametrize("kind", ["noise", "skewed", "repeating"])
def test_blocks_come_back(sizes, kind):
    rng = np.random.default_rng(1)
    make = {"noise": lambda n: rng.integers(0, 1000, n), "skewed": lambda n: rng.geometric(0.3, n) % 1000, "repeating": lambda n: np.arange(n) % 7 * 100}[kind]
    blocks = [make(n) for n in sizes]
    coded = M.encode(blocks, 1000)
    assert all((a == b).all() for a, b in zip(blocks, M.decode(coded, sizes, 1000), strict=True))
    for b, c in zip(blocks, coded, strict=True):
        if len(b) >= 70_000:  # in small blocks, the fresh model and the ends of the streams weigh most
            assert len(c) * 8 / len(b) < {"noise": 11.5, "skewed": 3.7, "repeating": 0.8}[kind]  # entropies: 10, 2.9, 0
        assert M.encode([b], 1000) == [c]  # a block doesn't depend on those beside it


def test_higher_orders_pay(monkeypatch):
    rng = np.random.default_rng(2)
    follow = rng.integers(0, 500, (500, 2))
    ids = [0]
    for _ in range(20_000):
        ids.append(int(follow[ids[-1], int(rng.random() < 0.1)]))
    with_orders = len(M.encode([np.array(ids)], 500)[0])
    rng.shuffle(ids)
    assert with_orders < 0.6 * len(M.encode([np.array(ids)], 500)[0])


def test_mixing_beats_order_0():
    """On words of a few syllables, by a twentieth at least."""
    enc = encoder(public_path())
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(["the", "an", "ing", "re", "tion", "ed"], rng.integers(1, 4))) for _ in range(400)]
    text = " ".join(words[min(399, int(rng.exponential(60)))] for _ in range(40_000))
    ids = np.frombuffer(enc.encode([text])[0], enc.kind).astype(np.int64)[:65_536]
    size = {k: len(M.encode([ids], enc.size, k)[0]) for k in (0, 1, 2)}
    assert size[1] < 0.95 * size[0] and size[2] < 0.95 * size[0]
    for k in (0, 1, 2):
        assert (M.decode(M.encode([ids[:5000]], enc.size, k), [5000], enc.size, k)[0] == ids[:5000]).all()


def test_lists_of_followers_that_change(monkeypatch):
    """Counts that reach their limit, slots that two contexts share, and order 0 at its limit."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(M, "SLOTS", (8, 16))
    monkeypatch.setattr(M, "LIMIT", 1 << 13)
    for n in (40, 5_000, 30_000):
        ids = np.where(rng.random(n) < 0.7, np.arange(n) % 5, rng.integers(0, 300, n))
        assert (M.decode(M.encode([ids, ids[: n // 2]], 300), [n, n // 2], 300)[0] == ids).all()


def test_order_0_that_turns():
    """Lists hold ids whose share of order 0 was noted when each in turn was nearly all there was."""
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.where(rng.random(1500) < 0.97, k, rng.integers(0, 400, 1500)) for k in (*range(9), *range(9))])
    for n in (300, 4_000, len(ids)):
        assert (M.decode(M.encode([ids[:n]], 400), [n], 400)[0] == ids[:n]).all()
    with pytest.raises(ValueError):
        M.encode([ids], 1 << 17)


def test_blocks_beside_each_other():
    """Readers may put other blocks together than the writer did, short ones alone too."""
    rng = np.random.default_rng(7)
    sizes = [1, 2, 127, 128, 129, 300, 1_000, 5_000, 20_000, 3]
    blocks = [np.minimum(rng.zipf(1.3, n), 999) for n in sizes]
    coded = M.encode(blocks, 1000)
    for b, c, n in zip(blocks, coded, sizes, strict=True):
        assert M.encode([b], 1000) == [c] and (M.decode([c], [n], 1000)[0] == b).all()


def test_coding_is_cheap():
    """Both ways together, measured by what sorting the same ids takes (before: 78 times that)."""
    rng = np.random.default_rng(6)
    blocks = [np.minimum(rng.zipf(1.2, 65_536), 49_000).astype(np.int64) for _ in range(32)]
    took = {"sort": [], "code": []}
    for _ in range(2):
        began = time.process_time()
        for b in blocks:
            np.argsort(b, kind="stable")
        took["sort"].append(time.process_time() - began)
        began = time.process_time()
        back = M.decode(M.encode(blocks, 49_408), [len(b) for b in blocks], 49_408)
        took["code"].append(time.process_time() - began)
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    assert min(took["code"]) < 40 * min(took["sort"])


def test_damage_is_noticed():
    ids = np.arange(300) % 17
    block = M.frame(M.encode([ids], 20)[0], ids, b"index")
    n, crc, index, words = M.unframe(block)
    assert (n, crc, index) == (300, zlib.crc32(ids.astype("<u4").tobytes()), b"index") and (M.decode([words], [n], 20)[0] == ids).all()
    for k in range(0, len(block), 7):
        bad = bytearray(block)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            M.unframe(bytes(bad))
    with pytest.raises(ValueError):
        M.decode([words[:-4]], [n], 20)


@pytest.mark.parametrize("block", [65_536, 40])
def test_round_trip(spark, odd, none, tmp_path, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK_IDS", block)
    monkeypatch.setattr(T, "TOGETHER", 3)
    plain = encoder(public_path()).tokenizer
    docs = odd.where("doc_id <> 11 OR doc_id IS NULL")  # the very long one goes elsewhere
    T.write_tokens(docs, f"{tmp_path}/a")
    got = {(r.doc_id, r.start): list(r.ids) for r in T.read_tokens(spark, f"{tmp_path}/a").collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = {}, 0
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, T.END]
        want[i, at] = ids
        at += len(ids)
    assert got == want
    for r in T.digests(T.read_tokens(spark, f"{tmp_path}/a")).collect():
        ids = want[r.doc_id, r.start]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    T.write_tokens(none, f"{tmp_path}/b")
    assert T.read_tokens(spark, f"{tmp_path}/b").collect() == []


def test_very_long_text(spark, odd, tmp_path):
    """A document of several blocks among small ones."""
    long = odd.where("doc_id IN (4, 9, 11)").withColumn("text", F.when(F.col("doc_id") == 9, F.repeat(F.concat("text", F.lit(" two, ")), 100_000)).otherwise(F.col("text")))
    T.write_tokens(long, f"{tmp_path}/c")
    assert max(len(r.blocks) for r in spark.read.parquet(f"{tmp_path}/c").collect()) > 4
    plain, at = encoder(public_path()).tokenizer, 0
    rows = {r.doc_id: r for r in T.read_tokens(spark, f"{tmp_path}/c").collect()}
    for r in sorted(long.collect(), key=lambda r: r.doc_id):
        assert list(rows[r.doc_id].ids) == [*plain.encode(r.text, add_special_tokens=False).ids, T.END] and rows[r.doc_id].start == at
        at += len(rows[r.doc_id].ids)


def test_memory_is_bounded():
    """A document of 2,000,000 ids beside 40 of usual size, with a vocabulary of 50,000."""
    rng = np.random.default_rng(3)
    rows = [(0, 0, [k], [rng.integers(0, 50_000, 60_000).astype("<u2")]) for k in range(40)]
    rows.append((0, 0, [99], [rng.integers(0, 50_000, 2_000_000).astype("<u2")]))
    tracemalloc.start()
    blocks = T._coded(rows, 50_000).column(3).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    assert len(blocks[-1]) == 31 and peak < 150e6
    frames = [M.unframe(f) for f in blocks[-1]]
    back = np.concatenate(M.decode([f[3] for f in frames], [f[0] for f in frames], 50_000))
    assert (back == rows[-1][3][0]).all() and tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
