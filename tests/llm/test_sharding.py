import hashlib
import zlib

from meshquarry.llm import sharding as S


def naive(key, n):
    at, nxt = -1, 0
    while nxt < n:
        at = nxt
        draw = (int(hashlib.md5(f"{at}:{key}".encode()).hexdigest()[:13], 16) + 1) / 16**13
        nxt = int((at + 1) / draw)
    return at


def test_contract(odd):
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    rows = S.shard(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        key = "" if r.doc_id is None else r.doc_id
        assert (r.law, r.shard, r.grown_shard) == ("key", naive(key, 24), naive(key, 25))
        if r.doc_id is not None:
            t = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t))
        assert r.grown_shard in (r.shard, 24)
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_spread_and_empty(spark, none):
    assert S.shard(none).collect() == []
    df = spark.range(4000).selectExpr("id doc_id", "'x' text")
    n = {r.shard: r["count"] for r in S.shard(df, 8).groupBy("shard").count().collect()}
    assert set(n) == set(range(8)) and max(n.values()) < 1.25 * min(n.values())
    assert S.shard(df, 1).where("shard <> 0").count() == 0
