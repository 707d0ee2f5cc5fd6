"""Canonical texts and digests against Python's own JSON."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from meshquarry.functions import canonical as C
from meshquarry.sources import store

NESTED = "b struct<z: int, a: array<struct<y: string, x: double>>>, a map<string, array<long>>, at string, `ü k` boolean"


def test_typed_data_like_json(spark):
    rows = [((3, [("q\"\\\n\tü", 0.5), (None, 2.0), None]), {"z": [1, None], "a": [], "at": None}, "now", True), ((None, []), {}, None, None), (None, None, "x", False), ((1, None), {"é": None, "Z": [7]}, "", None)]
    df = spark.createDataFrame(rows, NESTED)

    def plain(r):
        b = r[0] and {"z": r[0][0], "a": r[0][1] and [v and {"y": v[0], "x": int(v[1]) if v[1] == int(v[1]) else v[1]} for v in r[0][1]]}
        if r[0] and r[0][1] == []:
            b["a"] = []
        m = r[1] and {k: v for k, v in r[1].items() if k != "at"}
        return json.dumps({"b": b, "a": {} if r[1] == {} else m, "ü k": r[3]}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    got = df.select(C.canonical(F.struct("*"), df.schema, without=["at"])).collect()
    assert sorted(r[0] for r in got) == sorted(plain(r) for r in rows)
    ids = C.identified(df.select(*reversed(df.columns)), without=["at"]).collect()
    assert sorted(r.identity for r in ids) == sorted(hashlib.sha256(plain(r).encode()).hexdigest() for r in rows)


def test_numbers_agree_whatever_their_type(spark):
    one = lambda e: C.canonical(F.expr(e), spark.sql(f"SELECT {e} AS v").schema["v"].dataType)
    texts = ["3L", "3.0D", "cast(3 as float)", "1e300D", "-0.5D", "cast('NaN' as double)", "cast('-Infinity' as double)", "X'0aff'", "date'2024-05-01'", "cast(null as double)", "1.50"]
    got = spark.range(1).select(*(one(e) for e in texts)).first()
    assert list(got) == ["3", "3", "3", "1.0E300", "-0.5", '"NaN"', '"-Infinity"', '"0AFF"', '"2024-05-01"', "null", "1.50"]


def test_texts_in_any_order_of_keys(spark):
    r = random.Random(2)

    def made(depth):
        kind = r.randrange(5 if depth else 3)
        return [r.randrange(9), "é\n" * r.randrange(3), None, [made(depth - 1) for _ in range(r.randrange(4))] if depth else 1, {k: made(depth - 1) for k in r.sample("abcde", r.randrange(4))} if depth else True][kind]

    def shuffled(v):
        if isinstance(v, dict):
            keys = r.sample(sorted(v), len(v))
            return {k: shuffled(v[k]) for k in keys}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    values = [made(4) for _ in range(200)]
    rows = [(i, json.dumps(shuffled(v), indent=r.choice([None, 1]))) for i, v in enumerate(values) for _ in range(3)]
    df = spark.createDataFrame(rows, "i long, t string").select("i", C.canonical_text(F.col("t")).alias("t")).distinct().collect()
    assert len(df) == len(values) and all(x.t == json.dumps(values[x.i], sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in df)
    odd = [("{", None), (None, None), ("NaN", None), ("[" * 9000, None), ("", None), ('{"a": 2.0, "at": 1, "b": [{"at": {}, "c": 1.5}], "a": 3}', '{"a":3,"b":[{"c":1.5}]}')]
    got = spark.createDataFrame(odd, "t string, want string").select("want", C.canonical_text(F.col("t"), ["at"]).alias("got")).collect()
    assert all(x.want == x.got for x in got)


def test_digests_of_sets(spark):
    edges = [(g, i % 40, i % 7) for g in (1, 2, None) for i in range(200)] + [(3, None, None)]
    df = spark.createDataFrame(edges, "g int, a int, b int")
    one = {(r.g, r.n, r.digest) for r in C.set_digests(df, ["g"], "a", "b").collect()}
    assert one == {(r.g, r.n, r.digest) for r in C.set_digests(df.unionAll(df).orderBy(F.rand(1)), ["g"], "b", "a").collect()}
    assert len({d for _, _, d in one}) == 2 and {(g, n) for g, n, _ in one} == {(1, 200), (2, 200), (None, 200), (3, 1)}
    less = {r.g: r.digest for r in C.set_digests(df.where("NOT (g = 1 AND a = 3 AND b = 3)"), ["g"], "a", "b").collect()}
    assert less[1] not in {d for _, _, d in one} and less[2] in {d for _, _, d in one}


def test_records_are_stored_by_their_content(spark, tmp_path):
    path = str(tmp_path / "blobs")
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "n int, s string")
    refs = store.put_records(df, path).collect()
    store.put_records(df.select("s", "n"), path)
    assert len({r.sha256 for r in refs}) == 2 and spark.read.parquet(path).count() == 2
    asked = spark.createDataFrame([(r.sha256,) for r in refs[:1]] + [("0" * 64,)], "sha256 string").distinct()
    got = {r.sha256: (r.state, r.payload and bytes(r.payload)) for r in store.get(asked, path).collect()}
    assert got[refs[0].sha256][0] == "intact" and json.loads(got[refs[0].sha256][1])["n"] == refs[0].n and got["0" * 64] == ("absent", None)
    spark.createDataFrame([("0" * 64, 1, b"?")], "sha256 string, size long, payload binary").write.mode("append").parquet(path)
    assert {r.state for r in store.get(asked, path).collect()} == {"intact", "damaged"}
