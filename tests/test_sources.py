import json

import numpy as np
import pytest

from meshquarry.sources import arrays, json_records, store


def test_arrays_in_blocks_and_back(spark, tmp_path):
    volume = np.arange(5 * 6 * 7, dtype=np.uint16).reshape(5, 6, 7)
    np.save(tmp_path / "a.npy", volume)
    blocks = arrays.read_npy(spark, str(tmp_path), (2, 4, 4))
    assert blocks.count() == 3 * 2 * 2
    got = arrays.voxels(blocks).toPandas()
    assert len(got) == volume.size and (volume[got.z, got.y, got.x] == got.value).all()


def test_archives_give_their_only_volume(spark, tmp_path):
    np.savez(tmp_path / "b.npz", table=np.zeros((2, 2)), labels=np.ones((2, 2, 2), np.int32))
    assert arrays.voxels(arrays.read_npy(spark, str(tmp_path), (2, 2, 2))).where("value = 1").count() == 8


def test_pickles_are_refused(spark, tmp_path):
    np.save(tmp_path / "c.npy", np.array([{"a": 1}], object), allow_pickle=True)
    with pytest.raises(Exception, match="allow_pickle|Object arrays"):
        arrays.read_npy(spark, str(tmp_path), (2, 2, 2)).collect()


def test_collections(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"items": [{"id": "a", "n": 1}, {"id": "b", "n": None}]}, indent=1))
    (tmp_path / "two.json").write_text(json.dumps({"other": []}))
    assert {(r.id, r.n) for r in json_records.collection(spark, str(tmp_path), "items", "id string, n long").collect()} == {("a", 1), ("b", None)}
    assert json_records.collection(spark, str(tmp_path / "none.json"), "items", "id string").count() == 0


def test_event_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert sorted(r.id for r in json_records.event_log(spark, str(tmp_path / "log.jsonl"), "id long").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        json_records.event_log(spark, str(tmp_path / "bad.jsonl"), "id long").collect()


def test_payloads_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "blobs")
    store.put_once(spark.createDataFrame([("x",), ("y",), ("x",)], "payload string"), path)
    store.put_once(spark.createDataFrame([("y",), ("z",)], "payload string"), path)
    assert sorted(bytes(r.payload) for r in spark.read.parquet(path).collect()) == [b"x", b"y", b"z"]


def test_written_once_or_the_same(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    assert store.write_same(rows, path) and not store.write_same(rows.orderBy("id", ascending=False), path)
    with pytest.raises(ValueError, match="other rows"):
        store.write_same(rows.where("id = 1"), path)
    with pytest.raises(Exception, match="already exists"):
        store.write_new(rows, path)


def test_latest_receipts(spark):
    rows = spark.createDataFrame([("a", 1, "ok", "p"), ("a", 3, "bad", "q"), ("b", 2, "ok", "r"), ("a", 3, "ok", "z")], "tool string, at int, status string, payload string")
    assert sorted(tuple(r) for r in store.latest_receipts(rows).collect()) == [("a", 3, "ok", "z"), ("b", 2, "ok", "r")]
