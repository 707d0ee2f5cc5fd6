"""Block reads of NumPy files against the arrays themselves."""

import numpy as np
import pytest

from meshquarry.sources import arrays, volumes

SHAPE = (7, 6, 9)


def cube(rows, shape=SHAPE):
    out = np.full(shape, -1)
    for r in rows:
        part = np.frombuffer(r.payload, r.dtype).reshape(r.dz, r.dy, r.dx)
        place = out[r.z0 : r.z0 + r.dz, r.y0 : r.y0 + r.dy, r.x0 : r.x0 + r.dx]
        assert (place == -1).all()
        place[...] = part
    return out


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["npy", "npz", "packed"])
def test_every_block_and_a_box(spark, tmp_path, kind, order):
    v = np.asarray(np.arange(np.prod(SHAPE), dtype=np.uint16).reshape(SHAPE), order=order)
    path = str(tmp_path / ("v.npy" if kind == "npy" else "v.npz"))
    np.save(path, v) if kind == "npy" else (np.savez if kind == "npz" else np.savez_compressed)(path, labels=v, other=v[:2] + 1, flat=np.zeros((2, 2)))
    df = volumes.read_blocks(spark, path, (3, 4, 2), integers=True, task_bytes=100)
    assert df.rdd.getNumPartitions() == (1 if kind == "packed" else 15)
    assert (cube(df.collect()) == v).all()
    box = volumes.read_blocks(spark, path, (3, 4, 2), (1, 2, 3, 6, 99, 8))
    want = np.full(SHAPE, -1)
    want[1:6, 2:, 3:8] = v[1:6, 2:, 3:8]
    assert (cube(box.collect()) == want).all()
    assert volumes.read_blocks(spark, path, (3, 4, 2), (8, 0, 0, 9, 9, 9)).collect() == []


def test_a_box_reads_nothing_else(spark, tmp_path):
    v = np.arange(np.prod(SHAPE)).reshape(SHAPE)
    np.save(tmp_path / "v.npy", v)
    with open(tmp_path / "v.npy", "r+b") as f:  # the last layers are gone: blocks that are read would fail
        f.truncate(128 + 8 * 54 * 3)
    got = volumes.read_blocks(spark, str(tmp_path), (3, 4, 2), (0, 0, 4, 3, 4, 8), task_bytes=1)
    assert got.rdd.getNumPartitions() == 2
    want = np.full(SHAPE, -1)
    want[:3, :4, 4:8] = v[:3, :4, 4:8]
    assert (cube(got.collect()) == want).all()
    assert got.where("ix = 3").count() == 1 and got.count() == 2  # one frame, asked twice
    with pytest.raises(Exception, match="ends before"):
        volumes.read_blocks(spark, str(tmp_path), (3, 4, 2)).collect()


def test_refused(spark, tmp_path):
    def of(name, **k):
        return volumes.read_blocks(spark, str(tmp_path / name), (2, 2, 2), **k).collect()

    np.save(tmp_path / "f.npy", np.ones((2, 2, 2)))
    np.save(tmp_path / "two.npy", np.ones((2, 2)))
    np.save(tmp_path / "o.npy", np.full((2, 2, 2), None, object), allow_pickle=True)
    np.savez(tmp_path / "z.npz", a=np.ones((2, 2, 2)), b=np.ones((2, 2, 2)))
    for name, why, k in [("f.npy", "whole numbers", {"integers": True}), ("two.npy", "2 dimensions", {}), ("o.npy", "allow_pickle", {}), ("z.npz", "no member", {}), ("z.npz", "no member", {"member": "c"}), ("none.npy", "none.npy", {})]:
        with pytest.raises(Exception, match=why):
            of(name, **k)
    assert len(of("z.npz", member="b")) == 1


def test_like_the_other_reader(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(60).reshape(3, 4, 5))
    key = lambda r: (r.iz, r.iy, r.ix)
    one = sorted(volumes.read_blocks(spark, str(tmp_path / "v.npy"), (2, 3, 2)).drop("path").collect(), key=key)
    assert one == sorted(arrays.read_npy(spark, str(tmp_path / "v.npy"), (2, 3, 2)).drop("path").collect(), key=key)


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(40):
        np.save(tmp_path / f"{i:02}.npy", np.full((2, 2, 2), i, np.int64))
    got = volumes.read_blocks(spark, str(tmp_path), (1, 2, 2))
    assert got.rdd.getNumPartitions() == 1 and got.count() == 80
    assert sorted({(r.path[-6:-4], r.value) for r in arrays.voxels(got).collect()}) == [(f"{i:02}", float(i)) for i in range(40)]
