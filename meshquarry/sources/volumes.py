"""NumPy volumes read block by block: each task reads the bytes of its own blocks, and only those inside a box."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice, product
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from meshquarry.operators.blocks import Grid
from meshquarry.sources.arrays import BLOCKS

Triple = tuple[int, int, int]
#: Members of an archive that are taken by name, the first that is there. Fixed values.
PREFERRED = ("segmentation", "labels", "seg")
#: Bytes of whole blocks that a task reads.
TASK_BYTES = 128 << 20
#: Files that a task opens, one after the other.
TASK_FILES = 256
#: Blocks, and their bytes, that go to Spark at once.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 20
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in BLOCKS.split(", ")])


def read_blocks(spark: SparkSession, path: str, block: Triple, box: tuple[int, ...] | None = None, member: str | None = None, integers: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Blocks, with the columns of `arrays.read_npy`, of a .npy or .npz file, or of all of them in a folder; paths are those of
    pyarrow's file systems. Blocks stand on a grid from the volume's origin; a box (z0, y0, x0, z1, y1, x1) leaves the parts of the
    blocks inside it, and nothing else is planned or read. Filters on the rows are Spark's, after the read: in Spark 4.1 what one
    query pushes into a Python source stays in the frame, and a second query of the frame would lose rows.

    Of an archive the member of the given name is read, else the first of `PREFERRED`, else its only three-dimensional one. A stored
    member is read like a file; a compressed one is unpacked by one task, as its bytes have no places. Anything but three
    dimensions, pickled objects, and other than whole numbers where `integers` is asked, are refused. The driver reads headers only.
    """
    if any(b < 1 for b in block) or task_bytes < 1 or (box and len(box) != 6):
        raise ValueError("blocks and tasks must hold something, and a box has six sides")
    spark.dataSource.register(VolumeSource)
    options = {"block": ",".join(map(str, block)), "task_bytes": task_bytes, "integers": integers}
    options |= {"box": ",".join(map(str, box))} if box else {}
    options |= {"member": member} if member else {}
    return spark.read.format(VolumeSource.name()).options(**options).load(path)


class VolumeSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> D.DataSourceReader:
        return VolumeReader(self.options)


@dataclass
class Part(D.InputPartition):
    """Blocks number first to last, in C order, of those between lo and hi."""

    path: str
    member: str | None
    at: int
    shape: Triple
    dtype: str
    fortran: bool
    lo: Triple
    hi: Triple
    first: int
    last: int


@dataclass
class Parts(D.InputPartition):
    """What one task reads: of small files, many."""

    parts: list[Part]


class VolumeReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.member = options["path"], options.get("member")
        self.block = tuple(int(v) for v in options["block"].split(","))
        self.box = tuple(int(v) for v in options["box"].split(",")) if "box" in options else None
        self.integers, self.task_bytes = str(options.get("integers", "false")).lower() == "true", int(options.get("task_bytes", TASK_BYTES))

    def partitions(self) -> list[Parts]:
        out = []
        for path in _files(self.path):
            part = _described(path, self.member)
            dtype = np.dtype(part.dtype)
            if dtype.hasobject or len(part.shape) != 3:
                raise ValueError(f"{path}: " + ("pickled objects are refused (allow_pickle)" if dtype.hasobject else f"{len(part.shape)} dimensions"))
            if self.integers and not np.issubdtype(dtype, np.integer):
                raise ValueError(f"{path}: {dtype} values, not whole numbers")
            lo, hi = [], []
            for a in range(3):
                first, end = (self.box[a], self.box[a + 3]) if self.box else (0, part.shape[a])
                first, end = max(0, first), min(end, part.shape[a])
                lo.append(first // self.block[a])
                hi.append(-(-end // self.block[a]))
            n = prod(max(0, h - l) for l, h in zip(lo, hi, strict=True))
            each = n if part.at < 0 else max(1, self.task_bytes // (prod(self.block) * dtype.itemsize))
            out += [replace(part, lo=tuple(lo), hi=tuple(hi), first=i, last=min(n, i + each)) for i in range(0, n, max(each, 1))]
        bundles, room = [], 0
        for part in out:
            wanted = (part.last - part.first) * prod(self.block) * np.dtype(part.dtype).itemsize
            if wanted > room or len(bundles[-1].parts) == TASK_FILES:
                bundles.append(Parts([]))
                room = self.task_bytes
            bundles[-1].parts.append(part)
            room -= wanted
        return bundles

    def read(self, bundle: Parts) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part in bundle.parts:
            for row in self.rows(part):
                rows.append(row)
                held += len(row[-1])
                if held >= BATCH_BYTES or len(rows) == BATCH_ROWS:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def rows(self, part: Part) -> Iterator[list]:
        system, name = _located(part.path)
        dtype = np.dtype(part.dtype)
        whole = None
        with system.open_input_file(name) as f:
            if part.at < 0:
                with zipfile.ZipFile(f) as z, z.open(f"{part.member}.npy") as m:
                    whole = np.lib.format.read_array(m, allow_pickle=False)
            for b in islice(product(*(range(l, h) for l, h in zip(part.lo, part.hi, strict=True))), part.first, part.last):
                lo = [i * s for i, s in zip(b, self.block, strict=True)]
                hi = [min(o + s, n) for o, s, n in zip(lo, self.block, part.shape, strict=True)]
                if self.box:
                    lo, hi = [max(o, c) for o, c in zip(lo, self.box[:3], strict=True)], [min(o, c) for o, c in zip(hi, self.box[3:], strict=True)]
                if any(l >= h for l, h in zip(lo, hi, strict=True)):
                    continue
                if whole is not None:
                    got = whole[lo[0] : hi[0], lo[1] : hi[1], lo[2] : hi[2]]
                elif part.fortran:  # the same bytes as the axes turned round, in C order
                    got = _read(f, part.at, part.shape[::-1], dtype, lo[::-1], hi[::-1]).transpose()
                else:
                    got = _read(f, part.at, part.shape, dtype, lo, hi)
                yield [part.path, *b, *lo, *got.shape, dtype.str, np.ascontiguousarray(got).tobytes()]


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _read(f: pa.NativeFile, at: int, shape: Triple, dtype: np.dtype, lo: list[int], hi: list[int]) -> np.ndarray:
    """The voxels between lo and hi: a read a layer where at least half of each row is wanted, else a read a row."""
    (_, ny, nx), size = shape, dtype.itemsize
    out = np.empty([h - l for l, h in zip(lo, hi, strict=True)], dtype)

    def bytes_at(place: int, n: int) -> np.ndarray:
        f.seek(at + place * size)
        if len(raw := f.read(n * size)) != n * size:
            raise ValueError("the file ends before its volume")
        return np.frombuffer(raw, dtype)

    for i, z in enumerate(range(lo[0], hi[0])):
        if 2 * out.shape[2] >= nx:
            out[i] = bytes_at((z * ny + lo[1]) * nx, out.shape[1] * nx).reshape(-1, nx)[:, lo[2] : hi[2]]
        else:
            for j, y in enumerate(range(lo[1], hi[1])):
                out[i, j] = bytes_at((z * ny + y) * nx + lo[2], out.shape[2])
    return out


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    system, name = _located(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    inside = system.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted(path.rstrip("/") + i.path[len(name.rstrip("/")) :] for i in inside if i.is_file and i.path.endswith((".npy", ".npz")))


def _header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)


def _described(path: str, member: str | None) -> Part:
    system, name = _located(path)
    with system.open_input_file(name) as f:
        if not path.endswith(".npz"):
            shape, fortran, dtype = _header(f)
            return Part(path, None, f.tell(), shape, dtype.str, fortran, (), (), 0, 0)
        with zipfile.ZipFile(f) as z:
            found = {}
            for i in z.infolist():
                with z.open(i) as m:
                    found[i.filename.removesuffix(".npy")] = (i, _header(m), m.tell())
            solid = [k for k, v in found.items() if len(v[1][0]) == 3]
            chosen = member if member in solid else next((k for k in PREFERRED if not member and k in solid), None)
            if chosen is None and (member or len(solid) != 1):
                raise ValueError(f"{path}: no member {member!r}, and {len(solid)} of three dimensions")
            i, (shape, fortran, dtype), behind = found[chosen or solid[0]]
        at = -1
        if i.compress_type == zipfile.ZIP_STORED:
            f.seek(i.header_offset + 26)  # the lengths of the local name and extra field stand here, the data behind both
            lengths = np.frombuffer(f.read(4), "<u2")
            at = i.header_offset + 30 + int(lengths.sum()) + behind
        return Part(path, chosen or solid[0], at, shape, dtype.str, fortran, (), (), 0, 0)


def write_blocks(blocks: DataFrame, grid: Grid, column: str, folder: str, dtype: str) -> DataFrame:
    """Writes a column of blocks (volume, bz, by, bx) as a .npy file each, and gives (path, sha256, size). A task that runs again
    writes the same bytes to the same place. Needs an action, and a folder that all executors share."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, name = _located(folder)
        system.create_dir(name, recursive=True)
        for pdf in batches:
            out = []
            for volume, *at, values in pdf.itertuples(index=False):
                held = io.BytesIO()
                np.save(held, np.asarray(values, dtype).reshape(grid.extent(at)), allow_pickle=False)
                file = f"/v{volume}_z{at[0]}_y{at[1]}_x{at[2]}.npy"
                with system.open_output_stream(name.rstrip("/") + file) as f:
                    f.write(held.getvalue())
                out.append((folder.rstrip("/") + file, hashlib.sha256(held.getvalue()).hexdigest(), len(held.getvalue())))
            yield pd.DataFrame(out, columns=["path", "sha256", "size"])

    return blocks.select("volume", "bz", "by", "bx", column).mapInPandas(run, "path string, sha256 string, size long")
