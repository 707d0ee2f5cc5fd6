"""Dense arrays in NumPy files as tables of blocks, and back."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BLOCKS = "path string, iz int, iy int, ix int, z0 int, y0 int, x0 int, dz int, dy int, dx int, dtype string, payload binary"

#: Voxels of small blocks that go to Spark at once.
VOXELS = 1 << 16


def read_npy(spark: SparkSession, path: str, block: tuple[int, int, int], member: str | None = None) -> DataFrame:
    """Blocks of the three-dimensional arrays in .npy or .npz files, in C order. Of an .npz the member of that name is read, or
    its only three-dimensional one. Pickled objects are refused. A file is read by one task; larger volumes come as several
    files, or as blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                volume = np.load(io.BytesIO(content), allow_pickle=False)
                if not isinstance(volume, np.ndarray):
                    solid = [k for k in volume.files if volume[k].ndim == 3]
                    if member not in volume.files and len(solid) != 1:
                        raise ValueError(f"{name}: no member {member!r}, and {len(solid)} of three dimensions")
                    volume = volume[member if member in volume.files else solid[0]]
                if volume.ndim != 3:
                    raise ValueError(f"{name}: {volume.ndim} dimensions")
                for z in range(0, volume.shape[0], block[0]):
                    for y in range(0, volume.shape[1], block[1]):
                        for x in range(0, volume.shape[2], block[2]):
                            part = np.ascontiguousarray(volume[z : z + block[0], y : y + block[1], x : x + block[2]])
                            yield pd.DataFrame([(name, z // block[0], y // block[1], x // block[2], z, y, x, *part.shape, part.dtype.str, part.tobytes())], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(path).select("path", "content")
    return files.mapInPandas(run, BLOCKS)


def voxels(blocks: DataFrame) -> DataFrame:
    """(path, z, y, x, value) of every voxel: for labels and oracles; dense arithmetic stays with blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for b in pdf.itertuples(index=False):
                part = np.frombuffer(b.payload, np.dtype(b.dtype)).reshape(b.dz, b.dy, b.dx)
                z, y, x = (a.ravel() for a in np.indices(part.shape))
                out.append((np.full(part.size, b.path, object), z + b.z0, y + b.y0, x + b.x0, part.ravel().astype(np.float64)))
                held += part.size
                if held >= VOXELS:
                    yield together(out)
                    out, held = [], 0
            if out:
                yield together(out)

    def together(parts: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("path", "z", "y", "x", "value"), zip(*parts, strict=True), strict=True)})

    return blocks.mapInPandas(run, "path string, z long, y long, x long, value double")
