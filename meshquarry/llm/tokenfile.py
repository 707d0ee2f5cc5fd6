"""Token files: ids of documents in ascending order, in compressed blocks.

A file is a folder of Parquet parts. A row holds whole documents: `part` is the range of doc_ids, `before` how many ids of it
stand in earlier rows, `n` the number of ids, `blocks` the framed blocks (see mixcoder), nearly always one. A block has at most
BLOCK_IDS ids; a longer document has a row of its own, cut into several blocks. Each block is reset and checksummed on its own;
the first of a row also holds the index of doc_ids and lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from meshquarry.llm import mixcoder
from meshquarry.llm.common import documents, scratch
from meshquarry.llm.ranges import range_of
from meshquarry.llm.tokens import encoder, public_path

END = 2
#: The most ids of a block, and how many blocks a task codes side by side: both bound its memory.
BLOCK_IDS, TOGETHER = 65_536, 32
FILE_SCHEMA = "part int, before long, n long, blocks array<binary>"


def _index(doc_ids: list[int | None], lengths: list[int]) -> bytes:
    missing = np.array([i is None for i in doc_ids], np.uint8)
    return zlib.compress(b"".join((np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), missing.tobytes())), 1)


def _indexed(index: bytes) -> tuple[list[int | None], np.ndarray]:
    raw = zlib.decompress(index)
    k = len(raw) // 17
    ids, missing = np.frombuffer(raw, "<i8", k).tolist(), np.frombuffer(raw, np.uint8, offset=16 * k)
    return [None if m else i for i, m in zip(ids, missing.tolist(), strict=True)], np.frombuffer(raw, "<i8", k, offset=8 * k)


def _coded(rows: list[tuple[int, int, list, list]], size: int) -> pa.RecordBatch:
    """Rows (part, ids before, doc_ids, ids of each) with their blocks coded, TOGETHER at most at once."""
    pieces, owner = [], []
    for k, row in enumerate(rows):
        ids = np.concatenate(row[3])
        for at in range(0, len(ids), BLOCK_IDS):
            pieces.append(ids[at : at + BLOCK_IDS]), owner.append(k)
    blocks: list[list[bytes]] = [[] for _ in rows]
    for at in range(0, len(pieces), TOGETHER):
        some = pieces[at : at + TOGETHER]
        for k, coded, ids in zip(owner[at : at + TOGETHER], mixcoder.encode(some, size), some, strict=True):
            blocks[k].append(mixcoder.frame(coded, ids, b"" if blocks[k] else _index(rows[k][2], [len(d) for d in rows[k][3]])))
    columns = [[r[0] for r in rows], [r[1] for r in rows], [sum(map(len, r[3])) for r in rows], blocks]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary())), strict=True)], names=["part", "before", "n", "blocks"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the ids of every text (null: empty), each with END after it, in ascending order of doc_id (nulls first, ties
    by text), to the folder `path`, which must not exist. doc_id is a whole number. Texts are shuffled once, by ranges of
    doc_id; a task holds TOGETHER blocks and the text it is at. A failed task is done anew whole, and its part is committed
    by Spark's writer."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number")
    tokenizer = tokenizer or public_path()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = range_of(docs, n).cast("int")
    rows = docs.select(part.alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([END], enc.kind).tobytes()
        full: list[tuple[int, int, list, list]] = []  # rows of (part, ids before, doc_ids, ids)
        at, before, doc_ids, held, size, waiting = None, 0, [], [], 0, 0

        def close() -> None:
            nonlocal before, doc_ids, held, size, waiting
            if held:
                full.append((at, before, doc_ids, held))
                before, waiting = before + size, waiting - (-size // BLOCK_IDS)
                doc_ids, held, size = [], [], 0

        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                b = whole.slice(a, 500)
                texts = enc.encode([t or "" for t in b.column(2).to_pylist()])
                for p, doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
                    ids = np.frombuffer(raw + end, enc.kind)
                    if p != at or size + len(ids) > BLOCK_IDS:
                        close()
                        if waiting >= TOGETHER:
                            yield _coded(full, enc.size)
                            full.clear()
                            waiting = 0
                    if p != at:
                        at, before = p, 0
                    doc_ids.append(doc_id), held.append(ids)
                    size += len(ids)
        close()
        if full:
            yield _coded(full, enc.size)

    rows.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, start, ids) of every document of a file: its ids, and how many the documents before it have. A damaged
    block raises. Only a sum for each part passes a shuffle; blocks are decoded where they are read, TOGETHER at once."""
    tokenizer = tokenizer or public_path()
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n").alias("n"))  # a row a part, as many as the writer had partitions
    parts = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))
    placed = rows.join(F.broadcast(parts), "part").select((F.col("first") + F.col("before")).alias("start"), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = encoder(tokenizer).size
        waiting: list[tuple[int, list[bytes]]] = []

        def decoded() -> Iterator[pa.RecordBatch]:
            frames = [[mixcoder.unframe(f) for f in blocks] for _, blocks in waiting]
            flat = [f for fs in frames for f in fs]
            ids = []
            for at in range(0, len(flat), TOGETHER):
                some = flat[at : at + TOGETHER]
                for (_, crc, _, _), x in zip(some, mixcoder.decode([f[3] for f in some], [f[0] for f in some], size), strict=True):
                    raw = x.astype("<u4")
                    if zlib.crc32(raw.tobytes()) != crc:
                        raise ValueError("a block is damaged")
                    ids.append(raw)
            for (start, _), fs in zip(waiting, frames, strict=True):
                doc_ids, lengths = _indexed(fs[0][2])
                own, ids = np.concatenate(ids[: len(fs)]), ids[len(fs) :]
                ends = np.cumsum(lengths)
                if ends[-1] != len(own):
                    raise ValueError("a row of blocks is cut short")
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(own.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), lists], names=["doc_id", "start", "ids"])
            waiting.clear()

        for whole in batches:
            for k in range(whole.num_rows):
                waiting.append((whole.column(0)[k].as_py(), whole.column(1)[k].as_py()))
                if sum(len(b) for _, b in waiting) >= TOGETHER:
                    yield from decoded()
        if waiting:
            yield from decoded()

    return placed.mapInArrow(run, "doc_id long, start long, ids array<int>")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens() gives; the checksum is over little-endian 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path)
    return digests(read_tokens(spark, path))
