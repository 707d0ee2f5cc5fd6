"""Document fingerprints as a homomorphic multiset hash.

A text is a multiset of paragraphs (lines, and within them sentences). Each is hashed into a wide vector and the vectors
are summed lane by lane modulo a power of two, so order doesn't matter and a paragraph is inserted or deleted by adding or
subtracting its vector. The first lanes are uniform modulo 2^32 and decide equality; the rest hold a sign each, modulo
2^16, so the squared length of a difference estimates by how many paragraphs two multisets differ.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.llm.common import documents
from meshquarry.llm.ranges import range_of

#: Lanes modulo 2^32, and lanes modulo 2^16 that hold signs.
WIDE, SIGNS = 16, 256
#: Paragraphs that are hashed at once, documents that are held at once.
CHUNK, ROWS = 32_768, 128
_CUT = re.compile(rb"\n+|(?<=[.!?]) +")
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def paragraphs(text: bytes) -> list[bytes]:
    return [p for p in _CUT.split(text) if p]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each multiset its uniform lanes (uint32) and its sign lanes (uint16), both wrapped around."""
    wide, signs = np.zeros((len(parts), WIDE), np.uint32), np.zeros((len(parts), SIGNS), np.uint16)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    flat = [x for p in parts for x in p]
    lanes = (np.arange(1, WIDE // 2 + SIGNS // 64 + 1, dtype=np.uint64) * _GAMMA)[None, :]
    for at in range(0, len(flat), CHUNK):
        own = owner[at : at + CHUNK]
        seed = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, flat[at : at + CHUNK])), np.uint64).reshape(-1, 2)
        words = _mix(_mix(seed[:, :1] + lanes) ^ seed[:, 1:])
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        n = np.diff(np.r_[starts, len(own)])[:, None]
        uniform = np.ascontiguousarray(words[:, : WIDE // 2]).view(np.uint32)
        ones = np.unpackbits(np.ascontiguousarray(words[:, WIDE // 2 :]).view(np.uint8), axis=1)
        wide[own[starts]] += np.add.reduceat(uniform, starts, axis=0, dtype=np.uint32)
        signs[own[starts]] += (2 * np.add.reduceat(ones, starts, axis=0, dtype=np.int64) - n).astype(np.uint16)
    return wide, signs


def fingerprint_hex(wide: np.ndarray, signs: np.ndarray) -> list[str]:
    return [a.astype("<u4").tobytes().hex() + b.astype("<u2").tobytes().hex() for a, b in zip(wide, signs, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of sign lanes, in [0, 1]: 1 less the squared length of the difference over the sum of the squared lengths;
    1 for equal rows, about 0 for multisets without a common paragraph."""
    x, y = a.view(np.int16).astype(np.float64), b.view(np.int16).astype(np.float64)
    off = (a - b).view(np.int16).astype(np.float64)
    total = (x * x).sum(1) + (y * y).sum(1)
    return np.clip(1 - (off * off).sum(1) / np.where(total > 0, total, 1), 0, 1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text counts as empty, whose fingerprint is all zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                print_ = fingerprint_hex(*sums([paragraphs(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(print_, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, tail, doc_id, text), dealt out and sorted so that each row's successor by doc_id (after the last: the
    first) is the row below it; rows with tail only serve as the successor of the bucket's last one.

    Buckets are ranges of doc_id from approximate quantiles, one a shuffle partition. Only the ids of the buckets' first
    rows reach the driver. The text is shuffled once; the heads are dealt out twice. Nulls sort first.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    bucket = range_of(docs, n)
    heads = ids.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("bucket").collect()  # one row a bucket
    table = [(before.bucket, None if now.nulls else now.head) for before, now in zip([heads[-1], *heads[:-1]], heads, strict=True)] if heads else []
    table = docs.sparkSession.createDataFrame(table, f"bucket int, head {docs.schema['doc_id'].dataType.simpleString()}")
    tails = docs.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("head"))).select("bucket", F.lit(True).alias("tail"), "doc_id", "text")
    own = docs.select(bucket.cast("int").alias("bucket"), F.lit(False).alias("tail"), "doc_id", "text")
    return own.unionByName(tails).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "tail", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text keeps all but the last floor(n / 2) code points, and goes on with as many of the next document (or
    all it has). Its fingerprint is the text's, less the paragraphs after those that both share, plus the edited text's
    own. Null texts count as empty; null doc_ids come first; rows with the same doc_id follow each other by text. A single
    row follows itself. An empty table gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = list(zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True))
                rows, held = ([held] if held else []) + rows, rows[-1]
                # a tail, or the first row of another bucket, ends what stands above it
                if out := [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]:
                    yield _edited(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _edited(pairs: list[tuple]) -> pa.RecordBatch:
    own, out, into, after, n_chars, shas = [], [], [], [], [], []
    for (_, _, _, text), (_, _, _, following) in pairs:
        half = len(text) // 2
        edited = (text[: len(text) - half] + following[:half]).encode()
        a, b = paragraphs(text.encode()), paragraphs(edited)
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        own.append(a), out.append(a[same:]), into.append(b[same:]), after.append(paragraphs(following.encode()))
        n_chars.append(len(text)), shas.append(hashlib.sha256(edited).hexdigest())
    # the next document is mostly the next row, whose sums are known
    known = [following == pairs[i + 1][0][3] if i + 1 < len(pairs) else False for i, (_, (_, _, _, following)) in enumerate(pairs)]
    wide, signs = sums(own)
    less, plus = sums(out), sums(into)
    late = [i for i, k in enumerate(known) if not k]
    following = np.roll(signs, -1, axis=0)
    following[late] = sums([after[i] for i in late])[1]
    wide2, signs2 = wide - less[0] + plus[0], signs - less[1] + plus[1]
    columns = [[a[2] for a, _ in pairs], n_chars, shas, fingerprint_hex(wide, signs), fingerprint_hex(wide2, signs2), likeness(signs, signs2), likeness(signs, following)]
    return pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(columns)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op8_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir).select("doc_id", "text"))
