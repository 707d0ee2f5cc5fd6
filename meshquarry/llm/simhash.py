"""SimHash near duplicates through a Gray-order hierarchical index.

64-bit fingerprints that differ in at most three bits agree on at least two of five blocks of bits, so each distinct
fingerprint is dealt out once for each of the ten pairs of blocks and meets all its partners in one of those buckets. A
bucket is sorted by Gray rank and indexed as a hierarchy: runs of neighbours form leaves, the bits on which a node's
members agree are kept in the node and masked out below it, and a search adds up the differences from the root down and
leaves a whole group when they exceed three, or when all of the group is in the query's component already. A bucket gives
a spanning forest of its links, never its pairs; components join the forests of all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.llm.common import cut, documents, union_all
from meshquarry.operators.graph import components

RADIUS, BITS, BLOCKS = 3, 64, 5
#: Fingerprints in a bucket beyond which it is dealt out anew by the pairs of its other bits.
SPLIT_OVER = 200_000
LEAF, FAN = 16, 8
#: Shingles that are voted on at once: bounds memory for a text of any length.
CHUNK = 65_536


def simhash(text: bytes, width: int = 3) -> int:
    """The fingerprint of one text, as an unsigned integer; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(0, len(words) - width)
    votes = np.zeros(BITS, np.int64)
    spans = zip(starts[: k + 1].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    digest, hashes = xxhash.xxh64_digest, []
    for a, b in spans:
        hashes.append(digest(whole[a:b], 42))
        if len(hashes) == CHUNK:
            votes += _votes(hashes)
            hashes = []
    if hashes:
        votes += _votes(hashes)
    return int.from_bytes(np.packbits(votes * 2 > k + 1).tobytes(), "big")


def _votes(hashes: list[bytes]) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as the long of the same bits. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of the bit pattern in Gray order: the exclusive or of all its right shifts."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def gray_ranks(fps: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        fps = fps ^ (fps >> np.uint64(shift))
    return fps


class GrayIndex:
    """Over unsigned fingerprints in Gray order. levels[0] are the leaves, each LEAF neighbours; the last is the top."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        both, some = np.bitwise_and.reduceat(fps, s := np.arange(0, len(fps), LEAF)), np.bitwise_or.reduceat(fps, s)
        self.levels = []
        while True:
            self.levels.append((both, ~(both ^ some)))
            if len(both) <= FAN:
                break
            s = np.arange(0, len(both), FAN)
            both, some = np.bitwise_and.reduceat(both, s), np.bitwise_or.reduceat(some, s)

    def search(self, queries: np.ndarray, labels: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) places of all links within RADIUS. Where labels (of the members) and own (of the queries) are
        given, groups and members that share the query's label are left out."""
        uniform = self._uniform(labels) if labels is not None else None
        top = len(self.levels) - 1
        q = np.repeat(np.arange(len(queries)), len(self.levels[top][0]))
        node = np.tile(np.arange(len(self.levels[top][0])), len(queries))
        seen, far = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint8)
        for k in range(top, -1, -1):
            pattern, mask = self.levels[k]
            # Only the bits that no node above has compared.
            far = far + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node] & ~seen)
            keep = far <= RADIUS
            if uniform is not None:
                keep &= uniform[k][node] != own[q]
            q, node, far = q[keep], node[keep], far[keep]
            seen = mask[node]
            below, fan = (len(self.levels[k - 1][0]), FAN) if k else (len(self.fps), LEAF)
            node = (node[:, None] * fan + np.arange(fan)).ravel()
            q, far, seen = np.repeat(q, fan), np.repeat(far, fan), np.repeat(seen, fan)
            inside = node < below
            q, node, far, seen = q[inside], node[inside], far[inside], seen[inside]
        ok = far + np.bitwise_count((queries[q] ^ self.fps[node]) & ~seen) <= RADIUS
        if labels is not None:
            ok &= labels[node] != own[q]
        return q[ok], node[ok]

    def _uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each node the label that all below it share, or -1."""
        s = np.arange(0, len(labels), LEAF)
        low, high, out = np.minimum.reduceat(labels, s), np.maximum.reduceat(labels, s), []
        for k in range(len(self.levels)):
            out.append(np.where(low == high, low, -1))
            if k + 1 < len(self.levels):
                s = np.arange(0, len(low), FAN)
                low, high = np.minimum.reduceat(low, s), np.maximum.reduceat(high, s)
        return out


def linked(fps: np.ndarray, block: int = 64) -> np.ndarray:
    """For distinct fingerprints in Gray order, the place of the first member of each one's component.

    Queries go in blocks. Once a block has joined what it links to, later searches skip the groups that lie in their own
    component, so a dense group of near copies costs about its size and not its square.
    """
    label = np.arange(len(fps))
    if len(fps) <= 2 * LEAF:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS
        for i in range(len(fps)):
            js = label[near[i]]
            if (js != js[0]).any():
                label[np.isin(label, js)] = js.min()
        return label
    index, at = GrayIndex(fps), 0
    while at < len(fps):
        size = block if at else 1
        own = label[at : at + size]
        q, hit = index.search(fps[at : at + size], label, own)
        links = np.unique(np.stack([own[q], label[hit]], 1), axis=0)
        if len(links):
            label = _merged(label, links)
        at += size
    return label


def _merged(label: np.ndarray, links: np.ndarray) -> np.ndarray:
    to = np.arange(len(label))
    while True:
        low = to.copy()
        np.minimum.at(low, links[:, 0], to[links[:, 1]])
        np.minimum.at(low, links[:, 1], to[links[:, 0]])
        low = low[low]
        if (low == to).all():
            return to[label]
        to = low


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, key, fp) sorted by path, key and Gray rank to the links (a, b) of each bucket's spanning forest."""

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) else np.zeros(0, int)
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(keys)]))
        a, b = [], []
        two = starts[ends - starts == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= RADIUS]
        a.append(fps[two]), b.append(fps[two + 1])
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            root = linked(fps[s:e])
            own = np.flatnonzero(root != np.arange(e - s))
            a.append(fps[s:e][own]), b.append(fps[s:e][root[own]])
        x, y = (np.concatenate(v).view(np.int64) for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    held_keys, held = [], []  # of the last bucket, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], 1)
        fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        last = np.flatnonzero((keys != keys[-1]).any(axis=1))
        last = int(last[-1]) + 1 if len(last) else 0
        if last or held and (held_keys[-1][-1] != keys[-1]).any():
            yield links(np.concatenate([*held_keys, keys[:last]]), np.concatenate([*held, fps[:last]]))
            held_keys, held = [], []
        held_keys.append(keys[last:]), held.append(fps[last:])
    if held:
        yield links(np.concatenate(held_keys), np.concatenate(held))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _pairs(bits: list[int], blocks: int = BLOCKS) -> list[int]:
    """Masks of which one is equal, over `bits`, in any two words that differ in RADIUS bits at most."""
    parts = [bits[i * len(bits) // blocks : (i + 1) * len(bits) // blocks] for i in range(blocks)]
    return [sum(1 << i for p in some for i in p) for some in combinations(parts, blocks - RADIUS)]


def links(distinct: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """Links (a, b) between the distinct long `fp` that connect all that lie within RADIUS of each other."""
    masks = _pairs(list(range(BITS)))
    deal = lambda mask: F.col("fp").bitwiseAND(F.lit(_signed(mask)))
    rows = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("path"), deal(m).alias("key")) for i, m in enumerate(masks)))).alias("x")).select("x.path", "x.key", "fp")
    parts = []
    while masks:
        rows = cut(rows)
        hot = cut(rows.groupBy("path", "key").count().where(F.col("count") > split_over).select("path", "key"))
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(hot, ["path", "key"], "left_anti"))
        # The bits that the bucket leaves open are halved into blocks again: RADIUS + 1 blocks, one of which is equal.
        finer = [(i, _signed(mask | m), mask | m) for i, mask in enumerate(masks) if (free := [b for b in range(BITS) if not mask >> b & 1]) for m in _pairs(free, RADIUS + 1)]
        table = rows.sparkSession.createDataFrame([(i, j, s) for j, (i, s, _) in enumerate(finer)], "path int, finer int, mask long")
        rows = rows.join(hot, ["path", "key"], "left_semi").join(table, "path").select(F.col("finer").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        masks = [m for *_, m in finer]
    dealt = union_all(parts)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "path", "key").sortWithinPartitions("path", "key", gray_rank(F.col("fp"))).mapInArrow(_forest, "a long, b long")


def near_duplicates(docs: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprint in 16 hexadecimal digits, component_id the smallest doc_id that
    links of at most three differing bits reach.

    Null and empty texts have fingerprint zero and link like any other. Equal texts and repeated rows share a
    fingerprint and thus a component. A null doc_id keeps its row; it is the component_id only where a component has no
    other. Other columns of `docs` are ignored. An empty table gives an empty one. Groups of copies are joined by
    fingerprint, with minima combined before the shuffle; adaptive execution splits the join back to the documents.
    """
    fps = cut(fingerprints(docs))
    least = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(least.select("fp"), split_over)).select(F.col("node").alias("fp"), "root")
    by = cut(least.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    whole = by.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = by.join(whole, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
