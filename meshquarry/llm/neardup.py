"""Near duplicates by similarity: the Jaccard index of two texts' sets of five-word shingles is 0.8 or more.

The nearest are found as `op2` finds them: fingerprints of the five-word shingles (SimHash) that differ in at most three bits, by
the index of `simhash.links`; each of its links is compared exactly. Three bits reach few pairs at the least similarity, so what
fingerprints have not joined is looked for further: candidates are texts that agree on a band of ROWS minima of hashes (MinHash). A pair at the least similarity shares one of
BANDS bands with a chance of 1 - (1 - 0.8^4)^20, over 0.9999. In each bucket all members are compared to the first. Where that
leaves more than one component, the bucket is cut into blocks of bounded size, and a task holds two of them at a time: it counts
what their sets share by products of 0/1 matrices, which is exact, and returns a spanning forest of the links between
components. No pair is a row; a member is sent once for each block that it is compared to. Nothing is linked by sketches alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.llm import simhash
from meshquarry.llm.common import cut, set_aside
from meshquarry.operators.graph import components

WIDTH = 5
#: The least similarity, as a fraction of whole numbers.
PART, WHOLE = 4, 5
BANDS, ROWS = 20, 4
#: About how many members of a bucket, and shingles of theirs, a block holds; columns of a matrix at once.
BLOCK, SHINGLES, COLUMNS = 1024, 1 << 20, 4096
#: Over how many tasks the pairs of one text are dealt.
SALTS = 256
#: Shingles that are hashed anew at once.
CHUNK = 1024
_RNG = np.random.default_rng(5)
_MIX = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_MIX[1] |= np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """The sorted 64-bit hashes of the different shingles; a text of fewer words is one shingle."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - WIDTH + 1)
    out = np.full(n, len(h) if len(h) < WIDTH else WIDTH, np.uint64)
    for k in range(min(WIDTH, len(h))):
        out = (out ^ h[k : k + n]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _minima(s: np.ndarray, mix: np.ndarray) -> np.ndarray:
    least = np.full(mix.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), CHUNK):
        least = np.minimum(least, ((s[at : at + CHUNK] ^ mix[0]) * mix[1]).min(axis=1))
    return least


def bands(s: np.ndarray) -> np.ndarray:
    """A key for each band of the minima."""
    key = np.arange(BANDS, dtype=np.uint64) * _ODD
    for column in _minima(s, _MIX).reshape(BANDS, ROWS).T:
        key = (key ^ column) * _ODD
        key ^= key >> np.uint64(32)
    return key


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * WHOLE >= (len(a) + len(b) - both) * PART


def sketches(rows: DataFrame) -> DataFrame:
    """(doc_id, id, n, fp, bands) of (doc_id, id, text): the number of different shingles, the fingerprint and the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, fps, keys = [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                s = shingles(t)
                sizes.append(len(s)), fps.append(simhash.simhash(t, WIDTH)), keys.append(bands(s).view(np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists], names=["doc_id", "id", "n", "fp", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "id", "text").mapInArrow(run, f"doc_id {kind}, id long, n long, fp long, bands array<long>")


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of `a` has in common with each of `b`."""
    flat = [np.concatenate(s) for s in (a, b)]
    both = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    counts, cells = np.zeros((len(a), len(b)), np.int32), []
    for sets, h in zip((a, b), flat, strict=True):
        column = np.searchsorted(both, h)
        hit = np.isin(h, both, kind="sort")
        column, row = column[hit], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(column, kind="stable")
        cells.append((row[order], column[order]))
    for at in range(0, len(both), COLUMNS):
        dense = []
        for n, (row, column) in zip(counts.shape, cells, strict=True):
            lo, hi = np.searchsorted(column, (at, at + COLUMNS))
            m = np.zeros((n, min(COLUMNS, len(both) - at)), np.float32)
            m[row[lo:hi], column[lo:hi] - at] = 1
            dense.append(m)
        counts += (dense[0] @ dense[1].T).astype(np.int32)
    return counts


def forest(a: list[tuple], b: list[tuple]) -> list[tuple[int, int]]:
    """A spanning forest of the links between members (id, root, set) of `a` and of `b`, whose roots are linked already."""
    if not a or not b or len({m[1] for m in a + b}) < 2:
        return []
    na, nb = (np.array([len(m[2]) for m in side]) for side in (a, b))
    both = shared([m[2] for m in a], [m[2] for m in b]).astype(np.int64)
    near = both * WHOLE >= (na[:, None] + nb[None, :] - both) * PART
    _, label = np.unique([m[1] for m in a + b], return_inverse=True)
    out = []
    for i in range(len(a)):
        for j in np.flatnonzero(near[i] & (label[len(a) :] != label[i])).tolist():
            if (was := label[len(a) + j]) != label[i]:
                label[label == was] = label[i]
                out.append((a[i][0], b[j][0]))
    return out


def across(inside: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between components that meet in a bucket, of members (key, id, n, root); see the module's text.

    The members of a bucket's largest component have blocks of their own, which are never compared to each other. A bucket of
    two needs none of this: its members have been compared.
    """
    at = inside.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    at = at.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("c", "s", "root")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    at = at.where((F.col("roots") > 1) & (F.col("c") > 2))
    parts = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / SHINGLES))
    whole = (F.col("c") <= BLOCK) & (F.col("s") <= SHINGLES)
    tops = F.when(whole, 0).otherwise(parts(F.col("top.c"), F.col("top.s")))
    rest = F.when(whole, 1).otherwise(parts(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")))
    at = at.select("key", F.col("top.root").alias("top"), tops.cast("long").alias("tops"), rest.cast("long").alias("rest"))
    in_top = (F.col("root") == F.col("top")) & (F.col("tops") > 0)
    block = F.when(in_top, F.pmod(F.xxhash64("id"), F.greatest(F.col("tops"), F.lit(1)))).otherwise(F.col("tops") + F.pmod(F.xxhash64("id"), F.col("rest")))
    dealt = inside.join(at, "key").withColumn("block", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(in_top, F.col("tops")).otherwise(F.lit(0)), F.col("tops") + F.col("rest") - 1)))
    dealt = cut(dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "root"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["id", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sides = None, ([], [])

        def links() -> pa.RecordBatch:
            found = forest(sides[0], sides[last[1] < last[2]])
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for key, p, q, block, id_, root, hashes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, p, q) != last:
                    if last is not None:
                        yield links()
                    last, sides = (key, p, q), ([], [])
                sides[block != p].append((id_, root, np.frombuffer(hashes, np.uint64)))
        if last is not None:
            yield links()

    wanted = rows.select("id", "text").join(dealt.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    sets = cut(wanted.mapInArrow(hashed, "id long, hashes binary"))
    pairs = dealt.join(sets, "id").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    pairs = pairs.select("key", "p", "q", "block", "id", "root", "hashes").mapInArrow(run, "a long, b long")
    return cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar. The texts paired with one b are dealt over SALTS tasks, each of which gets
    b's text once, ahead of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            found = []
            for b, a, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = shingles(text.as_buffer().to_pybytes())
                if a is None:
                    known = own
                elif similar(own, known):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    ids = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    texts = cut(rows.select("id", F.col("text").cast("binary").alias("text")).join(ids, "id", "left_semi").dropDuplicates(["id"]))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("salt"))
    ahead = dealt.select("b", "salt").distinct().join(texts.withColumnRenamed("id", "b"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "text")
    both = ahead.unionByName(dealt.join(texts.withColumnRenamed("id", "a"), "a").select("b", "salt", "a", "text"))
    both = both.repartition("b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    return cut(both.select("b", "a", "text").mapInArrow(run, "a long, b long"))


def by_fingerprints(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) of similar texts (id, fp) that share a fingerprint, with the first of them, or whose fingerprints the index of
    simhash.links joins, between the first of each."""
    first = cut(nodes.groupBy("fp").agg(F.min("id").alias("first")))
    equal = nodes.join(first, "fp").where("id > first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    at = lambda p: first.select(F.col("fp").alias(p), F.col("first").alias(f"__{p}"))
    near = simhash.links(first.select("fp")).join(at("a"), "a").join(at("b"), "b")
    near = near.select(F.greatest("__a", "__b").alias("a"), F.least("__a", "__b").alias("b"))
    return verified(cut(equal.unionByName(near).distinct()), rows)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): component_id the smallest doc_id that links of similar texts reach. See classes()."""
    return classes(docs).select("doc_id", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one stays for each component: that of the smallest doc_id (null
    last), of equal ones that of the smallest hash of its text, and one of rows that repeat both."""
    docs, named = set_aside(docs, "__row", "__text", "__at")
    best = classes(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("best"))
    best = best.select(F.xxhash64("best.doc_id", "best.id").alias("__row"), F.col("best.id").alias("__text"))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.withColumns({"__row": F.xxhash64("doc_id", text), "__text": text}).join(best, ["__row", "__text"], "left_semi")
    first = F.row_number().over(W.partitionBy("__row", "__text").orderBy(F.col("doc_id").isNull()))  # dealt out as the join is
    return named(rows.withColumn("__at", first).where("__at = 1").select(*docs.columns))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, id, root, component_id): a row for each of `docs`, id the hash of its text, root one for each component,
    component_id the smallest doc_id that links of similar texts reach.

    Null texts count as empty; texts without words are similar to each other. Equal texts, by their 64-bit hash, are one node.
    A null doc_id keeps its row; it is the component_id only where a component has no other. Other columns of `docs` are
    ignored. An empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.xxhash64("text")).select("doc_id", "id", "text")
    held = cut(sketches(rows))
    nodes = cut(held.groupBy("id").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    nearest = by_fingerprints(nodes.select("id", "fp"), rows)
    known = cut(components(nearest))
    dealt = nodes.select("id", "n", F.explode("bands").alias("key"))
    leads = dealt.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.max("id").alias("last")).where("lead.id < last").select("key", "lead")
    members = cut(dealt.join(leads, "key"))
    # Sets whose sizes are further apart can't be similar.
    sized = lambda x, y: F.least(x, y) * WHOLE >= F.greatest(x, y) * PART
    stars = members.where((F.col("id") > F.col("lead.id")) & sized(F.col("n"), F.col("lead.n"))).select(F.col("id").alias("a"), F.col("lead.id").alias("b")).distinct()
    for end in "ab":
        stars = stars.join(known.select(F.col("node").alias(end), F.col("root").alias(f"__{end}")), end, "left").withColumn(f"__{end}", F.coalesce(f"__{end}", end))
    stars = cut(stars.where("__a <> __b").select("a", "b"))
    links = verified(stars, rows).unionByName(nearest)
    roots = components(links).select(F.col("node").alias("id"), "root")
    inside = cut(members.select("key", "id", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    links = links.unionByName(across(inside, rows))
    roots = components(links).select(F.col("node").alias("id"), "root")
    by = cut(nodes.select("id", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    whole = by.groupBy("root").agg(F.min("least").alias("component_id"))
    return held.select("doc_id", "id").join(by.join(whole, "root").select("id", "root", "component_id"), "id").select("doc_id", "id", "root", "component_id")
