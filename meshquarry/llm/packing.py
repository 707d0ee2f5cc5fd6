"""Lexical retrieval packing: windows of text that belongs together.

Documents are tokenized once, and the document frequency of each id, the number of documents and their mean length are taken
over all of them. Of its ids each document draws two by a hash weighted by rarity, so that texts with rare ids in common
often draw the same; in the order of these draws documents are dealt out by ranges and worked off in index shards of bounded
size. A shard is an inverted index with the corpus's BM25 weights: a seed document (the next unused one) asks it for its
neighbours by all its ids, and the unused ones fill the rest of the seed's window in order of score, best
first, the last one cut where the window is full. What is cut off, and what fills less than a window when a shard ends, goes
on as the next seed, so only a partition's last sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.llm.common import documents, stored
from meshquarry.llm.tokens import encoder, public_path

WINDOW, END = 2048, 1
#: A shard holds documents of about so many ids, and so many documents at most; terms are scored in blocks: all three bound a
#: task's memory.
SHARD_IDS, SHARD_DOCS, TERMS = 1_000_000, 3_000, 4_096
#: BM25's parameters.
K1, B = 1.2, 0.75
#: How much rarity weighs in a draw.
POWER = 3.0


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n, ids): ids with the end id, as bytes of the tokenizer's smallest kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([END], enc.kind).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                raw = [x + end for x in enc.encode([t or "" for t in b.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // enc.kind.itemsize for x in raw], pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, ids binary")


@dataclass
class Corpus:
    """Over all documents: how many, their mean length, and the idf of each id. As large as the vocabulary."""

    n: int
    mean: float
    idf: np.ndarray

    def draws(self) -> np.ndarray:
        """Two rows of a number for each id; a document draws the id with the smallest (exponential variables whose rate is the
        weight: the least of a set falls to an id with a chance in proportion to it)."""
        u = np.random.default_rng(17).random((2, len(self.idf)))
        return -np.log1p(-u) / np.maximum(self.idf, 1e-9) ** POWER


def corpus(rows: DataFrame, path: str) -> Corpus:
    """From tokenized documents; a count for each id of the vocabulary reaches the driver, each task adding up its own first."""
    enc = encoder(path)
    size, kind = enc.size, enc.kind.str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                held[np.unique(np.frombuffer(raw, kind))] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["id", "held"])

    held = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(run, "id long, held long").groupBy("id").agg(F.sum("held").alias("held")).collect():
        held[r.id] = r.held
    n, total = rows.agg(F.count("*"), F.sum("n")).first()
    return Corpus(n, (total or 0) / max(n, 1), np.log1p((n - held + 0.5) / (held + 0.5)))


def drawn(rows: DataFrame, stats: Corpus, path: str) -> DataFrame:
    """Tokenized documents with their draws (first, second): ids in an order of their own, so that ranges mix them."""
    kind, sent = encoder(path).kind.str, rows.sparkSession.sparkContext.broadcast(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = sent.value.draws()
        for b in batches:
            ids = [np.frombuffer(raw, kind) for raw in b.column(2).to_pylist()]
            both = [[int(x[d[x].argmin()]) * 0x9E3779B1 % (1 << 32) for x in ids] for d in draws]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in both)], names=["doc_id", "n", "ids", "first", "second"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, ids binary, first long, second long")


class Shard:
    """A BM25 inverted index over documents, each an array of ids, under the corpus's statistics."""

    def __init__(self, docs: list[np.ndarray], stats: Corpus):
        n, lengths = len(docs), np.array([len(d) for d in docs], np.float64)
        owner = np.repeat(np.arange(n, dtype=np.int64), [len(d) for d in docs])
        key, tf = np.unique(np.concatenate(docs).astype(np.int64) * n + owner, return_counts=True)
        term, doc = key // n, key % n
        weight = stats.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / stats.mean))
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])  # postings of a term stand together
        held = np.diff(np.r_[first, len(term)])
        shared = np.repeat(held > 1, held)  # ids of one document only find nobody
        rank, doc, weight = np.repeat(np.cumsum(held > 1) - 1, held)[shared], doc[shared], weight[shared]
        self.score = np.zeros((n, n), np.float32)  # of each document for each query document, term block by term block
        for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, TERMS):
            lo, hi = np.searchsorted(rank, (at, at + TERMS))
            query, posting = (np.zeros((n, min(TERMS, int(rank[hi - 1]) - at + 1)), np.float32) for _ in range(2))
            query[doc[lo:hi], rank[lo:hi] - at] = 1
            posting[doc[lo:hi], rank[lo:hi] - at] = weight[lo:hi]
            self.score += query @ posting.T

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share ids with the seed, by score, then place."""
        score = np.where(unused, self.score[seed], 0)
        some = np.flatnonzero(score)
        return some[np.argsort(-score[some], kind="stable")]


class Packer:
    """Gives out pieces (doc, start, length, crc, doc tokens, sequence, offset), documents named by what add() was given."""

    def __init__(self, first_sequence: int):
        self.sequence, self.offset = first_sequence, 0

    def piece(self, doc: tuple, start: int, ids: np.ndarray) -> tuple:
        out = (doc[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(doc[1]), self.sequence, self.offset)
        self.offset += len(ids)
        if self.offset == WINDOW:
            self.sequence, self.offset = self.sequence + 1, 0
        return out

    def place(self, doc: tuple) -> Iterator[tuple]:
        """A whole document: what fits into the open sequence, then on into the next ones."""
        at = 0
        while at < len(doc[1]):
            ids = doc[1][at : at + WINDOW - self.offset]
            yield self.piece(doc, at, ids)
            at += len(ids)

    def shard(self, docs: list[tuple], stats: Corpus) -> Iterator[tuple]:
        """Documents (name, ids) into sequences: a seed, then neighbours until the window is full. A document that is cut
        is the next window's seed: its neighbours go on from there."""
        index, unused, at = Shard([d[1] for d in docs], stats), np.ones(len(docs), bool), 0
        seed = None
        while True:
            if seed is None:
                while at < len(docs) and not unused[at]:
                    at += 1
                if at == len(docs):
                    return
                seed = at
                unused[seed] = False
                yield from self.place(docs[seed])
            window, seed_next = self.sequence, None
            if self.offset:
                for k in index.neighbours(seed, unused).tolist():
                    unused[k] = False
                    yield from self.place(docs[k])
                    if self.sequence != window:
                        seed_next = k if self.offset else None
                        break
            seed = seed_next


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece. The pieces of a document
    cover its ids, the end id included, without overlap; a sequence is filled from offset 0 without a gap.

    A null or empty text is its end id alone. Repeated rows are packed each; ties go by doc_id, then ids. Other columns are
    ignored; an empty table gives an empty one. Tokens are kept in the shared folder and shuffled once, by ranges of the draws and doc_id, so a group of copies of any size is spread over tasks, each of which holds one
    shard at a time.
    """
    path = path or public_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(tokenized(docs, path), "tokens")
    stats = corpus(rows, path)
    sent = docs.sparkSession.sparkContext.broadcast(stats)
    dealt = drawn(rows, stats, path).repartitionByRange(n, "first", "second", F.xxhash64("doc_id")).sortWithinPartitions("first", "second", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 40)

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], named), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", *(x.split()[0] for x in _PIECES.split(", "))])

        held, size, named = [], 0, pa.int64()
        for b in batches:
            named = b.column(0).type
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((doc_id, np.frombuffer(raw, enc.kind)))
                size += len(held[-1][1])
                if size >= SHARD_IDS or len(held) == SHARD_DOCS:
                    yield table(list(packer.shard(held, sent.value)))
                    held, size = [], 0
        if held:
            yield table(list(packer.shard(held, sent.value)))

    return dealt.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, {_PIECES}")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
