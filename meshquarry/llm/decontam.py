"""Benchmark decontamination: passages of benchmark items in documents, up to an edit distance.

Texts are words in lower case. An item of n words leaks into a document if some stretch of its words lies within
floor(n (1 - SIMILARITY)) insertions, deletions and substitutions of words. Items are cut into segments of about SEGMENT
words: of the edits of a leak no more than its share can fall to every segment, so one lies within that share of its own
words. Windows of a segment's size, at every word, are embedded by the random walk of Chakraborty, Goldenberg and Koucky:
step by step it writes the word it stands on and goes on to the next with a coin that depends on the step and the word, so
that after an edit two walks soon meet again and words at few steps differ. Sampled steps of the embedding are the key of a
hash table (bit sampling); REPEATS independent walks and samples reach the target recall, whatever an item's length.
Candidates are verified by the exact edit distance of the whole item. Items too short for an edit are looked up as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meshquarry.llm.common import documents, set_aside, stored, union_all

SIMILARITY = 0.8
#: Words of a segment, about; items of fewer than SHORT words allow no edit.
SEGMENT, SHORT = 40, 5
#: Sampled steps of a key and repetitions. Measured in tests, up to 600 words: recall over 0.95 at the largest distance, over
#: 0.99 at half.
SAMPLED, REPEATS = 2, 16
#: Pairs of neighbouring words are looked up in a table of 2^PAIR_BITS places; a shared place only lets more windows pass.
PAIR_BITS = 20
#: Windows that are looked at together.
BLOCK = 16_384
#: An index holds items of about so many words; so many indexes go through the documents together, which bounds a task's memory.
BLOCK_WORDS, TOGETHER = 500_000, 8
#: Words of documents that are held at once.
CHUNK_WORDS = 1_000_000
_WORDS = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def most_edits(n: int) -> int:
    return int(n * (1 - SIMILARITY) + 1e-9)


@dataclass
class Index:
    """Of one block of items. Word 0 stands for all that no item has."""

    ids: list
    vocabulary: dict[str, int]
    items: list[np.ndarray]
    owner: np.ndarray  # by segment: its item, the word at which it begins, its length, the most edits
    offset: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    steps: list[np.ndarray]  # by repetition: the sampled steps of each length, in rows by length
    keys: list[np.ndarray]  # by repetition, sorted
    segments: list[np.ndarray]
    lengths: list[int]
    pairs: np.ndarray  # at the hash of each pair of neighbouring words, a bit for each length (modulo 64) of its segments
    needs: dict[int, tuple[int, int]]  # by length: how many pairs a window must hold, and how many different ones
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted keys of short items, and the items

    def numbers(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.int32, len(ws))


def _coin(rep: int, step: int, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (word.astype(np.uint64) + np.uint64(rep * 100_003 + step + 1)) * _ODD
        x = (x ^ (x >> np.uint64(32))) * _ODD
    return (x >> np.uint64(63)).astype(np.int64)


def walk_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rep: int, steps: np.ndarray) -> np.ndarray:
    """A key for each window data[start : start + length]: the words that its walk writes at the window's row of steps."""
    last = steps.max(axis=1)
    order = np.argsort(last, kind="stable")  # windows leave when their last step is taken
    at, lengths, steps, last = starts[order], lengths[order], steps[order], last[order]
    end, key = at + lengths, lengths.astype(np.uint64) * np.uint64(7919) + np.uint64(rep)
    columns = [np.ascontiguousarray(c) for c in steps.T]
    for step in range(int(last[-1]) + 1 if len(last) else 0):
        go = int(np.searchsorted(last, step))
        now = at[go:]
        word = np.where(now < end[go:], data[np.minimum(now, len(data) - 1)], -1)
        taken = np.flatnonzero(np.logical_or.reduce([column[go:] == step for column in columns]))
        if len(taken):
            with np.errstate(over="ignore"):
                new = (key[go + taken] ^ (word[taken] + 2).astype(np.uint64)) * _ODD
            key[go + taken] = new ^ (new >> np.uint64(29))
        now += _coin(rep, step, word)
    out = np.empty_like(key)
    out[order] = key
    return out


def _exact_keys(data: np.ndarray, n: int) -> np.ndarray:
    """A key for each window of n words."""
    key = np.zeros(max(0, len(data) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            key = (key ^ data[k : k + len(key)].astype(np.uint64)) * _ODD
            key ^= key >> np.uint64(31)
    return key


def build(rows: list[tuple[object, list[str]]]) -> Index:
    vocabulary: dict[str, int] = {}
    items = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int64) for _, ws in rows]
    short, cuts = {}, []
    for o, x in enumerate(items):
        if len(x) < SHORT:
            short.setdefault(len(x), []).append(o)
        else:
            at = np.linspace(0, len(x), max(1, round(len(x) / SEGMENT)) + 1).astype(int).tolist()
            cuts += [(o, i, j - i) for i, j in zip(at[:-1], at[1:], strict=True)]
    exact = {}
    for n, own in short.items():
        if n:
            key = np.concatenate([_exact_keys(items[o], n) for o in own])
            order = np.argsort(key, kind="stable")
            exact[n] = key[order], np.array(own)[order]
    owner, offset, size = np.array(cuts, np.int64).reshape(-1, 3).T
    parts = [items[o][i : i + n] for o, i, n in cuts]
    lengths = sorted(set(size.tolist()))
    steps, keys, segments = [], [], []
    flat = np.concatenate([*parts, np.zeros(1, np.int64)])
    for rep in range(REPEATS):
        rng = np.random.default_rng(rep)
        table = np.zeros((max(lengths, default=0) + 1, SAMPLED), np.int64)
        for n in lengths:
            table[n] = rng.choice(max(SAMPLED, int(1.8 * n)), SAMPLED, replace=False)  # a walk over n words takes about 2 n steps
        own = walk_keys(flat, np.cumsum(size) - size, size, rep, table[size])
        order = np.argsort(own, kind="stable")
        steps.append(table), keys.append(own[order]), segments.append(order)
    pairs = np.zeros(1 << PAIR_BITS, np.uint64)
    needs: dict[int, tuple[int, int]] = {}
    for x in parts:
        n, d, pair = len(x), most_edits(len(x)), _pair(x)
        pairs[pair] |= np.uint64(1 << n % 64)
        own = int(_fresh(pair).sum()) - 3 * d, len(np.unique(pair)) - 2 * d
        needs[n] = tuple(map(min, needs.get(n, own), own))
    edits = np.array([most_edits(n) for n in size.tolist()], np.int64)
    return Index([i for i, _ in rows], vocabulary, items, owner, offset, size, edits, steps, keys, segments, lengths, pairs, needs, exact)


def _fresh(pair: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], pair[1:] != pair[:-1]))


def _pair(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (data[:-1].astype(np.uint64) << np.uint64(32) | data[1:].astype(np.uint64)) * _ODD
    return (x >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def distance(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of texts the least edit distance of the item to any stretch of it, and where the first such one ends."""
    t = np.arange(texts.shape[1] + 1)
    row = np.zeros((len(texts), len(t)), np.int64)
    for k, word in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[:, 0] = k
        new[:, 1:] = np.minimum(row[:, :-1] + (texts != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - t, axis=1) + t
    return row.min(axis=1), row.argmin(axis=1)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i and each k from lo[i] to hi[i]: i and k."""
    n = hi - lo
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]


def search(index: Index, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(text, item, distance, word): for each text, given as word numbers, and item within reach, the least distance found
    and about where."""
    if not index.items or not texts:
        return []
    pad = 2 * max(index.lengths, default=SHORT) + 2  # no window reaches into another text
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + pad) - sizes
    data = np.zeros(int(begins[-1] + sizes[-1]) + pad, np.int64)
    for b, t in zip(begins.tolist(), texts, strict=True):
        data[b : b + len(t)] = t
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for n, (keys, owners) in index.short.items():
        at, k = _spread(*(np.searchsorted(keys, _exact_keys(data, n), side=s) for s in ("left", "right")))
        for p, o in zip(at.tolist(), owners[k].tolist(), strict=True):
            if (data[p : p + n] == index.items[o]).all():
                text = int(np.searchsorted(begins, p, side="right")) - 1
                best.setdefault((text, o), (0, p - int(begins[text])))
    starts, lengths = _windows(index, data) if index.lengths else (np.zeros(0, np.int64),) * 2
    hits = []
    for rep in range(REPEATS) if len(starts) else ():
        key = walk_keys(data, starts, lengths, rep, index.steps[rep][lengths])
        w, k = _spread(*(np.searchsorted(index.keys[rep], key, side=s) for s in ("left", "right")))
        segment = index.segments[rep][k]
        w, segment = w[(same := index.size[segment] == lengths[w])], segment[same]
        text = np.searchsorted(begins, starts[w] + lengths[w], side="right") - 1
        hits.append(np.stack([segment, text, starts[w] // (index.edits[segment] + 1)]))

    def near(pattern: np.ndarray, d: int, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of those places whose words hold the pattern within d edits: which, the edits, and where they end."""
        wide, out = np.arange(-d, len(pattern) + 3 * d + 2), []
        batch = max(1, 3_000_000 // len(wide))
        for at in range(0, len(first), batch):
            t, window = text[at : at + batch], first[at : at + batch, None] + wide
            inside = (window >= begins[t][:, None]) & (window < (begins + sizes)[t][:, None])
            dist, end = distance(pattern, np.where(inside, data[np.clip(window, 0, len(data) - 1)], 0))
            ok = np.flatnonzero(dist <= d)
            out.append((at + ok, dist[ok], end[ok] + first[at + ok] - d))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def by_first(rows: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        found = np.unique(np.concatenate(rows, axis=1), axis=1) if rows else np.zeros((3, 0), np.int64)
        ids = np.unique(found[0])
        return zip(ids.tolist(), np.split(found[1:], np.searchsorted(found[0], ids[1:]), axis=1), strict=True) if len(ids) else iter(())

    whole = []  # items of several segments, where one of them was found
    for g, (text, at) in by_first(hits):
        o, d = int(index.owner[g]), int(index.edits[g])
        item, i = index.items[o], int(index.offset[g])
        ok, dist, end = near(item[i : i + index.size[g]], d, text, at * (d + 1))
        if index.size[g] < len(item):
            reach = most_edits(len(item)) + 1
            whole.append(np.stack([np.full(len(ok), o), text[ok], (end - index.size[g] - i) // reach]))
        else:
            _keep(best, o, len(item), text[ok], dist, end - begins[text[ok]])
    for o, (text, at) in by_first(whole):
        item, d = index.items[o], most_edits(len(index.items[o]))
        ok, dist, end = near(item, d, text, at * (d + 1))
        _keep(best, o, len(item), text[ok], dist, end - begins[text[ok]])
    return [(t, o, *hit) for (t, o), hit in best.items()]


def _keep(best: dict, item: int, n: int, text: np.ndarray, dist: np.ndarray, end: np.ndarray) -> None:
    for t, d, e in zip(text.tolist(), dist.tolist(), end.tolist(), strict=True):
        hit = (d, max(0, e - n))
        best[t, item] = min(best.get((t, item), hit), hit)


def _windows(index: Index, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the windows that may hold an item: those with enough pairs of neighbouring words of any item.

    An edit breaks two pairs at most, so of an item's k different pairs k - 2 d stand within n + d words. A sum over the
    text goes first: there a pair that repeats the one before it doesn't count, and an edit breaks three at most.
    """
    pair = _pair(data)
    known = index.pairs[pair]
    shared = np.concatenate(([0], np.cumsum((known > 0) & _fresh(pair), dtype=np.int32)))
    reach = index.lengths[-1] + most_edits(index.lengths[-1])
    some = np.flatnonzero(shared[reach:] - shared[:-reach] >= min(k for k, _ in index.needs.values()))
    parts = []
    for n in index.lengths:
        wide, (most, different) = n + most_edits(n) - 1, index.needs[n]
        starts = some[shared[some + wide] - shared[some] >= most]
        for at in range(0, max(len(starts), 1), BLOCK):
            block = starts[at : at + BLOCK]
            rows = block[:, None] + np.arange(wide)
            rows = np.sort(np.where(known[rows] & np.uint64(1 << n % 64), pair[rows], -1), axis=1)
            kinds = (rows[:, :1] >= 0).sum(1) + ((rows[:, 1:] != rows[:, :-1]) & (rows[:, 1:] >= 0)).sum(1)
            parts.append((block := block[kinds >= different], np.full(len(block), n)))
    return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over the items, each of at most about BLOCK_WORDS words; rows reach the driver one partition at a time."""
    rows, size = [], 0
    for r in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        ws = words(r.text)
        if not ws:
            continue
        if rows and size + len(ws) > BLOCK_WORDS:
            yield build(rows)
            rows, size = [], 0
        rows.append((r.item_id, ws))
        size += len(ws)
    yield build(rows)


def _scan(docs: DataFrame, indexes: list[Index], item: T.DataType) -> DataFrame:
    """Leaks of the items of some indexes in one pass over the documents (doc_id, text, and any key columns after them)."""
    sent = docs.sparkSession.sparkContext.broadcast(indexes)
    keys = docs.schema.fields[2:]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", item), *(T.StructField(c, t) for c, t in (("distance", T.IntegerType()), ("similarity", T.DoubleType()), ("word", T.LongType()))), *keys])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for text, *row in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), *(c.to_pylist() for c in b.columns[2:]), strict=True):
                held.append((row, words(text or "")))
                size += len(held[-1][1]) + 100
                if size > CHUNK_WORDS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def flush(held: list) -> pa.RecordBatch:
        rows = []
        for index in sent.value:
            for t, o, distance, word in search(index, [index.numbers(ws) for _, ws in held]):
                doc_id, *rest = held[t][0]
                rows.append((doc_id, index.ids[o], distance, 1 - distance / len(index.items[o]), word, *rest))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    item, parts, some = benchmark.schema["item_id"].dataType, [], []
    for index in blocks(benchmark):
        if len(some) == TOGETHER:  # what was found is written, so that no more than TOGETHER indexes are held at once
            parts.append(stored(_scan(docs, some, item), "leaks"))
            some = []
        some.append(index)
    return union_all([*parts, _scan(docs, some, item)])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, similarity, word): a row for each document and item that leaks into it, with the least
    distance in words, 1 - distance / n, and the word from which on it was found.

    Null texts hold nothing; null items and items without a word are not looked for; an item of fewer than SHORT words leaks
    where it stands word for word. Repeated documents or items give repeated rows, ties the first place. Other columns are
    ignored; an empty table on either side gives an empty one. Nothing is shuffled: indexes of bounded size go to all tasks,
    and a pass over the documents looks for TOGETHER * BLOCK_WORDS words of items.
    """
    return _leaks(docs.select("doc_id", "text"), benchmark)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` into which no item leaks, with all their columns. A row goes by its own text, whatever other rows
    share its doc_id, null among them."""
    docs, named = set_aside(docs, "__row", "__text")
    keys = {"__row": F.xxhash64("doc_id", "text"), "__text": F.xxhash64("text")}
    bad = stored(_leaks(docs.select("doc_id", "text", *(k.alias(c) for c, k in keys.items())), benchmark).select(*keys).distinct(), "leaking")  # its size is known then
    return named(docs.withColumns(keys).join(bad, [*keys], "left_anti").select(*docs.columns))


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
