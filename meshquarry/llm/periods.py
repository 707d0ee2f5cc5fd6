"""Runs: maximal stretches of words that repeat with a period.

Every run holds its Lyndon root, the rotation of its period that is smallest under an order of the words or under the reverse
order, and that root is the longest Lyndon word at its place (the runs theorem). So the longest Lyndon word at each place is
found by a stack that a scan from right to left keeps, under both orders, and each is extended to both sides as far as its
period holds. Suffixes are compared, and periods extended, by the longest common extension of two places: the first words
directly, then by binary search over rolling hashes modulo 2^61 - 1. Each run found is compared word by word, its ends
too; if a hash was wrong, the document is done again with another base.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.llm.common import documents

MODULUS = (1 << 61) - 1
BASES = (0x0B5A_4C1D_93E7_F10D, 0x13C6_EF37_2FE9_4F82, 0x09E3_779B_97F4_A7C1)
#: Words compared one by one before hashes are.
NEAR = 8
#: Documents that are returned at once.
ROWS = 200


class Words:
    """A document's words as numbers, equal for equal words, with extensions from pairs of places."""

    def __init__(self, words: list[bytes], base: int):
        known: dict[bytes, int] = {}
        self.w = [known.setdefault(x, len(known)) for x in words]
        self.n, self.base = len(words), base
        self.hashes: list[int] | None = None

    def _hashed(self) -> tuple[list[int], list[int]]:
        if self.hashes is None:
            h, p, hashes, powers = 0, 1, [0], [1]
            for x in self.w:
                h, p = (h * self.base + x + 1) % MODULUS, p * self.base % MODULUS
                hashes.append(h), powers.append(p)
            self.hashes, self.powers = hashes, powers
        return self.hashes, self.powers

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on; i < j."""
        w, most = self.w, self.n - j
        near = min(NEAR, most)
        for k in range(near):
            if w[i + k] != w[j + k]:
                return k
        if near == most:
            return most
        hashes, powers = self._hashed()
        low, step = near, near  # ever longer steps, then halves
        while True:
            high = min(low + step, most)
            if (hashes[i + high] - hashes[i + low] * powers[high - low] - hashes[j + high] + hashes[j + low] * powers[high - low]) % MODULUS:
                break
            low, step = high, 2 * step
            if low == most:
                return most
        while high - low > 1:
            k = (low + high) // 2
            if (hashes[i + k] - hashes[i + low] * powers[k - low] - hashes[j + k] + hashes[j + low] * powers[k - low]) % MODULUS:
                high = k
            else:
                low = k
        return low

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j; i < j."""
        w = self.w
        near = min(NEAR, i)
        for k in range(1, near + 1):
            if w[i - k] != w[j - k]:
                return k - 1
        if near == i:
            return i
        hashes, powers = self._hashed()
        low, step = near, near
        while True:
            high = min(low + step, i)
            if (hashes[i - low] - hashes[i - high] * powers[high - low] - hashes[j - low] + hashes[j - high] * powers[high - low]) % MODULUS:
                break
            low, step = high, 2 * step
            if low == i:
                return i
        while high - low > 1:
            k = (low + high) // 2
            if (hashes[i - low] - hashes[i - k] * powers[k - low] - hashes[j - low] + hashes[j - k] * powers[k - low]) % MODULUS:
                high = k
            else:
                low = k
        return low

    def lyndon(self, reverse: bool) -> list[int]:
        """Of each place where the longest Lyndon word that begins there ends, which is where the next smaller suffix begins.
        A suffix that begins with another one is the greater under both orders."""
        w, n, right = [-x for x in self.w] if reverse else self.w, self.n, self.right
        after = [n] * n
        for i in range(n - 2, -1, -1):
            j, own = i + 1, w[i]
            while j < n:
                other = w[j]
                if own == other:
                    k = right(i, j)
                    if j + k == n or w[i + k] > w[j + k]:
                        break
                elif own > other:
                    break
                j = after[j]
            after[i] = j
        return after


def _runs(words: list[bytes], base: int, least: int, times: int) -> list[tuple[int, int, int]] | None:
    """Those of at least `least` words and `times` (two at least) periods, or None if a hash was found wrong."""
    text, found = Words(words, base), set()
    w, n = text.w, text.n
    for reverse in (False, True):
        last: dict[int, tuple[int, int]] = {}  # of each period the run found last, further left than any before it
        after = text.lyndon(reverse)
        for i in range(n - 1, -1, -1):
            j = after[i]
            p = j - i
            if j == n or w[i] != w[j] or times * p > n:
                continue
            start, end = last.get(p, (n, n))
            if start <= i and j + p <= end:
                continue
            end = j + text.right(i, j)
            if end - j < (times - 2) * p:  # the leftmost root of a run has more after it
                continue
            start = i - text.left(i, j)
            last[p] = start, end
            if end - start >= max(least, times * p):
                if w[start : end - p] != w[start + p : end] or (start and w[start - 1] == w[start - 1 + p]) or (end < n and w[end] == w[end - p]):
                    return None
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(words: list[bytes], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start, then period."""
    for base in BASES:
        if (found := _runs(words, base, least, times)) is not None:
            return found
    raise ArithmeticError("rolling hashes failed under every base")


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Without what a run holds after its first period."""
    if not runs:
        return words
    drop = bytearray(len(words))
    for start, length, period in runs:
        drop[start + period : start + length] = b"\1" * (length - period)
    return [x for x, gone in zip(words, drop, strict=True) if not gone]


def periodic_runs(docs: DataFrame, edit: Callable[[object, list[bytes]], list[bytes]] | None = None, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_text) of every row; runs is an array of (start, length, period), places being word
    numbers from 0. `edit`, given a document's id and words, says which words to take instead.

    Words are what stands between white space (blank, tab to carriage return), compared as bytes. A null, empty or blank text
    has no words, no runs and an empty text. Null doc_ids and repeated rows stand each alone; other columns are ignored; an
    empty table gives an empty one. No shuffle; a task holds one document's words at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_in = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b, n, found, texts = batch.slice(at, ROWS), [], [], []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                    words = (text.as_py() or b"").split()
                    words = edit(doc_id, words) if edit else words
                    runs = runs_of(words, least, times)
                    n.append(len(words)), texts.append(b" ".join(collapsed(words, runs)))
                    found.append([{"start": s, "length": k, "period": p} for s, k, p in runs])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, found_in), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed_text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string")


def echoed(doc_id: object, words: list[bytes]) -> list[bytes]:
    """In about one of ten documents, by the hash of its id, a tail that repeats a stretch of words."""
    from zlib import crc32

    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(documents(spark, sf_dir), echoed)
    line = lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    rank = F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("short")))
    rows = rows.withColumn("best", F.array_max(rank))
    length, period = F.col("best.length"), -F.col("best.short")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.short").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
