"""Quality of documents by a regularised quadratic discriminant.

A text becomes a row of statistics (shares of kinds of characters, words, lines, repetition), each transformed so that it is
spread about evenly. Each class is a normal distribution over them: its own mean, and a covariance that is shrunk towards
the one that both classes share, then towards its diagonal. A score is the difference of the two log densities, which are
Mahalanobis lengths under Cholesky factors that are computed once, turned into a probability with the classes' shares.

Counts, sums and products of the labelled rows are added up over all of them, a task at a time; only these sums reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.llm.common import documents, stored

#: How far a class's covariance is shrunk to the shared one, and that one to its diagonal; the least variance of a statistic, and
#: the score from which a document counts as good.
TO_SHARED, TO_DIAGONAL, FLOOR, GOOD = 0.75, 0.01, 1e-4, 0.7
#: Documents whose statistics are returned at once.
ROWS = 500

_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_BLANKS, _STOPS = b" \t\n\x0b\x0c\r", b".,;:'\"?-()"
_HIGH = bytes(range(128, 256))
_MARKS = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGITS + _STOPS)
NAMES = (
    "length", "words", "word_length", "word_spread", "upper", "digits", "stops", "marks", "high", "lines", "distinct", "top_word", "pairs",
    "line_repeats", "top_line", "marked_words", "shouted_words", "capital_words", "numeric_words", "short_words", "long_words", "sentence", "bytes_entropy",
)


def _share(part: float, whole: float) -> float:
    """The arcsine of the square root: it spreads shares near 0 and 1."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """In the order of NAMES; a text without words has zeros but for its length."""
    raw = (text or "").encode("utf-8", "replace")
    size = len(raw)
    words = raw.split()
    n = len(words)
    if not n:
        return [math.log1p(size)] + [0.0] * (len(NAMES) - 1)
    less = lambda kind: size - len(raw.translate(None, kind))
    counts, pairs = Counter(words), set(zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), np.float64, n)
    upper, digits, stops, marks, high, solid = less(_UPPER), less(_DIGITS), less(_STOPS), less(_MARKS), less(_HIGH), size - less(_BLANKS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = Counter(lines)
    marked = sum(k for w, k in counts.items() if len(w) != len(w.translate(None, _MARKS)))
    shouted = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    capital = sum(k for w, k in counts.items() if w[:1].isupper())
    numeric = sum(k for w, k in counts.items() if len(w) != len(w.translate(None, _DIGITS)))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    seen = seen[seen > 0]
    return [
        math.log1p(size), math.log1p(n), math.log(lengths.mean()), math.log1p(lengths.std()), _share(upper, solid), _share(digits, solid), _share(stops, solid),
        _share(marks, solid), _share(high, solid), math.log(len(lines) / n), math.log(len(counts)) / math.log(n) if n > 1 else 1.0, _share(counts.most_common(1)[0][1], n),
        _share(len(pairs), n - 1), _share(len(lines) - len(repeated), len(lines)), _share(repeated.most_common(1)[0][1] * len(repeated.most_common(1)[0][0]), size), _share(marked, n),
        _share(shouted, n), _share(capital, n), _share(numeric, n), _share(int((lengths <= 3).sum()), n), _share(int((lengths > 14).sum()), n),
        math.log(n / (1 + raw.count(b".") + raw.count(b"!") + raw.count(b"?"))), float(-(seen * np.log2(seen)).sum()),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row's text, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                rows = [statistics(t.as_py()) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def taught(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """(good, x) of the rows that teach: labelled, with a doc_id, not held out. Of several labels of a document the mean counts,
    good from a half on; null labels don't."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    return measures.join(own, "doc_id").select("good", "x")


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of each class: rows, sums, sums of products. A task sends as many numbers as a class has, added up by place."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            good = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in (0, 1):
                own = x[good == k]
                sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for k in (0, 1):
            if sums[k, 0]:
                yield pa.RecordBatch.from_arrays([pa.array([k] * sums.shape[1], pa.int32()), pa.array(np.arange(sums.shape[1], dtype=np.int32)), pa.array(sums[k])], names=["good", "place", "value"])

    added = rows.mapInArrow(run, "good int, place int, value double").groupBy("good", "place").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for r in added.collect():  # two classes of 1 + d + d * d numbers
        out.setdefault(r.good, np.zeros(1 + d + d * d))[r.place] = r.value
    return {k: (float(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in out.items()}


@dataclass
class Discriminant:
    """Of each class its mean, the inverse of its covariance's Cholesky factor, and the log density's constant with the class's
    share in it."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        return np.stack([c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of the good class."""
        bad, good = self.log_densities(x).T
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fitted(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_shared: float = TO_SHARED, to_diagonal: float = TO_DIAGONAL) -> Discriminant | float:
    """From the classes' sums; without rows of both, the share of good ones (a half without any)."""
    if len(sums) < 2:
        return float(next(iter(sums), 0.5))
    total = sum(n for n, _, _ in sums.values())
    means = {k: s / n for k, (n, s, _) in sums.items()}
    spread = {k: ss / n - np.outer(means[k], means[k]) for k, (n, _, ss) in sums.items()}
    shared = sum(sums[k][0] * spread[k] for k in sums) / total
    factors, constants = [], []
    for k in (0, 1):
        own = (1 - to_shared) * spread[k] + to_shared * shared
        own = (1 - to_diagonal) * own + to_diagonal * np.diag(np.diag(own)) + FLOOR * np.eye(len(own))
        factor = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(factor))
        constants.append(math.log(sums[k][0] / total) - np.log(np.diag(factor)).sum())
    return Discriminant(np.stack([means[0], means[1]]), np.stack(factors), np.array(constants))


def fit(measures: DataFrame, labels: DataFrame) -> Discriminant | float:
    return fitted(moments(taught(measures, labels)))


def scored(measures: DataFrame, model: Discriminant | float) -> DataFrame:
    """(doc_id, score, predicted) of every row of measures."""
    sent = measures.sparkSession.sparkContext.broadcast(model)  # two matrices of d x d
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            score = model.score(x) if isinstance(model, Discriminant) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= GOOD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return measures.mapInArrow(run, f"doc_id {measures.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`: how likely its text is good, as the labelled rows that are
    not held out teach it.

    Null, empty and blank texts are scored by their statistics like any other. Without labelled rows every score is 0.5, with one
    class alone 0 or 1. Rows without a doc_id teach nothing and are scored; repeated rows are scored each, and each teaches.
    Other columns are ignored; an empty table gives an empty one. Texts are read once: their statistics are kept in the shared
    folder.
    """
    measures = stored(measured(docs), "statistics")
    rows = scored(measures, fit(measures, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
