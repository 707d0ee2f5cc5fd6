"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to three bytes long holds how often each byte followed. A byte that a context
has seen n of N times, d different ones, costs -log2(n / (N + d)) bits there; one that it has not seen costs an escape,
-log2(d / (N + d)), and is coded in the context that is a byte shorter, at last as one of 256. All byte values and all
contexts of the sample are kept. Counts stay frozen while scoring, so a text's code length in a language is a sum of table
entries, exact and independent of the order of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.llm.common import documents, set_aside

ORDER = 3
#: The model is fitted to at most about so many documents of each language, chosen by hash; of a longer one, to a piece of so
#: many bytes whose place a hash chooses.
TRAIN_DOCS, TRAIN_BYTES = 3_000, 65_536
#: Bytes and documents that are scored at once.
CHUNK, ROWS = 1 << 19, 500
#: Bits a byte beyond which a text is in no learned language; plain text takes two to four, random letters over five.
MOST_BITS = 6.0
_LETTER = regex.compile(r"\p{L}")
_PAD = b"\0" * ORDER


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _codes(data: np.ndarray) -> np.ndarray:
    """Of each byte from the fourth on, with the three before it, as a number."""
    x = data.astype(np.uint32)
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


def _piece(text: bytes) -> bytes:
    """The text after ORDER zero bytes; of a longer one than TRAIN_BYTES a piece with the ORDER bytes before it."""
    if len(text) <= TRAIN_BYTES:
        return _PAD + text
    at = zlib.crc32(text) % (len(text) - TRAIN_BYTES + 1)
    return (_PAD + text)[at : at + ORDER + TRAIN_BYTES]


def grams(training: DataFrame) -> DataFrame:
    """(lang, code, n): how often each run of four bytes occurs in each language; texts begin with three zero bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).cast(pa.binary()).to_pylist()
            for lang in set(langs):
                parts = [np.unique(_codes(np.frombuffer(_piece(texts[i]), np.uint8)), return_counts=True) for i in np.flatnonzero(langs == lang) if texts[i]]
                if parts:
                    code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    return training.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Contexts of one length: runs of the context and a byte that any language has seen, in order, with their code lengths by
    language; and the contexts in order, with the cost of an escape by language (0 where it hasn't seen the context)."""

    codes: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


def _among(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x is, and whether it is."""
    at = np.minimum(np.searchsorted(sorted_, x), max(0, len(sorted_) - 1))
    return at, sorted_[at] == x if len(sorted_) else np.zeros(len(x), bool)


@dataclass
class Model:
    langs: list[str]
    levels: list[Level]  # contexts of 3, 2, 1 and 0 bytes

    def code_bits(self, codes: np.ndarray, level: int = 0) -> np.ndarray:
        """Code lengths, by language, of the last byte of each run."""
        if level == len(self.levels):
            return np.full((len(codes), len(self.langs)), 8.0)
        own = self.levels[level]
        at, known = _among(own.codes, codes)
        out = own.bits[at].astype(np.float64) if len(own.codes) else np.zeros((len(codes), len(self.langs)))
        if len(rest := np.flatnonzero(~known)):
            below = codes[rest] & ((1 << 8 * (ORDER - level)) - 1)
            at, known = _among(own.contexts, codes[rest] >> 8)
            out[rest] = np.where(known[:, None], own.escapes[at], 0) + self.code_bits(below, level + 1)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths by text and language, of whole texts, in pieces of bounded size. Each different run of four bytes of a
        piece is looked up once."""
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths + ORDER)
        data = np.frombuffer(b"".join(x for t in texts for x in (_PAD, t)), np.uint8)
        out = np.zeros((len(texts), len(self.langs)))
        for at in range(ORDER, len(data), CHUNK):
            codes, which = np.unique(_codes(data[at - ORDER : at + CHUNK]), return_inverse=True)
            rows = self.code_bits(codes.astype(np.int64)).astype(np.float32)[which]
            owner = np.searchsorted(ends, np.arange(at, at + len(which)), side="right")
            rows[(np.arange(at, at + len(which)) - (ends - lengths - ORDER)[owner]) < ORDER] = 0  # the padding itself
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[starts]] += np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
        return out


def _level(langs: np.ndarray, names: list[str], code: np.ndarray, n: np.ndarray, below: Model, context_bytes: int) -> Level:
    codes, contexts = np.unique(code), np.unique(code >> 8)
    level = ORDER - context_bytes + 1
    lower = below.code_bits(codes & ((1 << 8 * context_bytes) - 1), level)
    bits, escapes = np.empty((len(codes), len(names)), np.float32), np.zeros((len(contexts), len(names)), np.float32)
    for k, name in enumerate(names):
        own, at = np.unique(code[langs == name], return_inverse=True)
        count = np.bincount(at, n[langs == name])
        context = np.searchsorted(contexts, own >> 8)
        total, kinds = np.bincount(context, count, len(contexts)), np.bincount(context, minlength=len(contexts))
        seen = np.flatnonzero(total)
        escapes[seen, k] = -np.log2(kinds[seen] / (total + kinds)[seen])
        bits[:, k] = escapes[np.searchsorted(contexts, codes >> 8), k] + lower[:, k]
        bits[np.searchsorted(codes, own), k] = -np.log2(count / (total + kinds)[context])
    return Level(codes, bits, contexts, escapes)


def build(langs: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    """From how often each run of four bytes occurs in each language; shorter runs are their ends."""
    names = sorted(set(langs.tolist()))
    none = Level(np.zeros(0, np.int64), np.zeros((0, len(names))), np.zeros(0, np.int64), np.zeros((0, len(names))))
    model = Model(names, [none] * (ORDER + 1))
    for context_bytes in range(ORDER + 1):
        short = code & ((1 << 8 * (context_bytes + 1)) - 1)
        model.levels[ORDER - context_bytes] = _level(langs, names, short, n, model, context_bytes)
    return model


def fit(docs: DataFrame) -> Model | None:
    """From text and lang of rows with both that are not held out. The sample is bounded by TRAIN_DOCS documents of a
    language, in expectation, and TRAIN_BYTES of each: a hash of text and doc_id picks a share of each language. None without rows."""
    rows = docs.where(F.col("text") != "").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = {r.lang: TRAIN_DOCS / r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not share:
        return None
    chosen = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_003)) < chosen * 1_000_003)
    t = grams(sample).toArrow()  # bounded by the sample
    return build(np.array(t["lang"].to_pylist(), object), t["code"].to_numpy(), t["n"].to_numpy()) if t.num_rows else None


def _predicted(model: Model | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pred, score, per_byte = np.full(len(texts), "und", object), np.zeros(len(texts)), np.full(len(texts), np.nan)
    ok = [i for i, t in enumerate(texts) if model and t and _LETTER.search(t)]
    if ok:
        raw = [texts[i].encode() for i in ok]
        bits = model.bits(raw)
        pred[ok] = np.array(model.langs, object)[bits.argmin(1)]
        score[ok] = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
        per_byte[ok] = bits.min(1) / [len(t) for t in raw]
    return pred, score, per_byte


def language(text: Column, model: Model | None, spark: SparkSession) -> Column:
    """A struct (lang_pred, score, bits_per_byte) for each text, by the text alone: the language with the shortest code
    length, its share of the posterior under equal priors, and that length by byte.

    `und`, 0 and null for null texts, texts without a letter, or without a model; ties go to the language first by name.
    """
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            parts = [_predicted(sent.value, batch.iloc[at : at + ROWS].tolist()) for at in range(0, len(batch), ROWS)]
            yield pd.DataFrame({c: np.concatenate([p[k] for p in parts]) if parts else [] for k, c in enumerate(("lang_pred", "score", "bits_per_byte"))})

    return run(text)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of `docs`, with lang_pred, score and bits_per_byte of its text (see language()) in place of such columns.
    Each row stands alone; an empty table gives an empty one."""
    names = ["lang_pred", "score", "bits_per_byte"]
    docs, named = set_aside(docs.drop(*names), "__found")
    rows = docs.withColumn("__found", language(F.col("text"), model, docs.sparkSession))
    return named(rows.withColumns({c: F.col("__found")[c] for c in names}).drop("__found"))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs` whose text is in a learned language: not `und`, and of at most MOST_BITS bits a byte, which text in
    none of them exceeds."""
    docs, named = set_aside(docs, "__found")
    rows = docs.withColumn("__found", language(F.col("text"), model, docs.sparkSession))
    return named(rows.where((F.col("__found.lang_pred") != "und") & (F.col("__found.bits_per_byte") <= MOST_BITS)).drop("__found"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
