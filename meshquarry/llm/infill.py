"""Fill-in-middle transformation: a text's middle moves behind its suffix, so that a left-to-right model learns to fill gaps.

A pattern cuts a text into units; the ends of its matches go into a compact array, and two of them, drawn from a hash of the
document's id, are where the text is sliced. Everything a document becomes follows from its id and text alone, so a task that
runs again on another executor gives the same rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.llm.common import documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points, and characters as readers see them.
CODE_POINTS, GRAPHEMES = r"(?s:.)", r"\X"
#: Documents that are returned at once.
ROWS = 500


@dataclass(frozen=True)
class Plan:
    """What is a unit, the seed of the draws, of 100 documents how many are transformed, and of 100 of these how many with the
    suffix first. Text that no unit matches belongs to the unit after it, at the end to the last slice."""

    unit: str = CODE_POINTS
    seed: int = 1
    transformed: int = 90
    suffix_first: int = 20


def draws(seed: int, doc_id: object) -> list[int]:
    """Four numbers of 32 bits; a null id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def ends(unit: regex.Pattern, text: str) -> array:
    """Where each unit ends, in code points."""
    return array("I", (m.end() for m in unit.finditer(text)))


def infilled(text: str, doc_id: object, plan: Plan, unit: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, the text in that form)."""
    cuts = ends(unit, text)
    h1, h2, h3, h4 = draws(plan.seed, doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plan.transformed:
        return len(cuts), "plain", None, None, text
    low, high = sorted((h1 % (len(cuts) + 1), h2 % (len(cuts) + 1)))
    a, b = (cuts[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < plan.suffix_first:
        return len(cuts), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(cuts), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that was put into that form. A mark can't arise where a slice meets one, since only its first character is `<`,
    so the first place of each is the true one."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    ahead, middle = output[len(first) :].split(MIDDLE, 1)
    one, two = ahead.split(second, 1)
    return two + middle + one if form == "spm" else one + middle + two


def _pieces(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[tuple[pd.Series, pd.Series]]:
    for a, b in batches:
        for at in range(0, max(1, len(a)), ROWS):
            yield a.iloc[at : at + ROWS], b.iloc[at : at + ROWS]


def infill(doc_id: Column, text: Column, plan: Plan | None = None) -> Column:
    """A struct (n, form, prefix_chars, middle_chars, output, output_sha256) of each text."""
    plan = plan or Plan()

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        unit = regex.compile(plan.unit)
        for ids, texts in _pieces(batches):
            rows = [infilled(t or "", i, plan, unit) for i, t in zip(ids.tolist(), texts.tolist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [()] * 5
            columns = {"n": pd.Series(n, dtype="int64"), "form": form, "prefix_chars": pd.Series(prefix, dtype="Int64"), "middle_chars": pd.Series(middle, dtype="Int64"), "output": output}
            yield pd.DataFrame(columns | {"output_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in output]})

    return run(doc_id.cast("string"), text)


def restore(output: Column, form: Column) -> Column:
    """A struct (text, text_sha256): what `infill` was given, from what it returned."""

    @F.pandas_udf("text string, text_sha256 string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in _pieces(batches):
            texts = [rebuilt(o or "", f) for o, f in zip(outputs.tolist(), forms.tolist(), strict=True)]
            yield pd.DataFrame({"text": texts, "text_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts]})

    return run(output, form)


def fill_in_middle(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256) of every row.

    A null or empty text, one that holds a mark already, and the share that stays as it is come out plain, with null lengths.
    A null doc_id draws as an empty string; repeated rows give equal rows. Other columns are ignored, also those named as a
    result; an empty table gives an empty one. No shuffle: a row stands alone, and a text's memory is four bytes a unit besides.
    """
    found = docs.select("doc_id", infill(F.col("doc_id"), F.col("text"), plan).alias("found"))
    return found.select("doc_id", "found.*")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(documents(spark, sf_dir))
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    return rows.withColumn("restored", restore(F.col("output"), F.col("form"))).select(*names, F.col("restored.text_sha256").alias("restored_sha256"))
