"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.storage import cut, scratch, shared_dir, stored

__all__ = ["cut", "documents", "lower_az", "scratch", "set_aside", "shared_dir", "stored", "union_all"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: `[\x20\x09-\x0D]`, the white space that the contracts name.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with those of its own columns renamed that are named like a helper column, and what gives them their names back."""
    taken = {c.lower() for c in docs.columns}
    own = {}
    for c in docs.columns:
        if c.lower() in names:
            own[c] = next(x for k in range(len(taken) + 1) if (x := f"{c}_own{k}").lower() not in taken)
            taken.add(own[c].lower())
    back = {new: old for old, new in own.items()}
    return docs.withColumnsRenamed(own), lambda df: df.withColumnsRenamed(back)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
