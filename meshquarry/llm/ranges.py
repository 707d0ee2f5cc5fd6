"""Ranges of doc_id for work in ascending order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_of(docs: DataFrame, n: int) -> Column:
    """Of doc_id its range, 0 to n - 1, by approximate quantiles; nulls are in the first. Reads the ids alone; n - 1 bounds
    at most reach the driver and the plan."""
    bounds = sorted({int(x) for x in docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    if not bounds:
        return F.lit(0)
    among = F.array(*map(F.lit, bounds)).cast("array<long>")
    powers = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(powers, F.lit(0), lambda s, p: s + F.when(F.coalesce(F.get(among, s + p - 1) <= F.col("doc_id"), F.lit(False)), p).otherwise(0))
