"""Ranks, strata and picks with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.operators.metrics import quantiles


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows: a heap a task, then one of k rows a task."""
    return df.orderBy(*order).limit(k)


def top_each(df: DataFrame, k: int, by: Sequence[str], *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1; Spark cuts groups to k before the shuffle."""
    at = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, at).where(F.col(rank) <= k)


def strata(df: DataFrame, value: str, names: Sequence[str] = ("Q1", "Q2", "Q3", "Q4")) -> DataFrame:
    """Rows with the stratum of a value among equal percentile ranges of all values, half-open but for the last. Equal values
    share a stratum."""
    n = len(names)
    cuts = quantiles(df, value, [i / n for i in range(1, n)]).withColumnRenamed("quantiles", "__cuts")
    name = F.lit(names[-1])
    for i in reversed(range(n - 1)):
        name = F.when(F.col(value) < F.col("__cuts")[i], names[i]).otherwise(name)
    return df.join(F.broadcast(cuts)).withColumn("stratum", F.when(F.col(value).isNotNull(), name)).drop("__cuts")  # one row of cuts


def hash_pick(df: DataFrame, by: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """One row a group: the one with the least SHA-256 of its parts joined by `|`. Independent of row order."""
    digest = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in parts)), 256)
    rows = df.withColumn("digest", digest)
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), "digest").alias("__row")).select(*by, "__row.*")


def bands(df: DataFrame, by: Sequence[str], edges: Sequence[tuple[float, float]], *order: Column) -> DataFrame:
    """The first row of each band of ranks in each group: from floor(lo n) up to ceil(hi n), band numbers from 0."""
    w = W.partitionBy(*by)
    rows = df.withColumns({"__at": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    picks = F.array(*(F.when((F.col("__at") >= F.floor(F.col("__n") * lo)) & (F.col("__at") < F.ceil(F.col("__n") * hi)), F.lit(i)) for i, (lo, hi) in enumerate(edges)))
    rows = rows.withColumn("band", F.explode(F.array_compact(picks)))
    return top_each(rows, 1, [*by, "band"], F.col("__at"), rank="__first").drop("__first", "__at", "__n")


def interleaved(df: DataFrame, period: int, *keys: Column) -> DataFrame:
    """Rows with their turn: keys are added up modulo the period, so neighbours in key order take different turns."""
    total = keys[0]
    for k in keys[1:]:
        total = total + k
    return df.withColumn("turn", F.pmod(total, F.lit(period)))
