"""Integrity rules, plan checks and cohort gates: violations as rows, verdicts as columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.operators.spatial import box_pairs


def violations(rows: DataFrame, id_: Column, rules: dict[str, Column]) -> DataFrame:
    """(id, problem): a row for each rule that a row breaks; all rules are tried in one pass, a null condition breaks none."""
    told = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return rows.select(id_.cast("string").alias("id"), F.explode(told).alias("problem"))


def dangling(rows: DataFrame, id_: str, ref: str, parents: DataFrame, key: str, problem: str) -> DataFrame:
    """(id, problem) of rows whose reference has no parent; null references have none to lack."""
    lost = rows.where(F.col(ref).isNotNull()).join(parents.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")
    return lost.select(F.col(id_).cast("string").alias("id"), F.lit(problem).alias("problem"))


def all_of(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def supply(rows: DataFrame, *by: str, source: str = "source", kind: str = "kind") -> DataFrame:
    """(by, kind, sources, replicated): how many distinct sources each kind comes from; replicated from two on."""
    return rows.groupBy(*by, kind).agg(F.count_distinct(source).alias("sources")).withColumn("replicated", F.col("sources") >= 2)


def identifiable(rows: DataFrame, axis: str, same: str, different: str) -> DataFrame:
    """A row an axis, of rows (axis, split `train` or `validation`, source, kind): covered (both kinds in both splits),
    repeated (either kind from two sources in train), mixed (a train source has both), evaluable (all three). Sources are
    counted, never collected."""
    by = rows.groupBy(axis, "source").agg(*(F.bool_or((F.col("split") == s) & (F.col("kind") == k)).alias(f"{s}_{n}") for s in ("train", "validation") for n, k in (("same", same), ("different", different))))
    n = {c: F.count_if(F.col(c)) for c in ("train_same", "train_different", "validation_same", "validation_different")}
    out = by.groupBy(axis).agg(*(v.alias(c) for c, v in n.items()), F.count_if(F.col("train_same") & F.col("train_different")).alias("both"))
    out = out.withColumns({
        "covered": reduce(Column.__and__, (F.col(c) > 0 for c in n)),
        "repeated": (F.col("train_same") >= 2) & (F.col("train_different") >= 2),
        "mixed": F.col("both") > 0,
    })
    return out.withColumn("evaluable", F.col("covered") & F.col("repeated") & F.col("mixed"))


def eligible(cells: DataFrame, axis: str, n: str = "n") -> DataFrame:
    """(axis, total, deficient, eligible) of crosstab cells with zero cells kept: an axis needs rows in every cell."""
    by = cells.groupBy(axis).agg(F.sum(n).alias("total"), F.count_if(F.col(n) == 0).alias("deficient"))
    return by.withColumn("eligible", F.col("deficient") == 0)


def collapsed(events: DataFrame, key: str, kind: str, order: Sequence[str], uncertain: Sequence[str]) -> DataFrame:
    """(key, state, kind, event): of an item's events, `conflict` where kinds differ, `excluded` where the one kind is among
    `uncertain`, else `effective` with that kind and the last event's order. One combined shuffle."""
    last = F.max(F.struct(*order)) if len(order) > 1 else F.max(order[0])
    by = events.groupBy(key).agg(F.min(kind).alias("kind"), F.max(kind).alias("__other"), last.alias("event"))
    state = F.when(F.col("kind") != F.col("__other"), "conflict").when(F.col("kind").isin(*uncertain), "excluded").otherwise("effective")
    return by.select(key, state.alias("state"), F.when(state == "effective", F.col("kind")).alias("kind"), F.when(state == "effective", F.col("event")).alias("event"))


def plan_violations(crops: DataFrame, parents: DataFrame, splits: Sequence[str], reserved: Sequence[str], cell: tuple[int, int, int]) -> DataFrame:
    """(id, problem) of crops (id, parent, split, z0, z1, ...) against parents (parent, dz, dy, dx): repeated ids, reserved
    parents, unknown splits or parents, bounds, and overlaps across splits within a parent."""
    known = crops.join(parents, "parent", "left")
    axes = ("z", "y", "x")
    rules = {
        "reserved parent": F.col("parent").isin(*reserved),
        "invalid split": ~F.col("split").isin(*splits),
        "missing parent": F.col("dz").isNull(),
        "invalid bounds": reduce(Column.__or__, ((F.col(f"{a}0") < 0) | (F.col(f"{a}1") <= F.col(f"{a}0")) for a in axes)),
        "exceeds parent": reduce(Column.__or__, (F.col(f"{a}1") > F.col(f"d{a}") for a in axes)),
    }
    twice = crops.groupBy("id").count().where("count > 1").select(F.col("id").cast("string").alias("id"), F.lit("repeated id").alias("problem"))
    pairs = box_pairs(crops, crops, cell, same=["parent"], unlike=["split"], ordered=True)
    across = pairs.select(F.concat_ws("/", "a_id", "b_id").alias("id"), F.lit("overlap across splits").alias("problem"))
    return all_of([violations(known, F.col("id"), rules), twice, across])


def ledger(rows: DataFrame, status: str, size: str, total: Column | int) -> DataFrame:
    """One row: sizes validated (cached ones too), rejected and uncertain, the validated share of the total, and what no row
    accounts for."""
    of = lambda *names: F.sum(F.when(F.col(status).isin(*names), F.col(size)).otherwise(0))
    out = rows.agg(of("validated", "cached").alias("validated"), of("rejected").alias("rejected"), of("uncertain").alias("uncertain"))
    whole = F.lit(total) if isinstance(total, int) else total
    return out.withColumns({"coverage": F.col("validated") / whole, "unaccounted": F.greatest(F.lit(0), whole - F.col("validated") - F.col("rejected") - F.col("uncertain"))})


def running_budget(spends: DataFrame, account: str, amount: str, limit: float, *order: str) -> DataFrame:
    """Spends with the account's running total and whether it stays within the limit. An account is one window."""
    spent = F.sum(amount).over(W.partitionBy(account).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return spends.withColumn("spent", spent).withColumn("allowed", F.col("spent") <= limit)


def unblinded(sealed: DataFrame, decisions: DataFrame, key: str, geometry: Sequence[str]) -> DataFrame:
    """(key, state) of every key on either side: `missing` without a decision, `unknown` without a sealed row, `mismatch` where
    the geometry differs, else `matched`."""
    a = sealed.select(key, F.struct(*geometry).alias("__a"))
    b = decisions.select(key, F.struct(*geometry).alias("__b"))
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "unknown").when(~F.col("__a").eqNullSafe(F.col("__b")), "mismatch").otherwise("matched")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))
