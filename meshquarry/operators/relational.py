"""Joins, integrity rules and groupings over record tables. All return DataFrames and are lazy, but for the count of dealt()."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.storage import cut

#: Rows that dealt() gives a task, about.
ROWS_A_TASK = 500_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by keys, over as many tasks as give each about ROWS_A_TASK, so that what a task holds of them does not
    grow with the table. Counts them first. Groups of these keys need no further shuffle, nor a table of groups before this one; that
    pays where groups are small. The rows of one key are one task's."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_TASK))
    return rows.repartition(n, *keys)


def connections(sites: DataFrame, accepted: Sequence[str]) -> DataFrame:
    """Directed edges (pre, post) from sites (id, pre, post, evidence, verified, review): number of sites, number of distinct
    evidence, whether all are verified, whether all reviews are among `accepted`. Sites without both ends are left out.
    One combined shuffle by edge."""
    return (
        sites.where(F.col("pre").isNotNull() & F.col("post").isNotNull())
        .groupBy("pre", "post")
        .agg(
            F.count("*").alias("n_sites"),
            F.count_distinct("evidence").alias("n_evidence"),
            F.bool_and("verified").alias("all_verified"),
            F.coalesce(F.bool_and(F.col("review").isin(*accepted)), F.lit(False)).alias("all_accepted"),
        )
    )


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """A 1-based serial number in the order of unique keys, without a task that sees all rows: rows are sorted within ranges of
    the whole key, however heavy its first column, and each range starts where the ones before it end. The rows are computed
    once and kept in the shared folder; one count a range passes a single task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    rows = rows.withColumns({"__range": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = rows.groupBy("__range").count()
    start = counts.select("__range", (F.sum("count").over(W.orderBy("__range")) - F.col("count")).alias("__start"))  # a row a range
    return rows.join(F.broadcast(start), "__range").withColumn(name, F.col("__start") + F.col("__at") + 1).drop("__id", "__range", "__at", "__start")


def running(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Rows with the sum of a value over all rows up to them, in the order of a column of distinct values; as numbered(), by
    ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(n, order).withColumn("__range", F.spark_partition_id()))
    sums = rows.groupBy("__range").agg(F.sum(value).alias("__sum"))
    start = sums.select("__range", (F.sum("__sum").over(W.orderBy("__range")) - F.col("__sum")).alias("__start"))  # a row a range
    own = F.sum(value).over(W.partitionBy("__range").orderBy(order))
    return rows.withColumn(name, own).join(F.broadcast(start), "__range").withColumn(name, F.col(name) + F.col("__start")).drop("__range", "__start")


def resolve_links(links: DataFrame, pre: int = 15, post: int = 16) -> DataFrame:
    """Links (connector, node, relation) to one row a connector: distinct nodes on either side, and whether both have any."""
    return (
        links.groupBy("connector")
        .agg(*(F.count_distinct(F.when(F.col("relation") == r, F.col("node"))).alias(c) for c, r in (("n_pre", pre), ("n_post", post))))
        .withColumn("resolved", (F.col("n_pre") > 0) & (F.col("n_post") > 0))
    )


def expanded_links(links: DataFrame, pre: int = 15, post: int = 16) -> DataFrame:
    """(connector, pre, post): each distinct pre node of a connector with each post node; those of one side alone have none. The
    sides are joined, not collected, so adaptive execution can split a connector of many nodes."""
    side = lambda relation, name: links.where(F.col("relation") == relation).select("connector", F.col("node").alias(name)).distinct()
    return side(pre, "pre").join(side(post, "post"), "connector").select("connector", "pre", "post")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; null keys are no orphans."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def unsupported(claims: DataFrame, key: str, support: DataFrame, condition: Column) -> DataFrame:
    """Claims without a row of support that meets the condition."""
    return claims.join(support.where(condition).select(key).distinct(), key, "left_anti")


def coalesced(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row a key: from the first table where it has the key, else from the second. Columns must agree."""
    rows = second.join(first.select(key), key, "left_anti")
    return first.unionByName(rows.select(*first.columns))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def differing(stored: DataFrame, derived: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys whose values differ, or that one side lacks: (key..., stored, derived)."""
    a = stored.select(*key, F.col(value).alias("stored"))
    b = derived.select(*key, F.col(value).alias("derived"))
    return a.join(b, list(key), "full_outer").where(~F.col("stored").eqNullSafe(F.col("derived")))


def crosstab(df: DataFrame, keys: Sequence[str], domains: dict[str, Sequence]) -> DataFrame:
    """Counts for every combination of the domains' values, zero where there is no row. The domains are literal lists."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1).select()
    for k in keys:
        grid = grid.select("*", F.explode(F.array(*map(F.lit, domains[k]))).alias(k))
    return grid.join(counts, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def consensus(votes: DataFrame, key: str, vote: str, decided: Sequence[str]) -> DataFrame:
    """One row a key: the vote all share if it is among `decided`, `mixed` if votes differ, else null."""
    rows = votes.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(vote).alias("kinds"), F.max(vote).alias("vote"))
    verdict = F.when(F.col("kinds") > 1, F.lit("mixed")).when(F.col("vote").isin(*decided), F.col("vote"))
    return rows.select(key, "n", verdict.alias("verdict"))


def equal_weights(df: DataFrame, *group: str) -> DataFrame:
    """Rows with a weight: each group sums to one."""
    return df.withColumn("weight", F.lit(1.0) / F.count("*").over(W.partitionBy(*group)))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in a total order. Spark keeps one row a key before the shuffle."""
    at = F.row_number().over(W.partitionBy(*key).orderBy(*[c.desc() for c in order]))
    return df.withColumn("__at", at).where("__at = 1").drop("__at")


def keyed_diff(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., state): added (only in b), removed (only in a) or shared."""
    a, b = (df.select(*key).distinct().withColumn(side, F.lit(True)) for df, side in ((a, "__a"), (b, "__b")))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("shared")
    return a.join(b, list(key), "full_outer").select(*key, state.alias("state"))


def degrees(edges: DataFrame, a: str = "pre", b: str = "post") -> DataFrame:
    """(node, degree): how many edges end at each node, on either side."""
    ends = edges.select(F.explode(F.array(a, b)).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def jaccard(df: DataFrame, key: str, member: str, left: Column, right: Column) -> DataFrame:
    """(key, shared, either, jaccard) of the member sets on two sides of each key, by counts alone."""
    rows = df.groupBy(key, member).agg(F.bool_or(left).alias("l"), F.bool_or(right).alias("r"))
    out = rows.groupBy(key).agg(F.count_if(F.col("l") & F.col("r")).alias("shared"), F.count_if(F.col("l") | F.col("r")).alias("either"))
    return out.withColumn("jaccard", F.when(F.col("either") > 0, F.col("shared") / F.col("either")).otherwise(F.lit(1.0)))


def leave_one_out(df: DataFrame, key: str) -> DataFrame:
    """(held_out, key): for each distinct key all others. For the few keys of a validation plan: quadratic in them."""
    keys = df.select(key).distinct()
    return keys.select(F.col(key).alias("held_out")).join(keys, F.col("held_out") != F.col(key))


def with_hint(rows: DataFrame, hints: Sequence[tuple[str, DataFrame]], value: str, default: float) -> DataFrame:
    """Rows with the value of the first table of hints (key, value) that has their key, else the default."""
    found = []
    for i, (key, hint) in enumerate(hints):
        rows = rows.join(hint.select(key, F.col(value).alias(f"__hint{i}")), key, "left")
        found.append(f"__hint{i}")
    return rows.withColumn(value, F.coalesce(*found, F.lit(default))).drop(*found)


def fresh(eligible: DataFrame, key: Sequence[str], *used: DataFrame) -> DataFrame:
    """The eligible rows whose key is in none of the used tables."""
    for table in used:
        eligible = eligible.join(table.select(*key).distinct(), list(key), "left_anti")
    return eligible


def union_with_origin(parts: dict[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """(key..., first, origins): the keys of all parts, the first part by name that has each, and how many have it."""
    rows = None
    for name, part in parts.items():
        one = part.select(*key).withColumn("__origin", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*key).agg(F.min("__origin").alias("first"), F.count_distinct("__origin").alias("origins"))


def stale(rows: DataFrame, at: str, now: Column, most_s: int) -> DataFrame:
    """Rows with their age in whole seconds and whether it is over the limit."""
    return rows.withColumn("age", F.unix_timestamp(now) - F.unix_timestamp(at)).withColumn("stale", F.col("age") > most_s)
