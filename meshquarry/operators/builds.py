"""What differs between two builds of a graph: splits, merges, moves, figures and member sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of (object, member) that a task of overlaps() is dealt, about; more rows make more tasks, not larger ones.
ROWS_A_TASK = 500_000


def overlaps(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(source, target, overlap) of objects (object, member) of two builds whose member sets have a Jaccard index of `least` or
    more. Only objects that share a member meet. Rows are dealt out by members once; there each member of a source takes along
    the targets that hold it, so that a row a member, not a row a pair, goes on to the source's task. Pairs are counted within it,
    and only those that share enough of the source's members to come to `least` leave it. Rows are counted first, to deal them."""
    a, b = a.select("object", "member"), b.select("object", "member")
    rows = max(a.count(), b.count())
    n = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))
    a, b = (df.repartition(n, "member").distinct() for df in (a, b))
    held = b.groupBy("member").agg(F.collect_list("object").alias("targets"))
    of = a.withColumnRenamed("object", "source").join(held, "member", "left").select("source", "targets").repartition(n, "source")
    of = of.withColumn("n_source", F.count("*").over(W.partitionBy("source")))
    near = of.select("source", "n_source", F.explode("targets").alias("target")).groupBy("source", "n_source", "target").agg(F.count("*").alias("n"))
    near = near.where((F.col("n") / F.col("n_source") >= least) & F.col("source").isNotNull())
    near = near.join(b.groupBy(F.col("object").alias("target")).agg(F.count("*").alias("n_target")), "target")
    return near.select("source", "target", (F.col("n") / (F.col("n_source") + F.col("n_target") - F.col("n"))).alias("overlap")).where(F.col("overlap") >= least)


def _several(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.withColumn("__n", F.count("*").over(W.partitionBy(key))).where("__n > 1").drop("__n")


def splits(pairs: DataFrame) -> DataFrame:
    """The pairs of sources that went into several targets. At most 1 / least pairs share a source, so groups are small."""
    return _several(pairs, "source")


def merges(pairs: DataFrame) -> DataFrame:
    """The pairs of targets that came from several sources."""
    return _several(pairs, "target")


def changes(a: DataFrame, b: DataFrame, key: str, value: str, shared: bool = False) -> DataFrame:
    """(key, a, b, delta) where a figure differs; keys of one side alone count as zero there, or are left out."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "inner" if shared else "full_outer")
    if not shared:
        both = both.withColumns({"a": F.coalesce("a", F.lit(0)), "b": F.coalesce("b", F.lit(0))})
    return both.where("a <> b").withColumn("delta", F.col("b") - F.col("a"))


def moved(a: DataFrame, b: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, distance) of objects (key, z, y, x) of both builds that moved further than the tolerance."""
    both = a.join(b.select(key, *(F.col(x).alias(f"b_{x}") for x in "zyx")), key)
    d = F.sqrt(F.pow(F.col("b_z") - F.col("z"), F.lit(2)) + F.pow(F.col("b_y") - F.col("y"), F.lit(2)) + F.pow(F.col("b_x") - F.col("x"), F.lit(2)))
    return both.select(key, d.alias("distance")).where(F.col("distance") > tolerance)


def member_sets(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(members): the sorted distinct members of each group, as one value to compare. A group must fit in a row."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("members")).select("members")
