"""Agreement, separation and summary figures, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.operators.relational import running
from meshquarry.storage import cut


def contingency(df: DataFrame, truth: str, predicted: str, background: int = 0) -> DataFrame:
    """(truth, predicted, n), without the cell where both are background."""
    rows = df.select(F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
    rows = rows.where(~((F.col("truth") == background) & (F.col("predicted") == background)))
    return rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def information(cells: DataFrame) -> DataFrame:
    """One row: the two halves of the variation of information in bits (Meilă, 2003), from contingency cells."""
    total = cells.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    entropy = F.coalesce(F.sum(-share * F.log2(share)), F.lit(0.0))
    by = lambda *keys: (cells.groupBy(*keys).agg(F.sum("n").alias("n")) if keys else cells).join(F.broadcast(total)).agg(entropy.alias("h"))
    joint, truth, predicted = by().withColumnRenamed("h", "joint"), by("truth").withColumnRenamed("h", "h_truth"), by("predicted").withColumnRenamed("h", "h_predicted")
    rows = joint.join(F.broadcast(truth)).join(F.broadcast(predicted))  # of a row each
    return rows.select("joint", F.greatest(F.col("joint") - F.col("h_predicted"), F.lit(0.0)).alias("split_bits"), F.greatest(F.col("joint") - F.col("h_truth"), F.lit(0.0)).alias("merge_bits"))


def object_errors(cells: DataFrame, background: int = 0) -> DataFrame:
    """One row: predicted objects that meet several true ones (merges), true ones that meet several predicted ones (splits),
    true ones that meet none (missed), predicted ones that meet none (false)."""
    t, p = F.col("truth") != background, F.col("predicted") != background
    by = lambda key, other, cond: cells.where(cond).groupBy(key).agg(F.count_if(other).alias("met"))
    pred = by("predicted", t, p).agg(F.count_if(F.col("met") > 1).alias("merges"), F.count_if(F.col("met") == 0).alias("false_objects"))
    true = by("truth", p, t).agg(F.count_if(F.col("met") > 1).alias("splits"), F.count_if(F.col("met") == 0).alias("missed"))
    return pred.join(F.broadcast(true))


def rank_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties counting half (Mann and Whitney, 1947).

    Rows are first counted by distinct score; the running number of negatives goes by ranges of the scores.
    """
    by = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    below = running(by, score, "neg", "upto").withColumn("below", F.col("upto") - F.col("neg"))
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return below.agg(F.when(pairs > 0, won / pairs).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """One row with an array of exact percentiles (linear between values) of all rows, without a state of all values: values are
    counted, and the counts summed up by ranges."""
    by = running(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n")), value, "__n", "__upto")
    total = by.agg(F.max("__upto").alias("__total"))
    by = by.join(F.broadcast(total))  # one row
    out = []
    for p in shares:
        at = (F.col("__total") - 1) * p
        lo, hi = (F.min(F.when(F.col("__upto") > k, F.col(value))) for k in (F.floor(at), F.ceil(at)))
        out.append(lo + (hi - lo) * (F.max(at) - F.floor(F.max(at))))
    return by.agg(F.array(*out).alias("quantiles"))


def quantiles_by(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """A row a group with exact percentiles (linear between values) under the names of `shares`. As quantiles(): values are counted
    and the counts summed up by ranges of group and value, so that a large group is many tasks' work and no state holds its values.
    Nulls are left out, a group of nulls alone too; a null in `by` is a group."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    rows = cut(counts.repartitionByRange(n, *by, "__v").withColumn("__range", F.spark_partition_id()))
    sums = rows.groupBy(*by, "__range").agg(F.sum("__n").alias("__sum"))
    before = F.sum("__sum").over(W.partitionBy(*by).orderBy("__range")) - F.col("__sum")
    start = sums.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__range").alias("__at"), before.alias("__before"), F.sum("__sum").over(W.partitionBy(*by)).alias("__total"))
    own = rows.withColumn("__upto", F.sum("__n").over(W.partitionBy("__range", *by).orderBy("__v")))
    same = [own[c].eqNullSafe(start[f"__{c}"]) for c in by]
    own = own.join(start, [own["__range"] == start["__at"], *same]).withColumn("__upto", F.col("__upto") + F.col("__before"))
    out = []
    for name, p in shares.items():
        at = (F.col("__total") - 1) * p
        lo, hi = (F.min(F.when(F.col("__upto") > k, F.col("__v"))) for k in (F.floor(at), F.ceil(at)))
        out.append((lo + (hi - lo) * (F.max(at) - F.floor(F.max(at)))).alias(name))
    return own.groupBy(*by).agg(*out)


def with_quantiles(figures: DataFrame, df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The groups' figures with their percentiles, null where a group has no value."""
    q = quantiles_by(df, by, value, shares).withColumnsRenamed({c: f"__{c}" for c in by})
    return figures.join(q, [figures[c].eqNullSafe(q[f"__{c}"]) for c in by], "left").drop(*(f"__{c}" for c in by))


def summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, mean, population deviation and exact percentiles (linear between values), a row a group."""
    figures = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    return with_quantiles(figures, df, by, value, {"p01": 0.01, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})


def saturation(df: DataFrame, value: str, by: tuple[str, ...], levels: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Range, mean, and the share of values at or above each level."""
    shares = [F.avg((F.col(value) >= t).cast("double")).alias(f"share_{int(t * 100)}") for t in levels]
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), *shares)


def balanced_accuracy(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: accuracy on either class, and their mean."""
    on = lambda c: F.avg(F.when(truth if c else ~truth, (predicted == F.lit(c)).cast("double")))
    return df.agg(on(True).alias("sensitivity"), on(False).alias("specificity")).withColumn("balanced", (F.col("sensitivity") + F.col("specificity")) / 2)


def grouped_then_overall(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the mean over groups of their means, and the plain mean."""
    by = df.groupBy(group).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(value).alias("n"))
    return by.agg(F.count("*").alias("groups"), F.avg("mean").alias("mean_of_means"), (F.sum("total") / F.sum("n")).alias("plain_mean"))


def dominant(df: DataFrame, key: str, label: str) -> DataFrame:
    """Each key's most frequent label, the smallest of equals, with its share."""
    counts = df.groupBy(key, label).agg(F.count("*").alias("n"))
    best = F.max_by(label, F.struct(F.col("n"), -F.col(label)))
    return counts.groupBy(key).agg(best.alias("label"), (F.max("n") / F.sum("n")).alias("share"), F.count("*").alias("labels"))


def merge_pairs(df: DataFrame, object_: str, owner: str) -> DataFrame:
    """One row: over all objects, the pairs of distinct owners that meet in one."""
    by = df.groupBy(object_).agg(F.count_distinct(owner).alias("k"))
    return by.agg(F.sum(F.expr("k * (k - 1) div 2")).alias("pairs"), F.count_if(F.col("k") > 1).alias("objects"))


def pooled(df: DataFrame, by: list[str], mean: str, n: str) -> DataFrame:
    """(by, pooled): means weighed by their counts."""
    return df.groupBy(*by).agg((F.sum(F.col(mean) * F.col(n)) / F.sum(n)).alias("pooled"))


def item_accuracy(df: DataFrame, item: str, truth: str, probability: str) -> DataFrame:
    """(truth, items, mean, accuracy, margin): an item's probabilities are averaged first, so that each counts once;
    to 9 digits, so that the order of a sum doesn't decide at a half."""
    by = df.groupBy(item, truth).agg(F.round(F.avg(probability), 9).alias("p"))
    right = ((F.col("p") >= 0.5) == F.col(truth)).cast("double")
    return by.groupBy(truth).agg(F.count("*").alias("items"), F.avg("p").alias("mean"), F.avg(right).alias("accuracy"), F.avg(F.abs(F.col("p") - 0.5)).alias("margin"))


def histogram_features(df: DataFrame, key: str, bin_: str, low: int, high: int) -> DataFrame:
    """(key, tissue, information): the share of values in the bins from low to high, and the entropy of the bins."""
    counts = df.groupBy(key, bin_).agg(F.count("*").alias("n"))
    by = counts.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.when(F.col(bin_).between(low, high), F.col("n")).otherwise(0)).alias("inside"), F.sum(F.col("n") * F.log2("n")).alias("weighed"))
    return by.select(key, (F.col("inside") / F.col("total")).alias("tissue"), (F.log2("total") - F.col("weighed") / F.col("total")).alias("information"))
