"""Audits of volumes, skeletons, offers and stages: figures and flags as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def equivalence(reference: DataFrame, candidate: DataFrame, keys: Sequence[str], group: str, tolerance: float, threshold: float, most: float) -> DataFrame:
    """A row a group, of two volumes (keys..., value): whole (the same voxels on both sides, all finite), largest, mean and
    99th percentile of the differences, the share of decisions (value >= threshold) that differ, and passed.

    Passed needs whole, few differing decisions (`most`), and one of: largest within the tolerance, mean within a tenth of it,
    99th percentile within it. A group's percentile is exact, so a group should be a block."""
    both = reference.select(*keys, F.col("value").alias("a")).join(candidate.select(*keys, F.col("value").alias("b")), list(keys), "full_outer")
    bad = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))
    differ = F.abs(F.col("a") - F.col("b"))
    by = both.groupBy(group).agg(
        F.bool_and(~bad("a") & ~bad("b")).alias("whole"),
        F.max(differ).alias("largest"),
        F.avg(differ).alias("mean"),
        F.percentile(differ, 0.99).alias("p99"),
        F.avg(((F.col("a") >= threshold) != (F.col("b") >= threshold)).cast("int")).alias("disagree"),
    )
    near = (F.col("largest") <= tolerance) | (F.col("mean") <= tolerance * 0.1) | (F.col("p99") <= tolerance)
    return by.withColumn("passed", F.coalesce(F.col("whole") & near & (F.col("disagree") <= most), F.lit(False)))


def gradients(voxels: DataFrame, group: str, value: str = "value") -> DataFrame:
    """The voxels with |gradient| along each axis (gz, gy, gx): central differences, one-sided at the ends of a group. One
    shuffle by group serves all three axes."""
    out = voxels.repartition(group)
    for a in "zyx":
        w = W.partitionBy(group, *(b for b in "zyx" if b != a)).orderBy(a)
        before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        central = (after - before) / 2
        out = out.withColumn(f"g{a}", F.abs(F.coalesce(central, after - v, v - before, F.lit(0.0))))
    return out


def axis_shares(graded: DataFrame, group: str, tail: float) -> DataFrame:
    """A row a group of gradients(): the mean along each axis, the share of voxels in which an axis dominates (the first of
    equal ones, z before y before x), and the same among those whose magnitude is at or over the quantile `tail`."""
    z, y, x = (F.col(f"g{a}") for a in "zyx")
    size = F.sqrt(z * z + y * y + x * x)
    rows = graded.withColumns({"axis": F.when((z >= y) & (z >= x), "z").when(y >= x, "y").otherwise("x"), "size": size})
    cut = rows.groupBy(group).agg(F.percentile("size", tail).alias("cut"))
    rows = rows.join(cut, group).withColumn("top", F.col("size") >= F.col("cut"))
    share = {f"{a}_share": F.avg((F.col("axis") == a).cast("int")) for a in "zyx"}
    top = {f"{a}_top": F.avg(F.when(F.col("top"), (F.col("axis") == a).cast("int"))) for a in "zyx"}
    return rows.groupBy(group).agg(*(F.avg(f"g{a}").alias(f"{a}_mean") for a in "zyx"), *(v.alias(c) for c, v in (share | top).items()))


def long_edges(edges: DataFrame, least: float) -> DataFrame:
    """(tree, child, parent, length, z_score) of edges that stand out of their tree by `least` deviations or more. Means and
    deviations are combined before the shuffle and joined back; no tree is one group."""
    by = edges.groupBy("tree").agg(F.avg("length").alias("mean"), F.stddev_pop("length").alias("deviation"))
    z = (F.col("length") - F.col("mean")) / (F.col("deviation") + 1e-9)
    return edges.join(by, "tree").withColumn("z_score", z).where(F.col("z_score") >= least).select("tree", "child", "parent", "length", "z_score")


def degree_flags(edges: DataFrame, most: int) -> DataFrame:
    """(tree, node, degree) of nodes with more than `most` ends of edges (child, parent); parallel edges count each."""
    ends = edges.select("tree", F.explode(F.array("child", "parent")).alias("node"))
    return ends.groupBy("tree", "node").agg(F.count("*").alias("degree")).where(F.col("degree") > most)


def parallel_edges(edges: DataFrame) -> DataFrame:
    """(tree, parallel): how many edges of a tree repeat the two ends of another, in either direction; trees with none left out."""
    by = edges.groupBy("tree", F.least("child", "parent").alias("lo"), F.greatest("child", "parent").alias("hi")).agg((F.count("*") - 1).alias("n"))
    return by.groupBy("tree").agg(F.sum("n").alias("parallel")).where(F.col("parallel") > 0)


def lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, point_a, point_b): an annotation line from parent to child for each edge both of whose nodes are there."""
    point = F.concat_ws(",", *(F.col(a).cast("long") for a in "xyz"))
    at = nodes.select("tree", "node", point.alias("point"))
    parent, child = (at.select("tree", F.col("node").alias(c), F.col("point").alias(p)) for c, p in (("parent", "point_a"), ("child", "point_b")))
    return edges.select("tree", "child", "parent").join(parent, ["tree", "parent"]).join(child, ["tree", "child"]).select(F.concat_ws(":", "tree", "child").alias("id"), "point_a", "point_b")


def slice_ratios(voxels: DataFrame, *by: str) -> DataFrame:
    """(by, z, area, ratio): voxels of an object in each of its slices, and against the slice before it (null at the first)."""
    area = voxels.groupBy(*by, "z").agg(F.count("*").alias("area"))
    return area.withColumn("ratio", F.col("area") / F.lag("area").over(W.partitionBy(*by).orderBy("z")))


def cheapest(offers: DataFrame, key: str, price: str, *tie: str) -> DataFrame:
    """Of each key's offers the cheapest, of equal ones the first by `tie`; combined before the shuffle."""
    rest = [c for c in offers.columns if c not in (key, price, *tie)]
    best = F.min(F.struct(price, *tie, *rest)).alias("best")
    return offers.groupBy(key).agg(best).select(key, *(F.col(f"best.{c}").alias(c) for c in (price, *tie, *rest)))


def chunk_costs(rate: Column, tiles: int, hourly: Column, transfer: Column, remaining: Column) -> dict[str, Column]:
    """Seconds and cost of a chunk, cost and hours of those that remain; a rate of zero or less never ends (infinity)."""
    seconds = F.when(rate > 0, tiles / rate).otherwise(float("inf"))
    cost = seconds / 3600 * hourly + transfer
    return {"seconds": seconds, "cost": cost, "remaining_cost": remaining * cost, "remaining_hours": remaining * seconds / 3600}


def axis_layout(length: Column, crop: Column, stride: Column) -> dict[str, Column]:
    """Tiles along an axis, the padded length, padding before and after, and the mean number of tiles over a position."""
    n = F.greatest(F.lit(1), F.floor((length - crop) / stride) + 2)
    padded = crop + (n - 1) * stride
    before = F.floor((padded - length) / 2)
    start = lambda i: i * stride - before
    inside = lambda i: F.greatest(F.lit(0), F.least(length, start(i) + crop) - F.greatest(F.lit(0), start(i)))
    covered = F.aggregate(F.sequence(F.lit(0).cast("long"), n - 1), F.lit(0).cast("long"), lambda s, i: s + inside(i).cast("long"))
    return {"tiles": n, "padded": padded, "before": before, "after": padded - length - before, "coverage": covered / length}


def funnel(rows: DataFrame, gates: Mapping[str, Column]) -> DataFrame:
    """The rows with failed_at, the first gate in order that a row doesn't pass (null passes none), and survived."""
    first = F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in gates.items()))
    return rows.withColumn("failed_at", first).withColumn("survived", F.col("failed_at").isNull())


def page(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], skip: int, take: int) -> DataFrame:
    """Of each group the rows after the first `skip`, `take` at most. Spark keeps only skip + take rows a group in each task
    before it shuffles."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__n", n).where(F.col("__n") <= skip + take).where(F.col("__n") > skip).drop("__n")


def any_verdict(rows: DataFrame, by: Sequence[str], kind: str, kinds: Sequence[str], wanted: str) -> DataFrame:
    """Counts of each kind by group, and found: whether any is the wanted one."""
    counts = [F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    return rows.groupBy(*by).agg(*counts, (F.count_if(F.col(kind) == wanted) > 0).alias("found"))
