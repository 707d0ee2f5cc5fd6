"""Objects on either side of the seam between two tiles that were labelled apart, and how well they match."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquarry.operators import rules, spatial
from meshquarry.storage import cut

#: A direction stands out where the largest variance exceeds the next one by this share of all.
STANDS_OUT = 1e-6


def _axes(covariance: pd.Series) -> pd.Series:
    if not len(covariance):
        return pd.Series([], dtype=object)
    values, vectors = np.linalg.eigh(np.stack(covariance.to_list())[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))
    axis, total = vectors[:, :, 2], values.sum(1)
    first = np.take_along_axis(axis, (np.abs(axis) > 1e-9).argmax(1)[:, None], 1)
    clear = (total > 0) & (values[:, 2] - values[:, 1] > STANDS_OUT * total)
    return pd.Series([v if ok else None for v, ok in zip((axis * np.sign(first)).tolist(), clear.tolist(), strict=True)])


def major_axis(covariance: Column) -> Column:
    """Of symmetric 3 x 3 matrices, each as (zz, zy, zx, yy, yx, xx), the unit vector (z, y, x) of the largest eigenvalue, its first
    component that isn't zero positive; null where no one direction stands out, as for a single point."""
    return F.pandas_udf(_axes, "array<double>")(covariance)


def slab(voxels: DataFrame, axis: str, at: Column, depth: int) -> DataFrame:
    """The voxels within `depth` of a plane across an axis, on either side."""
    return voxels.where((F.col(axis) >= at - depth) & (F.col(axis) < at + depth))


def face_objects(voxels: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, n, centre cz, cy, cx, inclusive box z0 ... x1, axis): a row an object, its direction by its voxels' covariance.
    Sums alone are shuffled. voxels: (keys, z, y, x, label), label 0 left out."""
    box = [f(F.col(a)).alias(f"{a}{k}") for a in "zyx" for f, k in ((F.min, 0), (F.max, 1))]
    pairs = [(a, b) for i, a in enumerate("zyx") for b in "zyx"[i:]]
    # sums of whole numbers are exact, whatever their order
    sums = [F.sum(F.col(a).cast("long")).alias(f"__{a}") for a in "zyx"] + [F.sum(F.col(a).cast("long") * F.col(b).cast("long")).alias(f"__{a}{b}") for a, b in pairs]
    by = voxels.where("label <> 0").groupBy(*keys, "label").agg(F.count("*").alias("n"), *box, *sums)
    cov = [(F.col(f"__{a}{b}") * F.col("n") - F.col(f"__{a}") * F.col(f"__{b}")) / (F.col("n") * F.col("n")) for a, b in pairs]
    axis = major_axis(F.array(*cov))
    return by.select(*keys, "label", "n", *((F.col(f"__{a}") / F.col("n")).alias(f"c{a}") for a in "zyx"), *(f"{a}{k}" for a in "zyx" for k in (0, 1)), axis.alias("axis"))


def shared_voxels(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys, a_id, b_id, shared): how many voxels of the world two objects (keys, label, z, y, x) have in common."""
    one, two = (df.where("label <> 0").select(*keys, *"zyx", F.col("label").alias(c)) for df, c in ((a, "a_id"), (b, "b_id")))
    return one.join(two, [*keys, *"zyx"]).groupBy(*keys, "a_id", "b_id").agg(F.count("*").alias("shared"))


def matches(a: DataFrame, b: DataFrame, halo: int, cell: tuple[int, int, int]) -> DataFrame:
    """(a_id, b_id, shared, overlap, ratio, iou, distance, direction, confidence, action) of objects of two sides, voxels
    (label, z, y, x) of a seam's slab, labels unlike over all seams, whose boxes are less than `halo` apart.

    overlap: shared voxels over the smaller object; ratio: the smaller size over the larger; direction: the absolute cosine
    of their axes, 0 where one has none. Boxes meet in grid cells of the size `cell`; others are never compared."""
    # Pairs outnumber the objects by far: what is told of an object, voxels shared with others too, goes along with its box.
    shared = shared_voxels(a, b).groupBy(F.col("a_id").alias("label")).agg(F.map_from_entries(F.collect_list(F.struct("b_id", "shared"))).alias("shared"))
    oa, ob = cut(face_objects(a).join(shared, "label", "left")), cut(face_objects(b).withColumn("shared", F.lit(None).cast("map<bigint,bigint>")))
    told = [c for c in ob.columns if c != "label"]
    box = lambda df: df.select(F.col("label").alias("id"), *((F.col(f"{x}{k}") + k).cast("long").alias(f"{x}{k}") for x in "zyx" for k in (0, 1)), *(F.col(c).alias(f"o_{c}") for c in told))
    near = spatial.box_pairs(box(oa), box(ob), cell, halo, carry=[f"o_{c}" for c in told])
    rows = near.select("a_id", "b_id", *(F.col(f"{p}_o_{c}").alias(f"{p}_{c}") for p in "ab" for c in told)).withColumn("shared", F.coalesce(F.try_element_at("a_shared", F.col("b_id")), F.lit(0)))
    square = reduce(Column.__add__, ((F.col(f"a_c{x}") - F.col(f"b_c{x}")) * (F.col(f"a_c{x}") - F.col(f"b_c{x}")) for x in "zyx"))
    dot = reduce(Column.__add__, (F.get("a_axis", F.lit(i)) * F.get("b_axis", F.lit(i)) for i in range(3)))
    low, high = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    figures = {"overlap": F.col("shared") / low, "ratio": low / high, "iou": rules.inclusive_iou("a_", "b_"), "distance": F.sqrt(square), "direction": F.coalesce(F.least(F.abs(dot), F.lit(1.0)), F.lit(0.0))}
    rows = rows.withColumns({c: F.round(v, 9) for c, v in figures.items()}).withColumn("morphology", F.round(0.5 * F.col("ratio") + 0.5 * F.col("iou"), 9))
    rows = rows.withColumn("confidence", F.round(rules.seam_confidence(*(F.col(c) for c in ("overlap", "direction", "morphology", "distance")), halo), 9))
    action = rules.seam_action(*(F.col(c) for c in ("confidence", "overlap", "morphology", "ratio", "distance", "direction")), halo)
    return rows.select("a_id", "b_id", "shared", "overlap", "ratio", "iou", "distance", "direction", "confidence", action.alias("action"))


def reviewed(pairs: DataFrame) -> DataFrame:
    """The matches left to review, with the evidence on both as branches: shares for a merge and for a split, and the decision. The
    overlap stands for the segmentation, the boxes' agreement for the image, the seam's confidence for the model."""
    shares = rules.branch_sums(F.col("distance"), F.col("direction"), F.col("ratio"), F.col("overlap"), F.col("iou"), F.col("confidence"))
    rows = pairs.where("action = 'REVIEW'").withColumns({c: F.round(v, 9) for c, v in zip(("merge_share", "split_share"), shares, strict=True)})
    return rows.withColumn("decision", rules.branch_decision(F.col("merge_share"), F.col("split_share"), F.col("overlap")))
