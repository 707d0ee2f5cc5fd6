"""Picks with quotas: several ordered queues of a group take turns, and no two picks of a group are near each other."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquarry.functions import boxes
from meshquarry.operators.ranking import top_each
from meshquarry.operators.spatial import clear_of, far_from, separated
from meshquarry.storage import cut

#: Candidates of one queue that a round shows to its group's task.
HEAD = 512
_STEP = "__g string, id long, turn int, z double, y double, x double"


def with_quotas(points: DataFrame, group: str, kind: str, kinds: Sequence[str], quota: int, radius: float, cyclic: bool = True, head: int = HEAD) -> DataFrame:
    """The points (group, kind, id, score, z, y, x), with their turn, that a walk in turns picks in each group. A turn belongs to one
    kind: in cyclic order the kinds take turns, `quota` each; else a kind has all its turns before the next. In its turn a kind
    picks its best point, by score, then the smallest id, that is no closer than `radius` to any pick of the group, of whatever
    kind; a kind that has none left passes. So a kind may stay below its quota; count the rows to see it.

    Ids are numbers, unique within a group; rows of other kinds, and rows with a null but for the group, are left out; a null
    group is a group of its own.

    Each round shows a group's task the first `head` of every queue, never more. Where a queue's shown part ends before its turn is
    settled, the walk stops, and goes on in the next round from the rest, without what is near a pick. A stopped group has picked
    in its round, so there are at most as many rounds as turns; nearly always one or two.
    """
    if radius <= 0 or quota < 0 or head < 1:
        raise ValueError("the radius and the head must be positive, the quota not negative")
    kinds, turns = list(kinds), quota * len(kinds)

    def walk(key: tuple, shown: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        stopped = before[before["id"].isna()]
        used = before[before["id"].notna()][["z", "y", "x"]].to_numpy(float)
        queues, more = [], []
        for k in kinds:
            q = shown[shown["__kind"] == k].sort_values(["score", "id"], ascending=[False, True])
            queues.append(q.iloc[:head])
            more.append(len(q) > head)
        at = [q[["z", "y", "x"]].to_numpy(float) for q in queues]
        free = [np.ones(len(q), bool) for q in queues]

        def take(place: np.ndarray) -> None:
            for places, open_ in zip(at, free, strict=True):
                open_ &= ((places - place) ** 2).sum(1) >= radius * radius

        for place in used:
            take(place)
        out, t = [], int(stopped["turn"].iloc[0]) if len(stopped) else 0
        while t < turns:
            c = t % len(kinds) if cyclic else t // quota
            if free[c].any():
                i = int(free[c].argmax())
                out.append((key[0], int(queues[c]["id"].iloc[i]), t, *at[c][i]))
                take(at[c][i])
                free[c][i] = False
            elif more[c]:
                break
            t += 1
        rows = pd.DataFrame(out, columns=["__g", "id", "turn", "z", "y", "x"]).astype({"id": "Int64"})
        return pd.concat([rows, pd.DataFrame({"__g": [key[0]], "id": pd.array([None], "Int64"), "turn": [t], "z": [0.0], "y": [0.0], "x": [0.0]})])

    spark, own = points.sparkSession, F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    whole = points.dropna(subset=["id", "score", *boxes.AXES]).where(F.col(kind).cast("string").isin(kinds))
    plain = [F.col(c).cast("double").alias(c) for c in ("score", *boxes.AXES)]
    rest = whole.select(own.alias("__g"), F.col(kind).cast("string").alias("__kind"), F.col("id").cast("long").alias("id"), *plain)
    state = spark.createDataFrame([], _STEP)
    picked = state
    while turns:
        shown = top_each(rest, head + 1, ["__g", "__kind"], F.desc("score"), F.asc("id")).drop("rank")
        step = cut(shown.groupBy("__g").cogroup(state.groupBy("__g")).applyInPandas(walk, _STEP))
        picked = picked.unionByName(step.where("id IS NOT NULL"))
        stopped = step.where(f"id IS NULL AND turn < {turns}")
        if stopped.isEmpty():
            break
        going = stopped.select("__g")
        state = cut(picked.join(going, "__g", "left_semi").unionByName(stopped))
        rest = cut(clear_of(rest.join(going, "__g", "left_semi"), step.where("id IS NOT NULL"), radius))
    turn = picked.select("__g", F.col("id").alias("__id"), "turn")
    rows = whole.withColumns({"__g": own, "__id": F.col("id").cast("long")})
    return rows.join(turn, ["__g", "__id"]).select(*points.columns, "turn")


def raster_separated(points: DataFrame, group: str, radius: float) -> DataFrame:
    """Of points (group, id, z, y, x), by group, the ones kept by a walk in raster order (z, then y, then x, then id), each at least
    `radius` from all kept before. Places are whole numbers from 0 to 2,097,151 along each axis."""
    bits = F.col("z").cast("decimal(20,0)") * F.lit(2**42) + F.col("y").cast("decimal(20,0)") * F.lit(2**21) + F.col("x").cast("decimal(20,0)")
    return separated(points.withColumn("score", -bits), group, radius).select(*points.columns)


def centre_of_each(points: DataFrame, group: str, pinned: DataFrame, radius: float, least: float, seed: str) -> DataFrame:
    """One point (group, id, score, step, z, y, x) a group: of the centres that `separated` keeps, those with a step of at least
    `least` and no pinned place (z, y, x) nearer than the radius, the one with the smallest SHA-256 of `seed|group|id`. A group
    without such a centre has no row."""
    kept = far_from(separated(points, group, radius).where(F.col("step") >= least), pinned, radius)
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(group).cast("string"), F.lit("")), F.col("id").cast("string")), 256)
    row = F.struct(*(F.col(c) for c in points.columns if c != group))
    return kept.groupBy(group).agg(F.min_by(row, digest).alias("__row")).select(group, "__row.*")


def presented(rows: DataFrame, seed: str, key: Column) -> DataFrame:
    """Rows with `order_key`: sorting by it gives an order that the seed alone decides."""
    return rows.withColumn("order_key", F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string")), 256))
