"""Components, levels and trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.storage import cut, stored

#: Rows of a forest that a task holds at a time.
CHUNK = 1 << 17


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), root the smallest node of its component; roots map to themselves.

    Alternating large and small stars (Kiveris et al., 2014). A round is two grouped minima (combined before the shuffle, so
    a hub is no hot group) and two joins, which adaptive execution splits where a hub is skewed. No group is collected; each
    round ends in the shared checkpoint folder. Ends when a round changes nothing, after about the logarithm of the longest
    chain. Rows with a null or with a = b link nothing; an empty table gives an empty one.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while (now := e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != mark:
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def levels(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(node, level): the fewest steps along directed edges (a, b) from any seed (node), until nothing new is reached, or up to
    `most` steps where that is asked for. A frontier join a level, against what has been reached; cycles end by themselves."""
    reached = cut(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    frontier = reached
    for level in count(1) if most is None else range(1, most + 1):
        step = frontier.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = cut(step.join(reached, "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        reached = cut(reached.unionByName(frontier))
    return reached


def ancestors(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(node, level) of what leads to any seed, the seeds left out: levels() against the edges."""
    return levels(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), seeds, most).where("level > 0")


def descendants(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    return levels(edges, seeds, most).where("level > 0")


def tree_edges(nodes: DataFrame) -> DataFrame:
    """(tree, child, parent, length) of nodes (tree, node, parent, z, y, x); nodes whose parent is absent have none."""
    up = nodes.select("tree", F.col("node").alias("parent"), *(F.col(a).alias(f"p{a}") for a in "zyx"))
    length = F.sqrt(sum(((F.col(a) - F.col(f"p{a}")) * (F.col(a) - F.col(f"p{a}")) for a in "yx"), (F.col("z") - F.col("pz")) * (F.col("z") - F.col("pz"))))
    return nodes.join(up, ["tree", "parent"]).select("tree", F.col("node").alias("child"), "parent", length.alias("length"))


def tree_figures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a tree: nodes, edges, branch points (more than one child), ends (no child), cable length."""
    children = edges.groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    by = nodes.join(children, ["tree", "node"], "left").groupBy("tree").agg(F.count("*").alias("nodes"), F.count_if(F.col("children") > 1).alias("branches"), F.count_if(F.col("children").isNull()).alias("ends"))
    cable = edges.groupBy("tree").agg(F.count("*").alias("edges"), F.sum("length").alias("cable"))
    return by.join(cable, "tree", "left").select("tree", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "branches", "ends", F.coalesce("cable", F.lit(0.0)).alias("cable"))


def _chains(parent: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that point at others (-1: at none), the last row of each one's chain, and the steps and length of the way there."""
    ends = parent < 0
    at, steps, way = np.where(ends, np.arange(len(parent)), parent), np.where(ends, 0, 1), np.where(ends, 0.0, length)
    for _ in range(len(parent).bit_length() + 1):
        steps, way, at = steps + steps[at], way + way[at], at[at]
    return at, steps, way


def _meets(parent: np.ndarray, steps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the chains of rows a and b first meet, -1 where they don't; steps are those to the chains' ends."""
    leaps = [np.where(parent < 0, np.arange(len(parent)), parent)]
    while len(leaps) < int(steps.max(initial=0)).bit_length():
        leaps.append(leaps[-1][leaps[-1]])
    a, b = np.where(steps[a] >= steps[b], a, b), np.where(steps[a] >= steps[b], b, a)
    for k in reversed(range(len(leaps))):
        a = np.where(steps[a] - steps[b] >= 1 << k, leaps[k][a], a)
    for k in reversed(range(len(leaps))):
        go = leaps[k][a] != leaps[k][b]
        a, b = np.where(go, leaps[k][a], a), np.where(go, leaps[k][b], b)
    up = leaps[0][a]
    return np.where(a == b, a, np.where(up == leaps[0][b], up, -1))


def _within(rows: pd.DataFrame, nodes: pd.DataFrame) -> np.ndarray:
    """The places of nodes (tree, node) among rows (tree, child), -1 where they aren't there."""
    at = rows[["tree", "child"]].drop_duplicates().set_axis(["tree", "node"], axis=1).reset_index(names="at")
    return nodes.merge(at, on=["tree", "node"], how="left")["at"].fillna(-1).to_numpy(np.int64)


def contracted(edges: DataFrame) -> DataFrame:
    """Of a forest (tree, child, parent, length) its rows with chunk, up, steps, way: chunks are at most CHUNK rows that follow each
    other by tree and child, up is the first ancestor that is no child of its chunk, and steps and way lead there. Where parents
    are near their children in that order, few nodes are any row's `up`. Ends in the shared folder; cycles are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, number = TaskContext.get().partitionId() << 32, [], 0

        def chunk() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True)
            parent = _within(rows, rows[["tree", "parent"]].set_axis(["tree", "node"], axis=1))
            last, steps, way = _chains(parent, rows["length"].to_numpy(np.float64))
            cycle = parent[last] >= 0
            return rows.assign(chunk=part + number, up=rows["parent"].to_numpy()[last], steps=np.where(cycle, -1, steps + 1), way=way + rows["length"].to_numpy()[last])

        for pdf in batches:
            while len(pdf):
                room = CHUNK - sum(map(len, held))
                held.append(pdf.iloc[:room])
                pdf = pdf.iloc[room:]
                if sum(map(len, held)) == CHUNK:
                    yield chunk()
                    held, number = [], number + 1
        if held:
            yield chunk()

    kind = {c: edges.schema[c].dataType.simpleString() for c in ("tree", "child")}
    rows = edges.select("tree", "child", "parent", F.col("length").cast("double").alias("length"))
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "tree", "child").sortWithinPartitions("tree", "child")
    schema = f"tree {kind['tree']}, child {kind['child']}, parent {kind['child']}, length double, chunk long, up {kind['child']}, steps long, way double"
    rows = stored(rows.mapInPandas(run, schema), "contracted")
    if not rows.where("steps < 0").isEmpty():
        raise ValueError("the edges hold a cycle")
    return rows


def lifted(edges: DataFrame) -> list[DataFrame]:
    """Of a forest (tree, child, parent, length), tables (tree, node, up, steps, way): each node's ancestor 1, 2, 4, ... leaps above
    it and the steps (those of a leap where `edges` has them, else one) and length of the way there, as far as there is any. A
    table is the one before joined with itself, so a chain of a million nodes takes twenty. Each ends in the shared folder. A
    node has one parent at most; cycles are refused, since the tables would never end."""
    steps = F.col("steps") if "steps" in edges.columns else F.lit(1).cast("long").alias("steps")
    table = cut(edges.select("tree", F.col("child").alias("node"), F.col("parent").alias("up"), steps, F.col("length").alias("way")))
    nodes, tables = table.count(), []
    while not table.isEmpty():
        if 1 << len(tables) > nodes:
            raise ValueError("the edges hold a cycle")
        tables.append(table)
        on = table.select("tree", F.col("node").alias("up"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("way").alias("__way"))
        table = cut(table.join(on, ["tree", "up"]).select("tree", "node", F.col("__up").alias("up"), (F.col("steps") + F.col("__steps")).alias("steps"), (F.col("way") + F.col("__way")).alias("way")))
    return tables


def rooted(nodes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(tree, node, root, leaps, depth, way) of each node (tree, node): the end of its chain of parents, in leaps, steps and length.
    From the longest leaps to the shortest."""
    at = nodes.select("tree", "node").distinct().withColumns({"root": F.col("node"), "leaps": F.lit(0).cast("long"), "depth": F.lit(0).cast("long"), "way": F.lit(0.0)})
    for k in reversed(range(len(tables))):
        leap = tables[k].select("tree", F.col("node").alias("root"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("way").alias("__way"))
        far = at.join(leap, ["tree", "root"], "left")
        at = cut(far.select("tree", "node", F.coalesce("__up", "root").alias("root"), (F.col("leaps") + F.when(F.col("__up").isNull(), 0).otherwise(1 << k)).alias("leaps"), *((F.col(c) + F.coalesce(f"__{p}", F.lit(0))).alias(c) for c, p in (("depth", "steps"), ("way", "way")))))
    return at


def _entries(held: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Of contracted() rows those that any row's `up` (or one of `more` nodes) has, their lifted() tables, and rooted() of these nodes."""
    ups = held.select("tree", F.col("up").alias("node"))
    places = cut((ups if more is None else ups.unionByName(more)).distinct())
    rows = cut(held.join(places.withColumnRenamed("node", "child"), ["tree", "child"], "left_semi"))
    tables = lifted(rows.select("tree", "child", F.col("up").alias("parent"), "steps", F.col("way").alias("length")))
    return rows, tables, rooted(places, tables)


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tree, node, root, depth, way) of each node (tree, node) of a forest (tree, child, parent, length): the end of its chain of
    parents, in steps and length. Chains are settled within contracted() chunks first; only what they enter by is lifted()."""
    held = contracted(edges)
    _, _, deep = _entries(held)
    own = held.select("tree", F.col("child").alias("node"), "up", "steps", F.col("way").alias("__way"))
    top = deep.select("tree", F.col("node").alias("up"), "root", "depth", "way")
    rows = nodes.select("tree", "node").distinct().join(own, ["tree", "node"], "left").join(top, ["tree", "up"], "left")
    plus = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return rows.select("tree", "node", F.coalesce("root", "node").alias("root"), plus("steps", "depth").alias("depth"), plus("__way", "way").alias("way"))


def _local_meets(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(tree, a, b, __meet, __steps, __way) of rows (chunk, tree, a, b, __a, __b): where __a and __b meet within their chunk, and the
    way from there to its `up`. A task holds one chunk."""
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("tree", "a")}
    names = ["tree", "a", "b", "__meet", "__steps", "__way"]

    def run(pairs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        parent = _within(own, own[["tree", "parent"]].set_axis(["tree", "node"], axis=1))
        _, steps, _ = _chains(parent, own["length"].to_numpy())
        a, b = (_within(own, pairs[["tree", f"__{p}"]].set_axis(["tree", "node"], axis=1)) for p in "ab")
        meet = _meets(parent, steps, a, b)
        found = own.iloc[meet[meet >= 0]]
        return pairs.loc[meet >= 0, ["tree", "a", "b"]].assign(__meet=found["child"].to_numpy(), __steps=found["steps"].to_numpy(), __way=found["way"].to_numpy())[names]

    own = held.join(rows.select("chunk").distinct(), "chunk", "left_semi").select("chunk", "tree", "child", "parent", "length", "steps", "way")
    schema = f"tree {kind['tree']}, a {kind['a']}, b {kind['a']}, __meet {kind['a']}, __steps long, __way double"
    return rows.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInPandas(run, schema)


def paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tree, a, b, meet, steps, length) of each pair of nodes (tree, a, b): their lowest common ancestor and the way over it.
    Pairs under different roots have none and are left out. Both climb over contracted() chunks, in as many joins as the chain of
    chunks has binary digits, twice; where they come to one chunk's exit from the same chunk, they may meet within it."""
    pairs = pairs.select("tree", "a", "b").distinct()
    ends = pairs.select("tree", F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("tree", "node"), ["tree", "node"], "left_semi")
    ends, held = cut(ends), contracted(edges)
    entries, tables, deep = _entries(held, ends)
    end = lambda p: deep.join(ends, ["tree", "node"], "left_semi").select("tree", F.col("node").alias(p), F.col("root").alias(f"{p}_root"), F.col("leaps").alias(f"{p}_leaps"), F.col("depth").alias(f"{p}_depth"), F.col("way").alias(f"{p}_way"))
    rows = pairs.join(end("a"), ["tree", "a"]).join(end("b"), ["tree", "b"]).where("a_root = b_root")
    rows = cut(rows.withColumns({"__a": F.col("a"), "__b": F.col("b"), "__off": F.col("a_leaps") - F.col("b_leaps")}))

    def leap(rows: DataFrame, side: str, k: int, when: Column) -> DataFrame:
        """The ancestor 2^k above that side, where it's asked for."""
        up = tables[k].select("tree", F.col("node").alias(f"__{side}"), F.col("up").alias(f"__{side}_up"))
        return rows.withColumn(f"__{side}_go", when).join(up, ["tree", f"__{side}"], "left")

    for k in reversed(range(len(tables))):  # the deeper one up to the other's depth
        for side, sign in (("a", 1), ("b", -1)):
            rows = leap(rows, side, k, sign * F.col("__off") >= 1 << k)
            rows = rows.withColumns({f"__{side}": F.when(F.col(f"__{side}_go"), F.col(f"__{side}_up")).otherwise(F.col(f"__{side}")), "__off": F.col("__off") - F.when(F.col(f"__{side}_go"), sign * (1 << k)).otherwise(0)})
            rows = rows.drop(f"__{side}_go", f"__{side}_up")
        rows = cut(rows)
    for k in reversed(range(len(tables))):  # both up as long as they don't meet
        rows = leap(leap(rows, "a", k, F.lit(True)), "b", k, F.lit(True))
        go = F.coalesce(F.col("__a_up") != F.col("__b_up"), F.lit(False))
        rows = cut(rows.withColumns({"__a": F.when(go, F.col("__a_up")).otherwise(F.col("__a")), "__b": F.when(go, F.col("__b_up")).otherwise(F.col("__b"))}).drop("__a_go", "__b_go", "__a_up", "__b_up"))
    at = lambda p, *more: entries.select("tree", F.col("child").alias(f"__{p}"), F.col("chunk").alias(f"__{p}_chunk"), *more)
    rows = cut(rows.join(at("a", "up"), ["tree", "__a"], "left").join(at("b"), ["tree", "__b"], "left"))
    inside = rows.where("__a <> __b AND __a_chunk = __b_chunk").withColumnRenamed("__a_chunk", "chunk")
    met = _local_meets(inside.select("chunk", "tree", "a", "b", "__a", "__b"), held)
    exit_ = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("up"))
    top = deep.select("tree", F.col("node").alias("__exit"), F.col("depth").alias("__depth"), F.col("way").alias("__exit_way"))
    rows = rows.withColumn("__exit", exit_).join(top, ["tree", "__exit"]).join(met, ["tree", "a", "b"], "left")
    over = lambda c, e, m: (F.col(f"a_{c}") + F.col(f"b_{c}") - 2 * (F.col(e) + F.coalesce(m, F.lit(0))))
    return rows.select("tree", "a", "b", F.coalesce("__meet", "__exit").alias("meet"), over("depth", "__depth", "__steps").alias("steps"), over("way", "__exit_way", "__way").alias("length"))


def leaf_pairs(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(tree, a, b), a < b: pairs among the `most` smallest ends (nodes without a child) of each tree."""
    ends = nodes.select("tree", "node").distinct().join(edges.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    some = ends.withColumn("__n", F.row_number().over(W.partitionBy("tree").orderBy("node"))).where(F.col("__n") <= most)
    return some.select("tree", F.col("node").alias("a")).join(some.select("tree", F.col("node").alias("b")), "tree").where("a < b")


def tortuosity(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """paths() with straight, the distance between the two nodes (tree, node, z, y, x), and tortuosity, the way over it (null
    where they are at one place)."""
    at = lambda p: nodes.select("tree", F.col("node").alias(p), *(F.col(c).alias(f"{p}{c}") for c in "zyx"))
    rows = paths(pairs, nodes, edges).join(at("a"), ["tree", "a"]).join(at("b"), ["tree", "b"])
    straight = F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "yx"), (F.col("az") - F.col("bz")) * (F.col("az") - F.col("bz"))))
    rows = rows.withColumn("straight", straight).drop(*(f"{p}{c}" for p in "ab" for c in "zyx"))
    return rows.withColumn("tortuosity", F.when(F.col("straight") > 0, F.col("length") / F.col("straight")))


def fork_ratios(edges: DataFrame, least: float) -> DataFrame:
    """(tree, node, ratio): nodes at which three edges end, the longest at least `least` times the shortest."""
    ends = edges.select("tree", F.explode(F.array("child", "parent")).alias("node"), "length")
    by = ends.groupBy("tree", "node").agg(F.count("*").alias("degree"), F.max("length").alias("long"), F.min("length").alias("short"))
    return by.where("degree = 3 AND short > 0").withColumn("ratio", F.col("long") / F.col("short")).where(F.col("ratio") >= least).select("tree", "node", "ratio")
