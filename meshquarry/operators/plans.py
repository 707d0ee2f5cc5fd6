"""Plans of work over tiles: chunks to read with their neighbours, what is to be done again, and who has seen which edge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshquarry.functions import boxes, keys
from meshquarry.operators.spatial import with_halo

Triple = tuple[int, int, int]
#: Voxels around an edge that count as seen, by exposure. Fixed values.
RADIUS = {"reviewed": 12, "presented": 12, "generated": 0}


def chunks(grid: DataFrame, shape: Triple, size: Triple, halo: Triple, prefix: str = "CHUNK-", first: int = 10_000_001) -> DataFrame:
    """Tiles as chunks of work: an id, the core (z0 ...), the box to read (rz0 ...), and the sorted ids of the chunks that share a
    face. Ids run along x first, then y, then z; neighbours come by arithmetic, without a join."""
    n = [-(-a // b) for a, b in zip(shape, size, strict=True)]
    step = {"z": n[1] * n[2], "y": n[2], "x": 1}
    serial = lambda tile: keys.serial_id(prefix, tile + first)
    beside = []
    for axis, whole in zip(boxes.AXES, n, strict=True):
        at = F.col(f"i{axis}")
        beside += [F.when(at > 0, serial(F.col("tile") - step[axis])), F.when(at < whole - 1, serial(F.col("tile") + step[axis]))]
    return with_halo(grid, shape, size, halo).withColumns({"id": serial(F.col("tile")), "neighbours": F.array_sort(F.array_compact(F.array(*beside)))})


def worklist(tiles: DataFrame, actions: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Of tiles (tile, status, voxels, ...) those whose status asks for an action, with it and a priority: the status's weight times the
    share of the largest tile that this one has. Statuses without an action need nothing."""
    told = F.create_map(*(F.lit(v) for pair in actions.items() for v in (pair[0], pair[1][0]))) if actions else F.lit(None).cast("map<string,string>")
    weight = F.create_map(*(v for k, (_, w) in actions.items() for v in (F.lit(k), F.lit(float(w))))) if actions else F.lit(None).cast("map<string,double>")
    rows = tiles.withColumn("action", told[F.col("status")]).where("action IS NOT NULL")
    most = tiles.agg(F.max("voxels").alias("__most"))
    return rows.join(F.broadcast(most)).withColumn("priority", weight[F.col("status")] * F.col("voxels") / F.col("__most")).drop("__most")  # one row


def exposure(edges: DataFrame, events: DataFrame, source: str, edge: Sequence[str]) -> DataFrame:
    """The edges (source, edge...) with state and radius: `reviewed` where an event is about the edge, `presented` where its source has
    events at all, `generated` else. Events without an edge show that the source was opened. Equal edges of a source give one row."""
    seen = events.select(source, *edge).dropna().distinct().withColumn("__seen", F.lit(True))
    opened = events.select(source).dropna().distinct().withColumn("__open", F.lit(True))
    rows = edges.select(source, *edge).distinct().join(seen, [source, *edge], "left").join(opened, source, "left")
    state = F.when(F.col("__seen"), "reviewed").when(F.col("__open"), "presented").otherwise("generated")
    radius = F.when(F.col("state") == "reviewed", RADIUS["reviewed"]).when(F.col("state") == "presented", RADIUS["presented"]).otherwise(RADIUS["generated"])
    return rows.withColumn("state", state).withColumn("radius", radius).drop("__seen", "__open")


def path_labels(nodes: DataFrame, voxels: DataFrame, place: Sequence[str], least: float) -> DataFrame:
    """(path, nodes, dominant, coverage, labels, passed): of the nodes (path, place...) of each path, the label that most of them lie
    in, the smaller of equals, and its share of all nodes. Nodes outside the voxels (place..., label) or on background (0 or less) lie in
    none. Nodes are counted by path and label before paths meet, so a long path is no task's alone."""
    held = voxels.where("label > 0").select(*place, "label")
    by = nodes.join(held, list(place), "left").groupBy("path", "label").agg(F.count("*").alias("__n"))
    known = F.col("label").isNotNull()
    best = F.max(F.when(known, F.struct("__n", -F.col("label")))).alias("__best")
    out = by.groupBy("path").agg(F.sum("__n").alias("nodes"), F.count("label").alias("labels"), best)
    out = out.withColumns({"dominant": -F.col("__best")["col2"], "coverage": F.coalesce(F.col("__best.__n") / F.col("nodes"), F.lit(0.0))})
    return out.select("path", "nodes", "dominant", "coverage", "labels", (F.col("coverage") >= least).alias("passed"))


def path_gate(nodes: DataFrame, voxels: DataFrame, place: Sequence[str], least: float, most_merges: int = 0) -> DataFrame:
    """One row: paths, mean coverage, merges (pairs of paths that share a label, counted a label), and passed: there are paths, all pass,
    and merges are no more than allowed."""
    paths = path_labels(nodes, voxels, place, least).agg(F.count("*").alias("paths"), F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("coverage"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("__all"))
    owners = nodes.join(voxels.where("label > 0").select(*place, "label"), list(place)).select("label", "path").distinct().groupBy("label").agg(F.count("path").alias("n"))
    merges = owners.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("merges"))
    return paths.join(F.broadcast(merges)).select("paths", "coverage", "merges", (F.col("__all") & (F.col("merges") <= most_merges)).alias("passed"))  # one row each
