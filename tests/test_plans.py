"""Plans, path gates, exposure and exports at their edges."""

import xml.etree.ElementTree as ET
from pathlib import Path

from meshquarry.operators import plans, relational, spatial
from meshquarry.plans import plans_catalog
from meshquarry.sources import exports

PLACE = ["z", "y", "x"]


def test_chunks_like_a_walk(spark):
    shape, size = (5, 9, 4), (2, 4, 4)
    got = {r.id: r for r in plans.chunks(spatial.tiles(spark, shape, size), shape, size, (1, 2, 3), "C", 1).collect()}
    n = (3, 3, 1)
    ids = {(z, y, x): f"C{1 + (z * n[1] + y) * n[2] + x:08d}" for z in range(n[0]) for y in range(n[1]) for x in range(n[2])}
    assert set(got) == set(ids.values())
    for (z, y, x), i in ids.items():
        beside = [(z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)]
        assert got[i].neighbours == sorted(ids[b] for b in beside if b in ids)
        assert (got[i].rz0, got[i].rz1, got[i].rx1) == (max(0, z * 2 - 1), min(5, min(5, z * 2 + 2) + 1), 4)


def test_worklist(spark):
    tiles = spark.createDataFrame([(1, "absent", 8), (2, "done", 8), (3, "failed", 2), (4, None, 4)], "tile int, status string, voxels int")
    got = {r.tile: (r.action, r.priority) for r in plans.worklist(tiles, {"absent": ("compute", 1), "failed": ("recover", 0.5)}).collect()}
    assert got == {1: ("compute", 1.0), 3: ("recover", 0.125)}
    assert plans.worklist(tiles, {}).collect() == [] and plans.worklist(tiles.limit(0), {"absent": ("a", 1)}).collect() == []


def test_exposure(spark):
    edges = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("c", 1), (None, 1)], "source string, edge int")
    events = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 1)], "source string, edge int")
    got = sorted(((r.source or "", r.edge, r.state, r.radius) for r in plans.exposure(edges, events, "source", ["edge"]).collect()))
    assert got == [("", 1, "generated", 0), ("a", 1, "reviewed", 12), ("a", 2, "presented", 12), ("b", 1, "presented", 12), ("c", 1, "generated", 0)]


def test_paths_and_their_gate(spark):
    voxels = spark.createDataFrame([(0, 0, x, v) for x, v in enumerate([5, 5, 7, 7, 0, -1])], "z int, y int, x int, label long")
    walk = {"tie": [0, 1, 2, 3], "one": [0, 1, 0, 99], "none": [4, 5, None], "seven": [2, 3]}
    nodes = spark.createDataFrame([(p, 0, 0, x) for p, xs in walk.items() for x in xs], "path string, z int, y int, x int")
    got = {r.path: (r.nodes, r.dominant, r.coverage, r.labels, r.passed) for r in plans.path_labels(nodes, voxels, PLACE, 0.75).collect()}
    assert got == {"tie": (4, 5, 0.5, 2, False), "one": (4, 5, 0.75, 1, True), "none": (3, None, 0.0, 0, False), "seven": (2, 7, 1.0, 1, True)}
    gate = lambda df, merges: tuple(plans.path_gate(df, voxels, PLACE, 0.75, merges).first())
    assert gate(nodes, 9) == (4, 0.5625, 2, False)
    good = nodes.where("path IN ('one', 'seven')")
    assert gate(good, 0) == (2, 0.875, 0, True) and gate(nodes.limit(0), 0) == (0, 0.0, 0, False)
    same = good.unionByName(good.where("path = 'one'").replace("one", "two", "path"))
    assert gate(same, 0) == (3, 2.5 / 3, 1, False) and gate(same, 1)[3]


def test_graphs_are_read_back(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(30)] + [("<&\">",)], "id string")
    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i * 7 % 30}", i) for i in range(30)] + [("x", "<&\">", "n1", 2), ("y", "n3", "n21", 5)], "id string, pre string, post string, n long")
    exports.write_lines(exports.graphml(nodes, edges), str(tmp_path / "g"), 5)
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted(Path(tmp_path / "g").glob("part-*")))
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.fromstring(text.encode())
    assert {n.get("id") for n in root.iter(f"{ns}node")} == {r.id for r in nodes.collect()}
    assert {(e.get("id"), e.get("source"), e.get("target"), int(e[0].text)) for e in root.iter(f"{ns}edge")} == {tuple(r) for r in edges.collect()}
    assert [r.line for r in exports.adjacency(edges).where("key = 'n3,n21' OR part = 0").orderBy("part").collect()] == ["pre,post,n", "n3,n21,8"]


def test_cells_are_added_up_once_by_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(relational, "ROWS_A_TASK", 10)
    edges = spark.createDataFrame([(i % 7, i % 5, 1) for i in range(300)] + [(None, 1, 1), (1, None, 1)], "pre int, post int, n long")
    lines = exports.adjacency(edges)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pre" in plan and ", 30), REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1
    assert sorted(r.line for r in lines.where("part = 1").collect()) == sorted(f"{p},{q},{len([i for i in range(300) if (i % 7, i % 5) == (p, q)])}" for p in range(7) for q in range(5))


def test_links_are_counted_in_one_place(spark):
    """The query gives the export its rows as they are, not groups to group again."""
    plan = plans_catalog.adjacency_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") <= 2 and plan.count("Exchange") == 1
