"""Queries of identities, plans of work, path gates and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshquarry.functions import canonical
from meshquarry.operators import plans, relational, spatial
from meshquarry.plans import bind, catalog
from meshquarry.plans.bind import table
from meshquarry.plans.catalog import _GRID, _STATUS, TILE, part_shape, query
from meshquarry.sources import exports


@query("""SELECT o_orderkey, sha256('{"body":{"c":' || CAST(round(o_totalprice * 100) AS BIGINT) || ',"s":"' || o_orderstatus || '"},"links":[' || o_custkey || ',null],"o_orderkey":' || o_orderkey
  || ',"tags":{"a":' || o_custkey % 7 || ',"b":null}}') AS identity FROM orders""")
def order_identities(spark, sf_dir):
    """Orders as nested records; the time of day that each holds is no part of what it is."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.create_map(F.lit("b"), F.lit(None).cast("long"), F.lit("a"), (F.col("o_custkey") % 7).cast("long")).alias("tags"),
        F.struct(F.col("o_orderstatus").alias("s"), F.current_timestamp().alias("read_at"), cents.cast("double").alias("c")).alias("body"), F.array("o_custkey", F.lit(None)).alias("links"),
    )
    return canonical.identified(rows, without=["read_at"]).select("o_orderkey", "identity")


@query("""SELECT event_id, sha256('{"p":' || replace(props, ' ', '') || ',"v":{"a":[' || user_id || ',{"k":1,"t":"' || event_type || '"}],"z":' || event_id || '}}') AS identity FROM events""")
def props_identities(spark, sf_dir):
    """JSON texts with keys in another order, spaces and a key that does not count."""
    text = F.format_string('{"v": {"z": %d, "a": [%d, {"t": "%s", "k": 1.0}], "seen": 1}, "seen": "%s", "p": %s}', "event_id", "user_id", "event_type", F.col("ts").cast("string"), "props")
    return table(spark, sf_dir, "events").select("event_id", F.sha2(canonical.canonical_text(text, ["seen"]), 256).alias("identity"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey, sha256('{"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || '}') AS id FROM lineitem),
b AS (SELECT l_suppkey, id[1:4] AS bucket, count(*) AS n, sha256(string_agg(id, '' ORDER BY id)) AS d FROM e GROUP BY 1, 2)
SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY bucket)) AS digest FROM b GROUP BY 1""")
def edge_set_digests(spark, sf_dir):
    return canonical.set_digests(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey", "l_orderkey")


@query(f"""WITH {_GRID} SELECT 'CHUNK-' || (10000001 + tile) AS id, greatest(z0 - 4, 0) AS rz0, least(z1 + 4, nz) AS rz1, greatest(y0 - 8, 0) AS ry0, least(y1 + 8, ny) AS ry1, greatest(x0 - 8, 0) AS rx0, least(x1 + 8, nx) AS rx1,
  array_to_string(list_sort(list_filter([CASE WHEN iz > 0 THEN 'CHUNK-' || (10000001 + tile - ty * tx) END, CASE WHEN iz < tz - 1 THEN 'CHUNK-' || (10000001 + tile + ty * tx) END, CASE WHEN iy > 0 THEN 'CHUNK-' || (10000001 + tile - tx) END,
    CASE WHEN iy < ty - 1 THEN 'CHUNK-' || (10000001 + tile + tx) END, CASE WHEN ix > 0 THEN 'CHUNK-' || (10000001 + tile - 1) END, CASE WHEN ix < tx - 1 THEN 'CHUNK-' || (10000001 + tile + 1) END], lambda v: v IS NOT NULL)), ',') AS neighbours FROM grid""")
def chunk_plan(spark, sf_dir):
    shape = part_shape(spark, sf_dir)
    rows = plans.chunks(spatial.tiles(spark, shape, TILE), shape, TILE, (4, 8, 8))
    return rows.select("id", *(f"r{a}{k}" for a in "zyx" for k in (0, 1)), F.array_join("neighbours", ",").alias("neighbours"))


@query(f"""{_STATUS} SELECT tile, CASE status WHEN 'absent' THEN 'compute' ELSE 'recover' END AS action, round(CASE status WHEN 'absent' THEN 1.0 ELSE 0.5 END * voxels / (SELECT max(voxels) FROM m), 9) AS priority
FROM m WHERE status IN ('absent', 'O')""")
def repair_worklist(spark, sf_dir):
    rows = plans.worklist(catalog._status(spark, sf_dir), {"absent": ("compute", 1.0), "O": ("recover", 0.5)})
    return rows.select("tile", "action", F.round("priority", 9).alias("priority"))


_EXPOSED = """WITH e AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS edge FROM lineitem), v AS (SELECT DISTINCT o_custkey % 60 AS source, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 200 END AS edge FROM orders)
SELECT source, edge, CASE WHEN EXISTS (FROM v WHERE v.source = e.source AND v.edge = e.edge) THEN 'reviewed' WHEN source IN (SELECT source FROM v) THEN 'presented' ELSE 'generated' END AS state FROM e"""


@query(f"SELECT *, CASE state WHEN 'generated' THEN 0 ELSE 12 END AS radius FROM ({_EXPOSED})")
def exposure_states(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("edge"))
    events = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).alias("source"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 200).alias("edge"))
    return plans.exposure(edges, events, "source", ["edge"])


_PATHS = f"""WITH {bind.VOXELS}, n AS (SELECT l_suppkey AS path, l_partkey % 100 AS block, l_linenumber % 5 AS z, l_suppkey % 4 AS y, l_orderkey % 4 AS x FROM lineitem),
c AS (SELECT path, label, count(*) AS k FROM n LEFT JOIN (SELECT * FROM voxels WHERE label > 0) v USING (block, z, y, x) GROUP BY 1, 2),
p AS (SELECT path, CAST(sum(k) AS BIGINT) AS nodes, arg_max(label, (k, -label)) FILTER (WHERE label IS NOT NULL) AS dominant, coalesce(max(k) FILTER (WHERE label IS NOT NULL) / sum(k), 0) AS coverage, count(label) AS labels FROM c GROUP BY 1)"""


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 100).alias("block"), (F.col("l_linenumber") % 5).alias("z"), (F.col("l_suppkey") % 4).alias("y"), (F.col("l_orderkey") % 4).alias("x")
    )


@query(f"{_PATHS} SELECT path, nodes, dominant, round(coverage, 9) AS coverage, labels, coverage >= 0.35 AS passed FROM p")
def path_labels(spark, sf_dir):
    rows = plans.path_labels(_nodes(spark, sf_dir), bind.voxels(spark, sf_dir), ["block", "z", "y", "x"], 0.35)
    return rows.withColumn("coverage", F.round("coverage", 9))


@query(f"""{_PATHS}, o AS (SELECT label, count(DISTINCT path) AS n FROM c WHERE label IS NOT NULL GROUP BY 1), g AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS merges FROM o)
SELECT count(*) AS paths, round(avg(coverage), 9) AS coverage, any_value(merges) AS merges, bool_and(coverage >= 0.35) AND any_value(merges) <= 0 AS passed FROM p, g""")
def path_gate(spark, sf_dir):
    return plans.path_gate(_nodes(spark, sf_dir), bind.voxels(spark, sf_dir), ["block", "z", "y", "x"], 0.35).withColumn("coverage", F.round("coverage", 9))


_GRAPH = "WITH e AS (SELECT l_suppkey AS pre, l_partkey AS post, count(*) AS n FROM lineitem GROUP BY 1, 2), nodes AS (SELECT pre AS id FROM e UNION SELECT post FROM e)"


def _links(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pre"), F.col("l_partkey").alias("post"), F.lit(1).alias("n"))


def _graph(spark, sf_dir):
    edges = relational.dealt(_links(spark, sf_dir), "pre", "post").groupBy("pre", "post").agg(F.sum("n").alias("n")).withColumn("id", F.concat_ws("-", "pre", "post"))
    return edges.select(F.explode(F.array("pre", "post")).alias("id")).distinct(), edges


@query(f"""{_GRAPH} SELECT 2 AS part, '<node id="' || id || '"/>' AS line FROM nodes UNION ALL SELECT 3, '<edge id="' || pre || '-' || post || '" source="' || pre || '" target="' || post || '"><data key="n">' || n || '</data></edge>' FROM e
UNION ALL SELECT 0, '<?xml version="1.0" encoding="UTF-8"?>' UNION ALL SELECT 4, '</graph></graphml>'
UNION ALL SELECT 1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="n" for="edge" attr.name="n" attr.type="long"/><graph edgedefault="directed">'""")
def graph_lines(spark, sf_dir):
    return exports.graphml(*_graph(spark, sf_dir)).select("part", "line")


@query(f"{_GRAPH} SELECT pre || ',' || post || ',' || n AS line FROM e UNION ALL SELECT 'pre,post,n'")
def adjacency_lines(spark, sf_dir):
    return exports.adjacency(_links(spark, sf_dir)).select("line")
