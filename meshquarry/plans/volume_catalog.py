"""Queries over one growing volume, put together from the blocks of `embeddings`, and over deep trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.operators import blocks as B
from meshquarry.operators import distance, graph, regression, seams, segments
from meshquarry.plans.bind import table
from meshquarry.plans.catalog import query
from meshquarry.sources import arrays, volumes
from meshquarry.storage import scratch, stored

SIZE = (25, 4, 4)


def volume(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, B.Grid]:
    """Blocks (volume, bz, by, bx, value, label, id) of 25 x 4 x 4 voxels: four rows are a layer of 4 x 8 x 8, as many whole layers as
    the table fills. Labels 1 and 2 are the high and the low values; id is the voxel's number."""
    rows = table(spark, sf_dir, "embeddings")
    layers = ((rows.agg(F.max("vec_id")).first()[0] or 0) + 1) // 4
    grid = B.Grid((4 * layers, 8, 8), SIZE)
    voxels = rows.where(F.col("vec_id") < 4 * layers).select("vec_id", F.posexplode("embedding").alias("p", "value")).select(
        F.lit(0).cast("long").alias("volume"), F.expr("vec_id div 4 * 4 + p div 16").alias("z"), F.expr("vec_id div 2 % 2 * 4 + p div 4 % 4").alias("y"), F.expr("vec_id % 2 * 4 + p % 4").alias("x"), F.col("value").cast("double").alias("value"),
    )
    label = F.when(F.col("value") >= 0.12, 1).when(F.col("value") <= -0.12, 2).otherwise(0).cast("long")
    return B.as_blocks(voxels.withColumns({"label": label, "id": F.expr("z * 64 + y * 8 + x")}), grid, "value", "label", "id"), grid


VOLUME = """vol AS (
  SELECT *, (z * 8 + y) * 8 + x AS id FROM (
    SELECT vec_id // 4 * 4 + p // 16 AS z, vec_id // 2 % 2 * 4 + p // 4 % 4 AS y, vec_id % 2 * 4 + p % 4 AS x, value,
           CASE WHEN value >= 0.12 THEN 1 WHEN value <= -0.12 THEN 2 ELSE 0 END AS label
    FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS value, unnest(range(64)) AS p FROM embeddings)
    WHERE vec_id // 4 < (SELECT (max(vec_id) + 1) // 4 FROM embeddings))
)"""
_COMPONENTS = f"""{VOLUME}, step AS (SELECT unnest([1, -1, 0, 0, 0, 0]) AS dz, unnest([0, 0, 1, -1, 0, 0]) AS dy, unnest([0, 0, 0, 0, 1, -1]) AS dx),
link AS (SELECT a.id AS a, b.id AS b FROM (SELECT id, label, z + dz AS z, y + dy AS y, x + dx AS x FROM vol, step WHERE label <> 0) a JOIN vol b USING (z, y, x, label)),
reach(node, other) AS (SELECT id, id FROM vol WHERE label <> 0 UNION SELECT node, b FROM reach JOIN link ON other = a),
first AS (SELECT node AS id, min(other) AS component FROM reach GROUP BY node),
comp AS (SELECT component, label, count(*) AS n FROM first JOIN vol USING (id) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT component, label, n FROM comp")
def volume_components(spark, sf_dir):
    return segments.component_table(*volume(spark, sf_dir), "label").drop("volume")


@query(f"""WITH RECURSIVE {_COMPONENTS}, kept AS (SELECT component AS first, row_number() OVER (ORDER BY component) AS component FROM comp WHERE n >= 4)
SELECT z, y, x, coalesce(k.component, 0) AS component FROM vol LEFT JOIN first f USING (id) LEFT JOIN kept k ON k.first = f.component""")
def volume_relabelled(spark, sf_dir):
    blocks, grid = volume(spark, sf_dir)
    return B.as_voxels(segments.components(blocks, grid, "label", least=4), grid, "component").drop("volume")


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT label, CAST(sum(n) AS BIGINT) AS n, count(*) AS pieces, max(n) AS largest, round(max(n) / sum(n), 9) AS share FROM comp GROUP BY label")
def volume_label_pieces(spark, sf_dir):
    return segments.label_pieces(*volume(spark, sf_dir), "label").drop("volume").withColumn("share", F.round("share", 9))


def flooding(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, B.Grid]:
    """The volume's blocks with level (16 steps of the value), marker (the lowest values, by the voxel's number from 1) and affinity."""
    blocks, grid = volume(spark, sf_dir)
    level = F.transform("value", lambda v: F.least(F.greatest(F.floor((v + 0.5) * 16), F.lit(0)), F.lit(15)).cast("long"))
    marker = F.transform(F.arrays_zip("value", "id"), lambda v: F.when(v["value"] <= -0.27, v["id"] + 1).otherwise(F.lit(0)).cast("long"))
    affinity = F.transform("value", lambda v: F.least(F.greatest(0.5 - v, F.lit(0.0)), F.lit(1.0)))
    return stored(blocks.withColumns({"level": level, "marker": marker, "affinity": affinity}), "flooding"), grid


def basins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, B.Grid]:
    blocks, grid = flooding(spark, sf_dir)
    flood = segments.watershed(blocks, grid, "level", "marker")
    return blocks.select(*B.KEY, "affinity").join(flood, B.KEY), grid


@query()
def volume_watershed(spark, sf_dir):
    blocks, grid = basins(spark, sf_dir)
    return B.as_voxels(blocks, grid, "basin").drop("volume")


@query()
def volume_regions(spark, sf_dir):
    """Basins joined into objects by their mean affinity: a row a basin, with the log odds of its best contact."""
    blocks, grid = basins(spark, sf_dir)
    edges = stored(segments.touching(blocks, grid, "basin", "affinity"), "touching")
    best = edges.select(F.explode(F.array("lo", "hi")).alias("basin"), (F.col("total") / segments.UNIT / F.col("n")).alias("mean")).groupBy("basin").agg(F.max("mean").alias("mean"))
    roots = segments.agglomerated(edges.drop("volume"), least=0.5).withColumnsRenamed({"node": "basin", "root": "object"})
    return roots.join(best, "basin").select("basin", "object", F.round(segments.log_odds(F.col("mean")), 9).alias("log_odds"))


#: Places up to four steps away: every voxel of this volume has one of another label among them.
_NEAR = f"""{VOLUME}, o AS (SELECT * FROM (SELECT a - 4 AS dz, b - 4 AS dy, c - 4 AS dx, (a - 4) * (a - 4) + (b - 4) * (b - 4) + (c - 4) * (c - 4) AS d2 FROM range(9) r(a), range(9) s(b), range(9) t(c)) WHERE d2 <= 16)"""


@query(f"""WITH {_NEAR}, p AS MATERIALIZED (SELECT id, label, z + dz AS z, y + dy AS y, x + dx AS x, d2 FROM vol, o WHERE label <> 0), m AS (SELECT p.id, min(d2) AS d2 FROM p JOIN vol b USING (z, y, x) WHERE b.label <> p.label GROUP BY 1)
SELECT z, y, x, label, CASE WHEN label = 0 THEN 0 ELSE d2 END AS d2 FROM vol LEFT JOIN m USING (id)""")
def volume_distances(spark, sf_dir):
    blocks, grid = volume(spark, sf_dir)
    return B.as_voxels(distance.squared_distances(blocks, grid, "label"), grid, "label", "d2").drop("volume")


_SHAPE = f"""{_COMPONENTS}, o AS (SELECT * FROM (SELECT a - 4 AS dz, b - 4 AS dy, c - 4 AS dx, (a - 4) * (a - 4) + (b - 4) * (b - 4) + (c - 4) * (c - 4) AS d2 FROM range(9) r(a), range(9) s(b), range(9) t(c)) WHERE d2 <= 16),
top AS (SELECT max(z) + 1 AS nz FROM vol), obj AS (SELECT v.*, f.component FROM vol v LEFT JOIN first f USING (id)),
near AS MATERIALIZED (SELECT id, component, z + dz AS z, y + dy AS y, x + dx AS x, d2 FROM obj, o WHERE component IS NOT NULL),
far AS (SELECT n.id, min(n.d2) AS d2 FROM near n JOIN obj b USING (z, y, x) WHERE b.component IS DISTINCT FROM n.component GROUP BY 1),
s AS (SELECT component, z, count(*) AS area, sqrt(max(d2)) AS radius, count_if(z = 0 OR y = 0 OR x = 0 OR z = nz - 1 OR y = 7 OR x = 7) AS edge FROM obj JOIN far USING (id), top GROUP BY 1, 2),
w AS (SELECT *, 2 * sqrt(area / pi()) AS width FROM s),
k AS (SELECT *, CASE WHEN lag(z) OVER c = z - 1 THEN lag(width) OVER c END AS last, row_number() OVER c AS i, count(*) OVER (PARTITION BY component) AS slices,
  max(radius) OVER (PARTITION BY component ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r0, max(radius) OVER (PARTITION BY component ORDER BY z ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r1,
  max(width) OVER (PARTITION BY component ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w0, max(width) OVER (PARTITION BY component ORDER BY z ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS w1
  FROM w WINDOW c AS (PARTITION BY component ORDER BY z))"""


@query(f"""WITH RECURSIVE {_SHAPE} SELECT component, CAST(sum(area) AS BIGINT) AS n, any_value(slices) AS slices, round(max(radius), 9) AS radius, sum(edge) = 0 AS orphan,
 count_if(greatest(width, last) / least(width, last) >= 1.4 AND last IS NOT NULL) AS jumps, count_if(i > 1 AND i < slices AND radius <= 0.8 * least(r0, r1) AND width <= 0.8 * least(w0, w1)) AS necks, sum(area) < 4 AS tiny FROM k GROUP BY 1""")
def volume_morphology(spark, sf_dir):
    """Every component as an object of its own."""
    blocks, grid = volume(spark, sf_dir)
    parts = stored(segments.components(blocks, grid, "label", dense=False), "objects")
    rows = distance.morphology(parts, grid, "component", tiny=4, jump=1.4, neck=0.8)
    return rows.select((F.col("label") - 1).alias("component"), "n", "slices", F.round("radius", 9).alias("radius"), "orphan", "jumps", "necks", "tiny")


_KERNEL = "kern AS (SELECT dz, dy, dx, exp(-2 * (dz * dz + dy * dy + dx * dx)) AS w FROM (SELECT unnest(range(-2, 3)) AS dz), (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx))"


@query(f"WITH {VOLUME}, {_KERNEL} SELECT a.z, a.y, a.x, round(sum(w * b.value) / sum(w), 9) AS smooth FROM (SELECT id, z + dz AS z, y + dy AS y, x + dx AS x, w FROM vol, kern) k JOIN vol b USING (z, y, x) JOIN vol a ON a.id = k.id GROUP BY 1, 2, 3")
def volume_smoothing(spark, sf_dir):
    blocks, grid = volume(spark, sf_dir)
    return B.as_voxels(B.smoothed(blocks, grid, "value", (0.5, 0.5, 0.5), truncate=4.0), grid, "smooth").drop("volume").withColumn("smooth", F.round("smooth", 9))


def _slope(axis: str) -> str:
    w = f"(PARTITION BY {', '.join(c for c in 'zyx' if c != axis)} ORDER BY {axis})"
    near = lambda f, d: f"CASE WHEN {f}({axis}) OVER {w} = {axis} {d} 1 THEN {f}(value) OVER {w} END"
    a, b = near("lag", "-"), near("lead", "+")
    return f"coalesce((({b}) - ({a})) / 2, ({b}) - value, value - ({a}), 0)"


@query(f"WITH {VOLUME} SELECT z, y, x, round(sqrt({' + '.join(f'({_slope(a)}) ** 2' for a in 'zyx')}), 9) AS gradient FROM vol")
def volume_gradient(spark, sf_dir):
    blocks, grid = volume(spark, sf_dir)
    return B.as_voxels(B.gradient(blocks, grid, "value"), grid, "gradient").drop("volume").withColumn("gradient", F.round("gradient", 9))


def deep_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (tree, node, parent, z, y, x): five trees of orders, each hanging from one of the three before it, so as deep as half the
    table."""
    k = F.col("o_orderkey")
    parent = k - 5 * (1 + F.expr("o_orderkey * 7919 div 16 % 3"))
    return table(spark, sf_dir, "orders").select((k % 5).alias("tree"), k.alias("node"), F.when(parent >= 0, parent).alias("parent"), (F.floor("o_totalprice") % 97).cast("double").alias("z"), (F.col("o_custkey") % 89).cast("double").alias("y"), (k * 1299709 % 83).cast("double").alias("x"))


def deep_edges(nodes: DataFrame) -> DataFrame:
    """Lengths in whole 1024ths, whose sums don't depend on their order."""
    return graph.tree_edges(nodes).withColumn("length", F.round(F.col("length") * 1024) / 1024)


_DEEP = """nodes AS (
  SELECT o_orderkey % 5 AS tree, o_orderkey AS node, CASE WHEN o_orderkey - 5 * (1 + o_orderkey * 7919 // 16 % 3) >= 0 THEN o_orderkey - 5 * (1 + o_orderkey * 7919 // 16 % 3) END AS parent,
         CAST(floor(o_totalprice) % 97 AS DOUBLE) AS z, CAST(o_custkey % 89 AS DOUBLE) AS y, CAST(o_orderkey * 1299709 % 83 AS DOUBLE) AS x FROM orders
), te AS (SELECT c.tree, c.node AS child, c.parent, round(sqrt((c.z - p.z) ** 2 + (c.y - p.y) ** 2 + (c.x - p.x) ** 2) * 1024) / 1024 AS length FROM nodes c JOIN nodes p ON c.tree = p.tree AND c.parent = p.node)"""


@query(f"""WITH RECURSIVE {_DEEP}, leaf AS (SELECT tree, node FROM (SELECT tree, node, row_number() OVER (PARTITION BY tree ORDER BY node) AS i FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.tree = n.tree AND te.parent = n.node)) WHERE i <= 12),
up(tree, leaf, node, steps, way) AS (SELECT tree, node, node, 0, 0.0::DOUBLE FROM leaf UNION ALL SELECT u.tree, u.leaf, e.parent, u.steps + 1, u.way + e.length FROM up u JOIN te e ON e.tree = u.tree AND e.child = u.node),
met AS (SELECT a.tree, a.leaf AS a, b.leaf AS b, arg_min(a.node, a.steps) AS meet, min(a.steps + b.steps) AS steps, arg_min(a.way + b.way, a.steps) AS length FROM up a JOIN up b ON a.tree = b.tree AND a.leaf < b.leaf AND a.node = b.node GROUP BY 1, 2, 3)
SELECT m.tree, m.a, m.b, m.meet, CAST(m.steps AS BIGINT) AS steps, round(m.length, 6) AS length, round(m.length / nullif(sqrt((p.z - q.z) ** 2 + (p.y - q.y) ** 2 + (p.x - q.x) ** 2), 0), 6) AS tortuosity
FROM met m JOIN nodes p ON p.tree = m.tree AND p.node = m.a JOIN nodes q ON q.tree = m.tree AND q.node = m.b""")
def leaf_paths(spark, sf_dir):
    nodes = stored(deep_trees(spark, sf_dir), "nodes")
    edges = stored(deep_edges(nodes), "edges")
    rows = graph.tortuosity(graph.leaf_pairs(nodes, edges, 12), nodes, edges)
    return rows.select("tree", "a", "b", "meet", "steps", F.round("length", 6).alias("length"), F.round("tortuosity", 6).alias("tortuosity"))


@query(f"""WITH RECURSIVE {_DEEP}, down(tree, node, root, depth, way) AS (SELECT tree, node, node, 0, 0.0::DOUBLE FROM nodes n WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM nodes p WHERE p.tree = n.tree AND p.node = n.parent)
 UNION ALL SELECT d.tree, e.child, d.root, d.depth + 1, d.way + e.length FROM down d JOIN te e ON e.tree = d.tree AND e.parent = d.node)
SELECT tree, node, root, CAST(depth AS BIGINT) AS depth, round(way, 6) AS way FROM down""")
def tree_depths(spark, sf_dir):
    nodes = deep_trees(spark, sf_dir)
    return graph.depths(nodes, deep_edges(nodes)).withColumn("way", F.round("way", 6))


@query(f"""WITH {_DEEP}, e AS (SELECT tree, unnest([child, parent]) AS node, length FROM te)
SELECT tree, node, round(max(length) / min(length), 9) AS ratio FROM e GROUP BY 1, 2 HAVING count(*) = 3 AND min(length) > 0 AND max(length) / min(length) >= 4""")
def fork_ratios(spark, sf_dir):
    return graph.fork_ratios(deep_edges(deep_trees(spark, sf_dir)), 4.0).withColumn("ratio", F.round("ratio", 9))


# Tiles of 20 layers, each labelled apart with 4 more on either side, and the seams between them.
THICK, HALO = 20, 4
_TILES = f"""{VOLUME}, tops AS (SELECT max(z) // 20 AS last FROM vol), tv AS (SELECT t, id, z, y, x, label FROM vol, (SELECT unnest(range(last + 1)) AS t FROM tops) WHERE label <> 0 AND z >= t * 20 - 4 AND z < t * 20 + 24),
step AS (SELECT unnest([1, -1, 0, 0, 0, 0]) AS dz, unnest([0, 0, 1, -1, 0, 0]) AS dy, unnest([0, 0, 0, 0, 1, -1]) AS dx),
link AS (SELECT a.t, a.id AS a, b.id AS b FROM (SELECT t, id, label, z + dz AS z, y + dy AS y, x + dx AS x FROM tv, step) a JOIN tv b USING (t, z, y, x, label)),
reach(t, node, other) AS (SELECT t, id, id FROM tv UNION SELECT r.t, r.node, l.b FROM reach r JOIN link l ON r.t = l.t AND r.other = l.a),
part AS (SELECT t, node AS id, min(other) + t * 512 + 257 AS label FROM reach GROUP BY 1, 2), lab AS (SELECT tv.t, z, y, x, part.label FROM tv JOIN part USING (t, id)),
va AS (SELECT label, z, y, x FROM lab, tops WHERE t < last AND z >= t * 20 + 16), vb AS (SELECT label, z, y, x FROM lab WHERE t > 0 AND z < t * 20 + 4)"""


def _face_sql(name: str, voxels: str) -> str:
    """The face objects of one side, with their axes by the same closed form."""
    cov = ", ".join(f"(sum({a} * {b}) * count(*) - sum({a}) * sum({b})) / (count(*) * count(*)) AS {a}{b}" for a, b in ("zz", "zy", "zx", "yy", "yx", "xx"))
    row = {"z": ("zz", "zy", "zx"), "y": ("zy", "yy", "yx"), "x": ("zx", "yx", "xx")}
    less = lambda k, i, j: f"({row[i]['zyx'.index(j)]}{' - ' + k if i == j else ''})"
    product = {f"{i}{j}": " + ".join(f"{less('mid', i, k)} * {less('low', k, j)}" for k in "zyx") for i in "zyx" for j in "zyx"}
    norm = {j: " + ".join(f"p{i}{j} * p{i}{j}" for i in "zyx") for j in "zyx"}
    pick = lambda i: f"CASE longest WHEN nz THEN p{i}z WHEN ny THEN p{i}y ELSE p{i}x END / sqrt(longest)"
    return f"""{name}0 AS (SELECT label, count(*) AS n, {", ".join(f"{f}({a}) AS {a}{k}" for a in "zyx" for f, k in (("min", 0), ("max", 1)))}, {", ".join(f"sum({a}) / count(*) AS c{a}" for a in "zyx")}, {cov} FROM {voxels} GROUP BY 1),
{name}1 AS (SELECT *, (zz + yy + xx) / 3 AS m, sqrt(((zz - m) * (zz - m) + (yy - m) * (yy - m) + (xx - m) * (xx - m) + 2 * (zy * zy + zx * zx + yx * yx)) / 6) AS p FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, ((zz - m) / p * ((yy - m) / p * (xx - m) / p - yx / p * yx / p) - zy / p * (zy / p * (xx - m) / p - yx / p * zx / p) + zx / p * (zy / p * yx / p - (yy - m) / p * zx / p)) / 2))) / 3 END AS angle FROM {name}1),
{name}3 AS (SELECT *, m + 2 * p * cos(angle) AS high, m + 2 * p * cos(angle + 2 * pi() / 3) AS low, 3 * m - high - low AS mid FROM {name}2),
{name}4 AS (SELECT *, {", ".join(f"{v} AS p{k}" for k, v in product.items())} FROM {name}3),
{name}5 AS (SELECT *, {", ".join(f"{v} AS n{j}" for j, v in norm.items())}, greatest(nz, ny, nx) AS longest FROM {name}4),
{name} AS (SELECT label, n, {", ".join(f"{a}{k}" for a in "zyx" for k in (0, 1))}, cz, cy, cx, {", ".join(f"CASE WHEN high - mid > 1e-6 * 3 * m THEN {pick(i)} END AS a{i}" for i in "zyx")} FROM {name}5)"""


_SEAMS = f"""WITH RECURSIVE {_TILES}, {_face_sql("fa", "va")}, {_face_sql("fb", "vb")},
both_ AS (SELECT va.label AS a_id, vb.label AS b_id, count(*) AS shared FROM va JOIN vb USING (z, y, x) GROUP BY 1, 2),
q AS (SELECT a.label AS a_id, b.label AS b_id, coalesce(s.shared, 0) AS shared, round(coalesce(s.shared, 0) / least(a.n, b.n), 9) AS overlap, round(least(a.n, b.n) / greatest(a.n, b.n), 9) AS ratio,
  {" * ".join(f"greatest(0, least(a.{x}1, b.{x}1) - greatest(a.{x}0, b.{x}0) + 1)" for x in "zyx")} AS common, {" * ".join(f"(a.{x}1 - a.{x}0 + 1)" for x in "zyx")} AS boxa, {" * ".join(f"(b.{x}1 - b.{x}0 + 1)" for x in "zyx")} AS boxb,
  round(common / (boxa + boxb - common), 9) AS iou, round(sqrt((a.cz - b.cz) ** 2 + (a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2), 9) AS distance, round(coalesce(least(1, abs(a.az * b.az + a.ay * b.ay + a.ax * b.ax)), 0), 9) AS direction
  FROM fa a JOIN fb b ON greatest({", ".join(f"b.{x}0 - a.{x}1 - 1, a.{x}0 - b.{x}1 - 1" for x in "zyx")}) < 4 LEFT JOIN both_ s ON s.a_id = a.label AND s.b_id = b.label),
u AS (SELECT *, round(0.5 * ratio + 0.5 * iou, 9) AS morph, round(least(1, greatest(0, 0.3 * overlap + 0.25 * direction + 0.25 * morph + 0.2 * exp(-distance / 8.0))), 9) AS confidence FROM q),
r AS (SELECT a_id, b_id, shared, overlap, ratio, iou, distance, direction, confidence, CASE WHEN confidence >= 0.75 AND overlap >= 0.2 AND morph >= 0.5 THEN 'MATCH' WHEN confidence >= 0.6 AND overlap >= 0.35 AND ratio < 0.4 THEN 'MERGE'
  WHEN overlap < 0.05 AND distance < 4 AND direction < 0.3 THEN 'SPLIT' WHEN confidence < 0.35 THEN 'HOLD' ELSE 'REVIEW' END AS action FROM u)"""


def labelled_tiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Voxels (label, z, y, x) within HALO of the seams, as the tile before each labels them, and the one after. Labels are components
    of a tile and differ over all tiles."""
    blocks, grid = volume(spark, sf_dir)
    last = (grid.shape[0] - 1) // THICK
    z, own = F.col("z"), F.expr(f"z div {THICK}")
    tile = F.explode(F.filter(F.array(own - 1, own, own + 1), lambda t: (t >= 0) & (t <= last) & (z >= t * THICK - HALO) & (z < (t + 1) * THICK + HALO)))
    voxels = B.as_voxels(blocks, grid, "label").select(tile.alias("volume"), "z", "y", "x", "label").withColumn("z", (z - F.col("volume") * THICK + HALO).cast("int"))
    tiles = B.Grid((THICK + 2 * HALO, *grid.shape[1:]), (4, 4, 4))  # whole blocks, whatever part of a tile is there
    labelled = segments.components(B.as_blocks(voxels, tiles, "label"), tiles, "label", dense=False)
    rows = B.as_voxels(labelled, tiles, "component").where("component <> 0").select("volume", (z + F.col("volume") * THICK - HALO).alias("z"), "y", "x", F.col("component").alias("label"))
    rows = stored(rows, "tiles")
    start = F.col("volume") * THICK
    before = seams.slab(rows, "z", start + THICK, HALO).where(F.col("volume") < last)
    return before.drop("volume"), seams.slab(rows, "z", start, HALO).where(F.col("volume") > 0).drop("volume")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seams.matches(*labelled_tiles(spark, sf_dir), HALO, (8, 8, 8))


@query(f"{_SEAMS} SELECT * FROM r")
def seam_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


@query(f"""{_SEAMS}, e AS (SELECT *, ratio * (0.5 + 0.5 * direction) AS shape FROM r WHERE action = 'REVIEW'),
s AS (SELECT *, CASE WHEN distance <= 5 THEN least(1, 1 - distance / 5) ELSE 0 END + CASE WHEN direction > 0.7 THEN direction ELSE 0 END + CASE WHEN ratio > 0.7 THEN ratio ELSE 0 END + CASE WHEN shape > 0.6 THEN shape ELSE 0 END + CASE WHEN iou > 0.55 THEN abs(iou - 0.5) * 2 ELSE 0 END + CASE WHEN confidence > 0.55 THEN abs(confidence - 0.5) * 2 ELSE 0 END AS mg,
 CASE WHEN distance > 5 THEN least(1, (distance - 5) / 20) ELSE 0 END + CASE WHEN direction <= 0.7 THEN 1 - direction ELSE 0 END + CASE WHEN ratio <= 0.7 THEN 1 - ratio ELSE 0 END + CASE WHEN overlap < 0.6 THEN 1 - overlap ELSE 0 END + CASE WHEN shape <= 0.6 THEN 1 - shape ELSE 0 END + CASE WHEN iou <= 0.55 THEN abs(iou - 0.5) * 2 ELSE 0 END + CASE WHEN confidence <= 0.55 THEN abs(confidence - 0.5) * 2 ELSE 0 END AS sp FROM e),
n AS (SELECT *, round(mg / greatest(mg + sp, 1e-6), 9) AS merge_share, round(sp / greatest(mg + sp, 1e-6), 9) AS split_share FROM s)
SELECT a_id, b_id, merge_share, split_share, CASE WHEN abs(merge_share - split_share) < 0.15 OR overlap < 0.5 THEN 'REVIEW' WHEN merge_share >= 0.62 THEN 'MERGE' WHEN split_share >= 0.62 THEN 'SPLIT' ELSE 'REVIEW' END AS decision FROM n""")
def seam_reviews(spark, sf_dir):
    return seams.reviewed(_matches(spark, sf_dir)).select("a_id", "b_id", "merge_share", "split_share", "decision")


@query()
def quality_regression(spark, sf_dir):
    """Labelled documents with the probability of quality 1 by length, lines and words, fitted to them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.log1p("n_chars").alias("chars"), F.log1p(F.size(F.split("text", "\n"))).alias("lines"), F.log1p(F.size(F.split("text", " "))).alias("words"))
    rows = stored(docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"), "features")
    names = ["chars", "lines", "words"]
    return rows.select("doc_id", "quality", regression.fit(rows, names, "quality").probability(names).alias("p"))


@query(f"""WITH {VOLUME}, f AS (SELECT 'v0_z' || z // 25 || '_y' || y // 4 || '_x' || x // 4 || '.npy' AS file, z % 25 AS z, y % 4 AS y, x % 4 AS x, label FROM vol)
SELECT file, z, count(*) AS n, CAST(sum(label) AS BIGINT) AS total FROM f WHERE z BETWEEN 10 AND 22 AND x >= 1 GROUP BY file, z""")
def volume_files(spark, sf_dir):
    """The labels written as a file a block, and a box of each file read back in smaller blocks from the second layer on."""
    blocks, grid = volume(spark, sf_dir)
    folder = scratch(spark, "volumes")
    stored(volumes.write_blocks(blocks, grid, "label", folder, "<i8"), "receipts")
    read = volumes.read_blocks(spark, folder, (10, 3, 4), box=(2, 0, 1, 23, 4, 4), integers=True).where("iz >= 1")
    by = arrays.voxels(read).groupBy(F.element_at(F.split("path", "/"), -1).alias("file"), "z")
    return by.agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))
