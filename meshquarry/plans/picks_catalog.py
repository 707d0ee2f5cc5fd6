"""Queries of greedy walks: picks with quotas, raster order, one centre of each group. Their SQL walks step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshquarry.operators import picks
from meshquarry.plans import bind, catalog
from meshquarry.plans.catalog import query

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
RADIUS = 12.0
_POINT = """SELECT c_nationkey AS nation, c_mktsegment AS kind, c_custkey AS id, c_acctbal AS score, c_custkey * 7919 % 97 AS z, c_custkey * 104729 % 89 AS y, c_custkey * 1299709 % 83 AS x FROM customer"""
_NEAR = "len(list_filter(w.kept, lambda k: (k.z - p.z) * (k.z - p.z) + (k.y - p.y) * (k.y - p.y) + (k.x - p.x) * (k.x - p.x) < 144)) > 0"
_ROW = "{'id': p.id, 'turn': w.step, 'z': p.z, 'y': p.y, 'x': p.x}"


def _walk(order: str) -> str:
    """The walk over each nation's points in an order: w holds what is kept after each step, out what is kept at the end."""
    return f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY {order}) AS r FROM ({_POINT})),
w(nation, step, kept) AS (SELECT nation, 0::BIGINT, CAST([] AS STRUCT(id BIGINT, turn BIGINT, z BIGINT, y BIGINT, x BIGINT)[]) FROM p WHERE r = 1
  UNION ALL SELECT w.nation, w.step + 1, CASE WHEN {_NEAR} THEN w.kept ELSE list_append(w.kept, {_ROW}) END FROM w JOIN p ON p.nation = w.nation AND p.r = w.step + 1),
out AS (SELECT nation, unnest(arg_max(kept, step)) AS k FROM w GROUP BY nation)"""


def _turns(kind: str) -> str:
    """The picks in turns: a step of w is a turn of every nation."""
    return f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, id) AS r FROM ({_POINT})),
w(nation, step, kept) AS (SELECT DISTINCT nation, 0::BIGINT, CAST([] AS STRUCT(id BIGINT, turn BIGINT, z BIGINT, y BIGINT, x BIGINT)[]) FROM p
  UNION ALL SELECT nation, step + 1, CASE WHEN count(row) = 0 THEN any_value(kept) ELSE list_append(any_value(kept), arg_min(row, r)) END
  FROM (SELECT w.*, p.r, CASE WHEN p.id IS NOT NULL THEN {_ROW} END AS row FROM w LEFT JOIN p ON p.nation = w.nation AND p.kind = {list(SEGMENTS)}[{kind} + 1] AND NOT {_NEAR} WHERE w.step < 20) GROUP BY nation, step),
out AS (SELECT nation, unnest(arg_max(kept, step)) AS k FROM w GROUP BY nation)
SELECT nation, p.kind, k.turn, p.id FROM out JOIN p USING (nation) WHERE p.id = k.id"""


def _points(spark, sf_dir):
    kinds = bind.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return bind.customers(spark, sf_dir).join(kinds, "id")


@query(_turns("w.step % 5"))
def quota_picks(spark, sf_dir):
    return picks.with_quotas(_points(spark, sf_dir), "nation", "kind", SEGMENTS, 4, RADIUS).select("nation", "kind", "turn", "id")


@query(_turns("w.step // 4"))
def quota_picks_in_order(spark, sf_dir):
    """Each kind has all its turns before the next."""
    return picks.with_quotas(_points(spark, sf_dir), "nation", "kind", SEGMENTS, 4, RADIUS, cyclic=False).select("nation", "kind", "turn", "id")


@query(f"{_walk('z, y, x, id')} SELECT nation, k.id FROM out")
def raster_picks(spark, sf_dir):
    return picks.raster_separated(bind.customers(spark, sf_dir), "nation", RADIUS).select("nation", "id")


catalog.SQL["separated_points"] = f"{_walk('score DESC, id')} SELECT nation, p.id, p.score, CAST(p.z AS DOUBLE) AS z, CAST(p.y AS DOUBLE) AS y, CAST(p.x AS DOUBLE) AS x FROM out JOIN p USING (nation) WHERE p.id = k.id"


@query(f"""{_walk('score DESC, id')}, s AS (SELECT s_suppkey * 7919 % 97 AS z, s_suppkey * 104729 % 89 AS y, s_suppkey * 1299709 % 83 AS x FROM supplier WHERE s_suppkey % 5 = 0),
c AS (SELECT nation, p.* EXCLUDE (nation) FROM out JOIN p USING (nation) WHERE p.id = k.id AND p.score >= 2000 AND NOT EXISTS (FROM s WHERE (s.z - p.z) * (s.z - p.z) + (s.y - p.y) * (s.y - p.y) + (s.x - p.x) * (s.x - p.x) < 144))
SELECT nation, arg_min(id, sha256('centres|' || nation || '|' || id)) AS id FROM c GROUP BY nation""")
def centre_picks(spark, sf_dir):
    """A centre of each nation, away from every fifth supplier's place."""
    k = F.col("s_suppkey")
    pinned = bind.table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select((k * 7919 % 97).cast("double").alias("z"), (k * 104729 % 89).cast("double").alias("y"), (k * 1299709 % 83).cast("double").alias("x"))
    points = bind.customers(spark, sf_dir).withColumn("step", F.col("score"))
    return picks.centre_of_each(points, "nation", pinned, RADIUS, 2000.0, "centres").select("nation", "id")


@query("SELECT c_custkey, order_key, row_number() OVER (PARTITION BY c_nationkey ORDER BY order_key) AS place FROM (SELECT *, sha256('round|' || c_custkey) AS order_key FROM customer)")
def presentation_order(spark, sf_dir):
    rows = picks.presented(bind.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "round", F.col("c_custkey"))
    return rows.withColumn("place", F.expr("row_number() OVER (PARTITION BY c_nationkey ORDER BY order_key)")).drop("c_nationkey")
