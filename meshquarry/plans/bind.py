"""Records of the spatial-graph model, made from the general tables. Each function has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = F.when(F.col("l_returnflag") == "A", "expert").when(F.col("l_returnflag") == "R", "locked").otherwise("open")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.when(F.col("l_linenumber") != 7, F.col("l_suppkey")).alias("pre"),
        (F.col("l_partkey") % 50).alias("post"),
        F.col("l_orderkey").alias("evidence"),
        (F.col("l_orderkey") % 20 != 0).alias("verified"),
        review.alias("review"),
        (F.col("l_discount") * 10).alias("confidence"),
    )


SITES = """sites AS (
  SELECT l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS pre, l_partkey % 50 AS post,
         l_orderkey AS evidence, l_orderkey % 20 <> 0 AS verified,
         CASE l_returnflag WHEN 'A' THEN 'expert' WHEN 'R' THEN 'locked' ELSE 'open' END AS review, l_discount * 10 AS confidence
  FROM lineitem
)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("connector"), F.col("l_suppkey").alias("node"), F.when(F.col("l_linenumber") % 2 == 0, 15).otherwise(16).alias("relation"))


LINKS = "links AS (SELECT l_orderkey AS connector, l_suppkey AS node, CASE WHEN l_linenumber % 2 = 0 THEN 15 ELSE 16 END AS relation FROM lineitem)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review events: reviewer, decision, and the key that a decision is about."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("reviewer"),
        F.col("event_type").alias("decision"),
        F.from_json("props", "k bigint")["k"].alias("item"),
        F.col("value"),
    )


EVENTS = "ev AS (SELECT event_id, ts, user_id AS reviewer, event_type AS decision, CAST(json_extract(props, '$.k') AS BIGINT) AS item, value FROM events)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes (id, split, z0 ...): places from the key, sizes from the part's size."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.when(k % 3 == 0, "test").otherwise("train").alias("split"),
        (k * 37 % 400).alias("z0"), (k * 37 % 400 + 1 + s % 23).alias("z1"),
        (k * 101 % 300).alias("y0"), (k * 101 % 300 + 1 + s % 17).alias("y1"),
        (k * 53 % 500).alias("x0"), (k * 53 % 500 + 1 + s % 31).alias("x1"),
    )


PARTS = """parts AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'test' ELSE 'train' END AS split,
         p_partkey * 37 % 400 AS z0, p_partkey * 37 % 400 + 1 + p_size % 23 AS z1,
         p_partkey * 101 % 300 AS y0, p_partkey * 101 % 300 + 1 + p_size % 17 AS y1,
         p_partkey * 53 % 500 AS x0, p_partkey * 53 % 500 + 1 + p_size % 31 AS x1
  FROM part
)"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels (block, z, y, x, value, label) of 4 x 4 x 4 blocks; the label is the size of the value in steps of 1 / 16, 0 below one."""
    from meshquarry.operators.spatial import unrolled

    rows = unrolled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (4, 4, 4)).withColumnRenamed("vec_id", "block")
    return rows.withColumn("value", F.col("value").cast("double")).withColumn("label", F.floor(F.abs("value") * 16).cast("long"))


VOXELS = """voxels AS (
  SELECT block, p // 16 AS z, p // 4 % 4 AS y, p % 4 AS x, value, CAST(floor(abs(value) * 16) AS BIGINT) AS label
  FROM (SELECT vec_id AS block, CAST(unnest(embedding) AS DOUBLE) AS value, unnest(range(64)) AS p FROM embeddings)
)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (nation, id, score, z, y, x)."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), k.alias("id"), F.col("c_acctbal").alias("score"), (k * 7919 % 97).cast("double").alias("z"), (k * 104729 % 89).cast("double").alias("y"), (k * 1299709 % 83).cast("double").alias("x"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (tree, node, parent, z, y, x): a tree a supplier, where each part hangs from one with a smaller number."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tree"), (F.col("l_partkey") % 64).alias("node")).distinct()
    n = F.col("node")
    return rows.select("tree", "node", F.when(n > 0, F.expr("node div 2")).alias("parent"), (n % 7).cast("double").alias("z"), (n % 5).cast("double").alias("y"), (n % 3).cast("double").alias("x"))


TREE = """nodes AS (
  SELECT tree, node, CASE WHEN node > 0 THEN node // 2 END AS parent, CAST(node % 7 AS DOUBLE) AS z, CAST(node % 5 AS DOUBLE) AS y, CAST(node % 3 AS DOUBLE) AS x
  FROM (SELECT DISTINCT l_suppkey AS tree, l_partkey % 64 AS node FROM lineitem)
)"""
