"""Queries of audits: equivalence, gradients, skeletons, offers, layouts, funnels and pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshquarry.operators import audits, gates, graph
from meshquarry.plans import bind
from meshquarry.plans.catalog import query
from meshquarry.plans.rules_catalog import rounded

_STEP = "(CASE WHEN block % 3 = 0 THEN 0.0004 WHEN block % 3 = 1 THEN 0.02 ELSE 0 END)"


@query(f"""WITH {bind.VOXELS}, d AS (SELECT block, value AS a, value + {_STEP} AS b FROM voxels), g AS (SELECT block, max(abs(a - b)) AS largest, avg(abs(a - b)) AS mean, quantile_cont(abs(a - b), 0.99) AS p99,
 avg(CAST((a >= 0.1) <> (b >= 0.1) AS INTEGER)) AS disagree FROM d GROUP BY 1)
SELECT block, true AS whole, round(largest, 9) AS largest, round(mean, 9) AS mean, round(p99, 9) AS p99, round(disagree, 9) AS disagree, (largest <= 0.001 OR mean <= 0.0001 OR p99 <= 0.001) AND disagree <= 0.0001 AS passed FROM g""")
def volume_equivalence(spark, sf_dir):
    a = bind.voxels(spark, sf_dir).select("block", "z", "y", "x", "value")
    b = a.withColumn("value", F.col("value") + F.when(F.col("block") % 3 == 0, 0.0004).when(F.col("block") % 3 == 1, 0.02).otherwise(0.0))
    return rounded(audits.equivalence(a, b, ["block", "z", "y", "x"], "block", 1e-3, 0.1, 1e-4), "largest", "mean", "p99", "disagree")


_GRADED = ", ".join(
    f"abs(coalesce((lead(value) OVER w{a} - lag(value) OVER w{a}) / 2, lead(value) OVER w{a} - value, value - lag(value) OVER w{a})) AS g{a}" for a in "zyx"
)
_WINDOWS = ", ".join(f"w{a} AS (PARTITION BY block, {', '.join(b for b in 'zyx' if b != a)} ORDER BY {a})" for a in "zyx")


@query(f"""WITH {bind.VOXELS}, g AS (SELECT block, {_GRADED} FROM voxels WINDOW {_WINDOWS}), s AS (SELECT *, CASE WHEN gz >= gy AND gz >= gx THEN 'z' WHEN gy >= gx THEN 'y' ELSE 'x' END AS axis, sqrt(gz * gz + gy * gy + gx * gx) AS size FROM g),
t AS (SELECT s.*, size >= cut AS top FROM s JOIN (SELECT block, quantile_cont(size, 0.9) AS cut FROM s GROUP BY 1) USING (block))
SELECT block, {", ".join(f"round(avg(g{a}), 9) AS {a}_mean, round(avg(CAST(axis = '{a}' AS INTEGER)), 9) AS {a}_share, round(avg(CAST(axis = '{a}' AS INTEGER)) FILTER (top), 9) AS {a}_top" for a in "zyx")} FROM t GROUP BY 1""")
def axis_gradients(spark, sf_dir):
    rows = audits.axis_shares(audits.gradients(bind.voxels(spark, sf_dir).select("block", "z", "y", "x", "value"), "block"), "block", 0.9)
    return rounded(rows, *(f"{a}_{k}" for a in "zyx" for k in ("mean", "share", "top")))


_TREE_EDGES = f"""{bind.TREE}, e AS (SELECT c.tree, c.node AS child, p.node AS parent, sqrt((c.z - p.z) ** 2 + (c.y - p.y) ** 2 + (c.x - p.x) ** 2) AS length FROM nodes c JOIN nodes p ON c.tree = p.tree AND c.parent = p.node)"""


@query(f"""WITH {_TREE_EDGES}, m AS (SELECT tree, avg(length) AS mean, stddev_pop(length) AS sd FROM e GROUP BY 1)
SELECT tree, child, parent, round(z, 6) AS z_score FROM (SELECT e.*, (length - mean) / (sd + 1e-9) AS z FROM e JOIN m USING (tree)) WHERE round(z, 6) >= 1.25""")
def long_skeleton_edges(spark, sf_dir):
    rows = audits.long_edges(graph.tree_edges(bind.tree(spark, sf_dir)), 1.2)
    return rows.select("tree", "child", "parent", F.round("z_score", 6).alias("z_score")).where("z_score >= 1.25")


@query("""WITH e AS (SELECT l_suppkey AS tree, l_partkey % 40 AS child, l_orderkey % 40 AS parent FROM lineitem), d AS (SELECT tree, child AS node FROM e UNION ALL SELECT tree, parent FROM e)
SELECT tree, node, count(*) AS degree FROM d GROUP BY 1, 2 HAVING count(*) > 4""")
def branching_flags(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tree"), (F.col("l_partkey") % 40).alias("child"), (F.col("l_orderkey") % 40).alias("parent"))
    return audits.degree_flags(rows, 4)


@query("""WITH e AS (SELECT l_suppkey AS tree, l_partkey % 40 AS c, l_orderkey % 40 AS p FROM lineitem), n AS (SELECT tree, count(*) - 1 AS n FROM e GROUP BY tree, least(c, p), greatest(c, p))
SELECT tree, CAST(sum(n) AS BIGINT) AS parallel FROM n GROUP BY 1 HAVING sum(n) > 0""")
def parallel_skeleton_edges(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tree"), (F.col("l_partkey") % 40).alias("child"), (F.col("l_orderkey") % 40).alias("parent"))
    return audits.parallel_edges(rows)


@query(f"""WITH {bind.TREE} SELECT c.tree || ':' || c.node AS id, concat_ws(',', p.x::BIGINT, p.y::BIGINT, p.z::BIGINT) AS point_a, concat_ws(',', c.x::BIGINT, c.y::BIGINT, c.z::BIGINT) AS point_b
FROM nodes c JOIN nodes p ON c.tree = p.tree AND c.parent = p.node""")
def annotation_lines(spark, sf_dir):
    nodes = bind.tree(spark, sf_dir)
    return audits.lines(nodes, nodes.select("tree", F.col("node").alias("child"), "parent"))


@query(f"""WITH {bind.VOXELS}, a AS (SELECT block, label, z, count(*) AS area FROM voxels WHERE label > 0 GROUP BY 1, 2, 3)
SELECT block, label, z, area, round(area / lag(area) OVER (PARTITION BY block, label ORDER BY z), 9) AS ratio FROM a""")
def slice_ratios(spark, sf_dir):
    return rounded(audits.slice_ratios(bind.voxels(spark, sf_dir).where("label > 0"), "block", "label"), "ratio")


@query("""WITH o AS (SELECT l_partkey AS id, l_extendedprice / 10000 AS price, l_linenumber % 2 AS market, l_orderkey, l_suppkey % 13 AS rate FROM lineitem),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY price, market, l_orderkey, rate) = 1), c AS (SELECT *, CASE WHEN rate > 0 THEN 800.0::DOUBLE / rate ELSE 'infinity'::DOUBLE END AS seconds FROM b)
SELECT id, market, l_orderkey, round(seconds, 6) AS seconds, round(seconds / 3600 * price + 0.01, 6) AS cost, round(500 * (seconds / 3600 * price + 0.01), 6) AS remaining_cost, round(500 * seconds / 3600, 6) AS remaining_hours FROM c WHERE rate > 0""")
def offer_costs(spark, sf_dir):
    """The cheapest offer of each id over both markets, with what is left to pay; offers without a rate are left out."""
    rows = bind.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_extendedprice") / 10000).alias("price"), (F.col("l_linenumber") % 2).alias("market"), "l_orderkey", (F.col("l_suppkey") % 13).alias("rate"))
    rows = audits.cheapest(rows, "id", "price", "market", "l_orderkey").where("rate > 0")
    costs = audits.chunk_costs(F.col("rate"), 800, F.col("price"), F.lit(0.01), F.lit(500))
    return rounded(rows.select("id", "market", "l_orderkey", *(v.alias(c) for c, v in costs.items())), *costs, digits=6)


@query("""WITH p AS (SELECT p_partkey AS id, 100 + p_partkey % 400 AS n, 20 + p_size AS crop, 10 + p_partkey % 30 AS stride FROM part), l AS (SELECT *, greatest(1, (n - crop) // stride + 2) AS tiles FROM p),
m AS (SELECT *, crop + (tiles - 1) * stride AS padded, (crop + (tiles - 1) * stride - n) AS pad FROM l),
c AS (SELECT id, sum(greatest(0, least(n, i * stride - floor(pad / 2) + crop) - greatest(0, i * stride - floor(pad / 2)))) / any_value(n) AS coverage FROM (SELECT *, unnest(range(CAST(tiles AS BIGINT))) AS i FROM m) GROUP BY 1)
SELECT id, CAST(tiles AS BIGINT) AS tiles, CAST(padded AS BIGINT) AS padded, CAST(floor(pad / 2) AS BIGINT) AS before, CAST(pad - floor(pad / 2) AS BIGINT) AS after, round(coverage, 9) AS coverage FROM m JOIN c USING (id)""")
def axis_layouts(spark, sf_dir):
    k = F.col("p_partkey")
    layout = audits.axis_layout(100 + k % 400, 20 + F.col("p_size"), 10 + k % 30)
    rows = bind.table(spark, sf_dir, "part").select(k.alias("id"), *((v if c == "coverage" else v.cast("long")).alias(c) for c, v in layout.items()))
    return rounded(rows, "coverage")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN NOT l_quantity >= 10 THEN 'quantity' WHEN NOT l_discount <= 0.07 THEN 'discount' WHEN NOT l_tax <= 0.05 THEN 'tax' END AS failed_at,
 l_quantity >= 10 AND l_discount <= 0.07 AND l_tax <= 0.05 AS survived FROM lineitem""")
def elimination_funnel(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "lineitem")
    tests = {"quantity": F.col("l_quantity") >= 10, "discount": F.col("l_discount") <= 0.07, "tax": F.col("l_tax") <= 0.05}
    return audits.funnel(rows, tests).select("l_orderkey", "l_linenumber", "failed_at", "survived")


@query("SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) BETWEEN 11 AND 30")
def second_page(spark, sf_dir):
    return audits.page(bind.table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 10, 20).select("o_orderpriority", "o_orderkey")


@query(f"""WITH {bind.EVENTS} SELECT reviewer % 50 AS axis, count_if(decision = 'view') AS "view", count_if(decision = 'click') AS click, count_if(decision = 'purchase') AS purchase, count_if(decision = 'purchase') > 0 AS found FROM ev GROUP BY 1""")
def discovery_verdicts(spark, sf_dir):
    rows = bind.events(spark, sf_dir).select((F.col("reviewer") % 50).alias("axis"), "decision")
    return audits.any_verdict(rows, ["axis"], "decision", ["view", "click", "purchase"], "purchase")


@query(f"""WITH {bind.SITES}, s AS (SELECT *, CASE WHEN evidence % 4 = 0 THEN 'hash' END AS model FROM sites)
SELECT id, 'confidence out of range' AS problem FROM s WHERE confidence NOT BETWEEN 0 AND 0.9 UNION ALL SELECT id, 'machine evidence without a model' FROM s WHERE pre % 3 = 0 AND model IS NULL UNION ALL
SELECT id, 'verified without a review' FROM s WHERE verified AND review NOT IN ('expert', 'locked')""")
def evidence_violations(spark, sf_dir):
    model = F.when(F.col("evidence") % 4 == 0, "hash")
    rules = {
        "confidence out of range": ~F.col("confidence").between(0, 0.9),
        "machine evidence without a model": (F.col("pre") % 3 == 0) & model.isNull(),
        "verified without a review": F.col("verified") & ~F.col("review").isin("expert", "locked"),
    }
    return gates.violations(bind.sites(spark, sf_dir), F.col("id"), rules)
