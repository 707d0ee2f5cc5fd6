"""Named queries over the bound tables, each with equivalent SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.functions import grid, keys
from meshquarry.operators import graph, metrics, ranking, relational, spatial
from meshquarry.plans import bind
from meshquarry.storage import scratch
from meshquarry.streaming import reviews

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_EDGES = f"""{bind.SITES}, edges AS (
  SELECT pre, post, count(*) AS n_sites, count(DISTINCT evidence) AS n_evidence, bool_and(verified) AS all_verified,
         coalesce(bool_and(review IN ('expert', 'locked')), false) AS all_accepted
  FROM sites WHERE pre IS NOT NULL AND post IS NOT NULL GROUP BY pre, post
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.connections(bind.sites(spark, sf_dir), ["expert", "locked"])


@query(f"WITH {_EDGES} SELECT 'EDGE-' || lpad(CAST(row_number() OVER (ORDER BY pre, post) AS VARCHAR), 8, '0') AS id, * FROM edges")
def connection_table(spark, sf_dir):
    rows = relational.numbered(edges(spark, sf_dir), ["pre", "post"], "n")
    return rows.select(keys.serial_id("EDGE-", F.col("n")).alias("id"), "pre", "post", "n_sites", "n_evidence", "all_verified", "all_accepted")


@query(f"WITH {bind.LINKS} SELECT connector, count(DISTINCT node) FILTER (WHERE relation = 15) AS n_pre, count(DISTINCT node) FILTER (WHERE relation = 16) AS n_post, n_pre > 0 AND n_post > 0 AS resolved FROM links GROUP BY connector")
def link_resolution(spark, sf_dir):
    return relational.resolve_links(bind.links(spark, sf_dir))


@query(f"WITH {bind.LINKS}, d AS (SELECT DISTINCT * FROM links) SELECT a.node AS pre, b.node AS post, count(*) AS n FROM d a JOIN d b ON a.connector = b.connector AND a.relation = 15 AND b.relation = 16 GROUP BY 1, 2")
def link_edges(spark, sf_dir):
    rows = relational.expanded_links(bind.links(spark, sf_dir))
    return rows.groupBy("pre", "post").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_orders(spark, sf_dir):
    orders = bind.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return relational.orphans(orders, "o_custkey", bind.table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


@query(f"WITH {bind.SITES} SELECT o_orderkey AS evidence, o_orderstatus FROM orders o WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM sites s WHERE s.evidence = o.o_orderkey AND s.verified AND s.review = 'expert')")
def unsupported_claims(spark, sf_dir):
    claims = bind.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("evidence"), "o_orderstatus")
    return relational.unsupported(claims, "evidence", bind.sites(spark, sf_dir), F.col("verified") & (F.col("review") == "expert"))


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(*) AS sites,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS value
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def hierarchy_trace(spark, sf_dir):
    t = lambda name: bind.table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    value = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return rows.groupBy("r_name", "n_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count_distinct("o_orderkey").alias("orders"), F.count("*").alias("sites"), value.alias("value"))


@query("SELECT coalesce(s.s_nationkey, n.n_nationkey) AS nation, CASE WHEN s.s_nationkey IS NULL THEN 'nation' ELSE 'supplier' END AS origin, coalesce(s.n, 0) AS n FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s FULL JOIN nation n ON n.n_nationkey = s.s_nationkey")
def coalesced_lookup(spark, sf_dir):
    held = bind.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")).select("nation", F.lit("supplier").alias("origin"), "n")
    known = bind.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.lit("nation").alias("origin"), F.lit(0).cast("long").alias("n"))
    return relational.coalesced(held, known, "nation")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return relational.duplicates(bind.table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, 'x' AS note, stored, derived FROM (SELECT o_orderkey, CAST(o_totalprice > 100000 AS INTEGER) AS stored, d.derived FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(l_extendedprice) > 100000 AS INTEGER) AS derived FROM lineitem GROUP BY 1) d ON l_orderkey = o_orderkey) WHERE stored IS DISTINCT FROM derived")
def stored_and_derived(spark, sf_dir):
    stored = bind.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 100000).cast("int").alias("big"))
    derived = bind.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum("l_extendedprice") > 100000).cast("int").alias("big"))
    return relational.differing(stored, derived, ["o_orderkey"], "big").select("o_orderkey", F.lit("x").alias("note"), "stored", "derived")


_DOMAINS = {"decision": ["signup", "purchase", "error", "view", "click", "withdrawn"], "split": [0, 1, 2]}


@query(f"""WITH {bind.EVENTS} SELECT d.decision, s.split, count(ev.event_id) AS n
FROM (SELECT unnest(['signup', 'purchase', 'error', 'view', 'click', 'withdrawn']) AS decision) d CROSS JOIN (SELECT unnest([0, 1, 2]) AS split) s
LEFT JOIN ev ON ev.decision = d.decision AND ev.reviewer % 3 = s.split GROUP BY 1, 2""")
def decision_crosstab(spark, sf_dir):
    rows = bind.events(spark, sf_dir).withColumn("split", (F.col("reviewer") % 3).cast("int"))
    return relational.crosstab(rows, ["decision", "split"], _DOMAINS)


@query(f"WITH {bind.EVENTS} SELECT decision, reviewer % 3 AS split, item % 4 AS tier, count(*) AS n FROM ev GROUP BY GROUPING SETS ((decision, split), (decision, tier))")
def decision_grouping_sets(spark, sf_dir):
    rows = bind.events(spark, sf_dir).select("decision", (F.col("reviewer") % 3).alias("split"), (F.col("item") % 4).alias("tier"))
    sets = [[F.col("decision"), F.col("split")], [F.col("decision"), F.col("tier")]]
    return rows.groupingSets(sets, F.col("decision"), F.col("split"), F.col("tier")).agg(F.count("*").alias("n"))


@query(f"WITH {bind.EVENTS} SELECT item, count(*) AS n, CASE WHEN count(DISTINCT decision) > 1 THEN 'mixed' WHEN max(decision) IN ('view', 'click') THEN max(decision) END AS verdict FROM (SELECT item * 1000 + reviewer % 1000 AS item, decision FROM ev) GROUP BY item")
def item_consensus(spark, sf_dir):
    rows = bind.events(spark, sf_dir).select((F.col("item") * 1000 + F.col("reviewer") % 1000).alias("item"), "decision")
    return relational.consensus(rows, "item", "decision", ["view", "click"])


@query(f"WITH {bind.EVENTS} SELECT event_id, item, 1.0::DOUBLE / count(*) OVER (PARTITION BY item) AS weight FROM ev")
def item_weights(spark, sf_dir):
    return relational.equal_weights(bind.events(spark, sf_dir).select("event_id", "item"), "item")


@query(f"WITH {bind.EVENTS} SELECT reviewer, item, event_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY reviewer, item ORDER BY ts DESC, event_id DESC) AS rk FROM ev) WHERE rk = 1")
def latest_decisions(spark, sf_dir):
    rows = bind.events(spark, sf_dir).select("reviewer", "item", "event_id", "decision", "ts")
    return relational.latest(rows, ["reviewer", "item"], [F.col("ts"), F.col("event_id")]).drop("ts")


_BUILDS = "a AS (SELECT DISTINCT l_suppkey AS pre, l_partkey % 50 AS post FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT DISTINCT l_suppkey AS pre, l_partkey % 50 AS post FROM lineitem WHERE l_linenumber >= 3)"


def _builds(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pre"), (F.col("l_partkey") % 50).alias("post"), "l_linenumber")
    return rows.where("l_linenumber <= 3"), rows.where("l_linenumber >= 3")


@query(f"WITH {_BUILDS} SELECT coalesce(a.pre, b.pre) AS pre, coalesce(a.post, b.post) AS post, CASE WHEN a.pre IS NULL THEN 'added' WHEN b.pre IS NULL THEN 'removed' ELSE 'shared' END AS state FROM a FULL JOIN b ON a.pre = b.pre AND a.post = b.post")
def build_diff(spark, sf_dir):
    return relational.keyed_diff(*_builds(spark, sf_dir), ["pre", "post"])


@query(f"WITH {_BUILDS} SELECT coalesce(a.pre, b.pre) AS pre, count_if(a.post IS NOT NULL AND b.post IS NOT NULL) AS shared, count(*) AS either, shared / either AS jaccard FROM a FULL JOIN b ON a.pre = b.pre AND a.post = b.post GROUP BY 1")
def build_jaccard(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pre"), (F.col("l_partkey") % 50).alias("post"), "l_linenumber")
    return relational.jaccard(rows, "pre", "post", F.col("l_linenumber") <= 3, F.col("l_linenumber") >= 3)


@query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT pre AS node FROM edges UNION ALL SELECT post FROM edges) GROUP BY node")
def node_degrees(spark, sf_dir):
    return relational.degrees(edges(spark, sf_dir))


@query("SELECT a.n_regionkey AS held_out, b.n_regionkey FROM (SELECT DISTINCT n_regionkey FROM nation) a JOIN (SELECT DISTINCT n_regionkey FROM nation) b ON a.n_regionkey <> b.n_regionkey")
def leave_one_out(spark, sf_dir):
    return relational.leave_one_out(bind.table(spark, sf_dir, "nation"), "n_regionkey")


@query("SELECT o_orderkey, ('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.2 AS held_out, CAST(right('0' || o_orderkey, 6) AS BIGINT) % 7 AS shard FROM orders")
def hash_split(spark, sf_dir):
    key = F.col("o_orderkey")
    return bind.table(spark, sf_dir, "orders").select("o_orderkey", keys.in_split(key, 0.2).alias("held_out"), keys.shard_by_suffix(key, 7).alias("shard"))


_CELLS = "cells AS (SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels WHERE NOT (quality = 0 AND toxic = 0) GROUP BY 1, 2)"


def _cells(spark, sf_dir):
    return metrics.contingency(bind.table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"WITH {_CELLS} SELECT * FROM cells")
def label_contingency(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(f"""WITH {_CELLS}, t AS (SELECT sum(n) AS total FROM cells),
h AS (SELECT sum(-n / total * log2(n / total)) AS joint FROM cells, t),
ht AS (SELECT sum(-n / total * log2(n / total)) AS truth FROM (SELECT sum(n) AS n FROM cells GROUP BY truth), t),
hp AS (SELECT sum(-n / total * log2(n / total)) AS predicted FROM (SELECT sum(n) AS n FROM cells GROUP BY predicted), t)
SELECT round(joint, 9) AS joint, round(greatest(joint - predicted, 0), 9) AS split_bits, round(greatest(joint - truth, 0), 9) AS merge_bits FROM h, ht, hp""")
def label_information(spark, sf_dir):
    return metrics.information(_cells(spark, sf_dir)).select(*(F.round(c, 9).alias(c) for c in ("joint", "split_bits", "merge_bits")))


@query(f"""WITH {bind.SITES}, cells AS (SELECT pre % 40 AS truth, post % 9 AS predicted, count(*) AS n FROM sites WHERE pre % 40 <> 0 OR post % 9 <> 0 GROUP BY 1, 2)
SELECT count_if(k > 1) AS merges, count_if(k = 0) AS false_objects, any_value(s.splits) AS splits, any_value(s.missed) AS missed
FROM (SELECT predicted, count_if(truth <> 0) AS k FROM cells WHERE predicted <> 0 GROUP BY 1),
     (SELECT count_if(k > 1) AS splits, count_if(k = 0) AS missed FROM (SELECT truth, count_if(predicted <> 0) AS k FROM cells WHERE truth <> 0 GROUP BY 1)) s""")
def object_errors(spark, sf_dir):
    rows = bind.sites(spark, sf_dir).where("pre IS NOT NULL").select((F.col("pre") % 40).alias("t"), (F.col("post") % 9).alias("p"))
    return metrics.object_errors(metrics.contingency(rows, "t", "p"))


@query("""WITH s AS (SELECT n_chars AS score, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)),
g AS (SELECT score, count_if(pos) AS pos, count_if(NOT pos) AS neg FROM s GROUP BY score),
b AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM g)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM b""")
def length_auc(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(bind.table(spark, sf_dir, "labels"), "doc_id")
    return metrics.rank_auc(rows, "n_chars", F.col("quality") == 1).select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


_Q = ", ".join(f"round(quantile_cont(v, {q}), 6) AS p{n}" for q, n in ((0.01, "01"), (0.1, "10"), (0.5, "50"), (0.9, "90"), (0.99, "99")))


@query(f"SELECT event_type, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, {_Q} FROM (SELECT event_type, value AS v FROM events) GROUP BY event_type")
def value_summary(spark, sf_dir):
    rows = metrics.summary(bind.table(spark, sf_dir, "events"), "value", ("event_type",))
    return rows.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "deviation", "p01", "p10", "p50", "p90", "p99")))


@query(f"WITH {bind.VOXELS} SELECT block, min(value) AS low, max(value) AS high, round(avg(value), 9) AS mean, round(avg(CAST(value >= 0.5 AS INTEGER)), 9) AS share_50, round(avg(CAST(value >= 0.9 AS INTEGER)), 9) AS share_90 FROM voxels GROUP BY block")
def block_saturation(spark, sf_dir):
    rows = metrics.saturation(bind.voxels(spark, sf_dir), "value", ("block",))
    return rows.select("block", "low", "high", *(F.round(c, 9).alias(c) for c in ("mean", "share_50", "share_90")))


@query("SELECT round(avg(CASE WHEN quality = 1 THEN CAST(toxic = 0 AS INTEGER) END), 9) AS sensitivity, round(avg(CASE WHEN quality <> 1 THEN CAST(toxic <> 0 AS INTEGER) END), 9) AS specificity, round((sensitivity + specificity) / 2, 9) AS balanced FROM labels")
def label_balanced_accuracy(spark, sf_dir):
    rows = metrics.balanced_accuracy(bind.table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return rows.select(*(F.round(c, 9).alias(c) for c in ("sensitivity", "specificity", "balanced")))


@query("SELECT count(*) AS groups, round(avg(m), 6) AS mean_of_means, round(sum(t) / sum(n), 6) AS plain_mean FROM (SELECT l_suppkey, avg(l_quantity) AS m, sum(l_quantity) AS t, count(*) AS n FROM lineitem GROUP BY 1)")
def two_level_mean(spark, sf_dir):
    rows = metrics.grouped_then_overall(bind.table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")
    return rows.select("groups", F.round("mean_of_means", 6).alias("mean_of_means"), F.round("plain_mean", 6).alias("plain_mean"))


@query(f"""WITH {bind.VOXELS}, c AS (SELECT block, label, count(*) AS n FROM voxels GROUP BY 1, 2)
SELECT block, arg_max(label, n * 1000 - label) AS label, max(n) / sum(n) AS share, count(*) AS labels FROM c GROUP BY block""")
def dominant_label(spark, sf_dir):
    return metrics.dominant(bind.voxels(spark, sf_dir), "block", "label")


@query(f"WITH {bind.SITES} SELECT CAST(sum(k * (k - 1) // 2) AS BIGINT) AS pairs, count_if(k > 1) AS objects FROM (SELECT post, count(DISTINCT pre) AS k FROM sites WHERE pre IS NOT NULL GROUP BY 1)")
def merge_pairs(spark, sf_dir):
    return metrics.merge_pairs(bind.sites(spark, sf_dir).where("pre IS NOT NULL"), "post", "pre")


TILE = (32, 64, 64)
_GRID = f"""{bind.PARTS}, shape AS (SELECT max(z1) AS nz, max(y1) AS ny, max(x1) AS nx, (max(z1) + 31) // 32 AS tz, (max(y1) + 63) // 64 AS ty, (max(x1) + 63) // 64 AS tx FROM parts),
grid AS (
  SELECT tile, iz, iy, ix, iz * 32 AS z0, least((iz + 1) * 32, nz) AS z1, iy * 64 AS y0, least((iy + 1) * 64, ny) AS y1, ix * 64 AS x0, least((ix + 1) * 64, nx) AS x1, nz, ny, nx, tz, ty, tx
  FROM (SELECT tile, tile // (ty * tx) AS iz, tile // tx % ty AS iy, tile % tx AS ix, shape.* FROM (SELECT unnest(range(tz * ty * tx)) AS tile FROM shape), shape)
)"""


def part_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """The extent that the parts' boxes need, three numbers of one aggregate."""
    return tuple(int(v or 0) for v in bind.parts(spark, sf_dir).agg(F.max("z1"), F.max("y1"), F.max("x1")).first())


@query(f"""WITH {_GRID} SELECT tile, iz, iy, ix, z0, z1, y0, y1, x0, x1, (z1 - z0) * (y1 - y0) * (x1 - x0) AS voxels,
  list_sum([((iz >> b) & 1) * (1 << (3 * b)) + ((iy >> b) & 1) * (1 << (3 * b + 1)) + ((ix >> b) & 1) * (1 << (3 * b + 2)) FOR b IN range(8)])::BIGINT AS morton FROM grid""")
def tile_grid(spark, sf_dir):
    return spatial.tiles(spark, part_shape(spark, sf_dir), TILE)


@query(f"WITH {_GRID} SELECT a.tile, b.tile AS neighbour FROM grid a JOIN grid b ON a.tile <> b.tile AND abs(a.iz - b.iz) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 1")
def tile_neighbours(spark, sf_dir):
    return spatial.neighbours(spatial.tiles(spark, part_shape(spark, sf_dir), TILE))


@query(f"WITH {_GRID} SELECT p.id, g.iz, g.iy, g.ix FROM parts p JOIN grid g ON p.z0 < g.iz * 32 + 32 AND g.iz * 32 < p.z1 AND p.y0 < g.iy * 64 + 64 AND g.iy * 64 < p.y1 AND p.x0 < g.ix * 64 + 64 AND g.ix * 64 < p.x1")
def box_tiles(spark, sf_dir):
    return spatial.covered_tiles(bind.parts(spark, sf_dir), TILE).select("id", "iz", "iy", "ix")


_PAIR = "least(a.z1, b.z1) - greatest(a.z0, b.z0)", "least(a.y1, b.y1) - greatest(a.y0, b.y0)", "least(a.x1, b.x1) - greatest(a.x0, b.x0)"


@query(f"WITH {bind.PARTS} SELECT a.id AS a_id, b.id AS b_id, ({_PAIR[0]}) * ({_PAIR[1]}) * ({_PAIR[2]}) AS volume FROM parts a JOIN parts b ON a.id < b.id AND {' AND '.join(f'{p} > 0' for p in _PAIR)}")
def overlapping_boxes(spark, sf_dir):
    rows = bind.parts(spark, sf_dir)
    return spatial.box_pairs(rows, rows, TILE, ordered=True).select("a_id", "b_id", "volume")


@query(f"WITH {bind.PARTS} SELECT a.id AS a_id, b.id AS b_id, greatest({', '.join(f'-({p})' for p in _PAIR)}, 0) AS gap FROM parts a JOIN parts b ON a.id < b.id AND a.split <> b.split AND greatest({', '.join(f'-({p})' for p in _PAIR)}) < 5")
def split_buffer(spark, sf_dir):
    return spatial.buffer_violations(bind.parts(spark, sf_dir), TILE, 5)


_STATUS = f"WITH {_GRID}, seen AS (SELECT o_custkey % 53 AS tile, max(o_orderstatus) AS status FROM orders GROUP BY 1), m AS (SELECT g.tile, (z1 - z0) * (y1 - y0) * (x1 - x0) AS voxels, coalesce(status, 'absent') AS status FROM grid g LEFT JOIN seen USING (tile))"


def _status(spark, sf_dir):
    seen = bind.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 53).alias("tile"), "o_orderstatus").groupBy("tile").agg(F.max("o_orderstatus").alias("status"))
    return spatial.missing_tiles(spatial.tiles(spark, part_shape(spark, sf_dir), TILE), seen)


@query(f"{_STATUS} SELECT tile, status FROM m")
def tile_status(spark, sf_dir):
    return _status(spark, sf_dir).select("tile", "status")


@query(f"{_STATUS} SELECT count(*) AS tiles, count_if(status IN ('P', 'F')) AS done, round(avg(CAST(status IN ('P', 'F') AS INTEGER)), 9) AS share_tiles, round(sum(CASE WHEN status IN ('P', 'F') THEN voxels ELSE 0 END) / sum(voxels), 9) AS share_voxels FROM m")
def tile_coverage(spark, sf_dir):
    return spatial.coverage(_status(spark, sf_dir), ("P", "F")).select("tiles", "done", F.round("share_tiles", 9).alias("share_tiles"), F.round("share_voxels", 9).alias("share_voxels"))


@query()
def separated_points(spark, sf_dir):
    return spatial.separated(bind.customers(spark, sf_dir), "nation", 12.0)


@query(f"""WITH {bind.VOXELS}, f AS (
  SELECT a.block, least(a.label, b.label) AS lo, greatest(a.label, b.label) AS hi FROM voxels a JOIN voxels b ON a.block = b.block AND a.label <> b.label AND a.label <> 0 AND b.label <> 0
   AND ((b.z = a.z + 1 AND b.y = a.y AND b.x = a.x) OR (b.z = a.z AND b.y = a.y + 1 AND b.x = a.x) OR (b.z = a.z AND b.y = a.y AND b.x = a.x + 1)))
SELECT block, lo, hi, count(*) AS n FROM f GROUP BY ALL""")
def label_contacts(spark, sf_dir):
    return spatial.faces(bind.voxels(spark, sf_dir), "block")


@query(f"WITH {bind.VOXELS} SELECT block, label, count(*) AS n, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM voxels WHERE label <> 0 GROUP BY 1, 2")
def label_objects(spark, sf_dir):
    rows = spatial.objects(bind.voxels(spark, sf_dir), "block")
    return rows.withColumns({c: F.round(c, 6) for c in ("cz", "cy", "cx")})


@query(f"""WITH {bind.VOXELS}, n AS (SELECT a.block, a.z, a.y, a.x, a.value + sum(b.value) AS total FROM voxels a JOIN (SELECT unnest([[1,0,0],[-1,0,0],[0,1,0],[0,-1,0],[0,0,1],[0,0,-1]]) AS d) ON true
 JOIN voxels b ON b.block = a.block AND b.z = greatest(0, least(3, a.z + d[1])) AND b.y = greatest(0, least(3, a.y + d[2])) AND b.x = greatest(0, least(3, a.x + d[3])) GROUP BY a.block, a.z, a.y, a.x, a.value)
SELECT block, z, y, x, round(total / 7, 6) AS value FROM n""")
def block_smoothing(spark, sf_dir):
    rows = spatial.smoothed(bind.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (4, 4, 4))
    return spatial.unrolled(rows, "vec_id", "embedding", (4, 4, 4)).select(F.col("vec_id").alias("block"), "z", "y", "x", F.round("value", 6).alias("value"))


@query("""WITH c AS (SELECT o_custkey, least(2 * o_custkey, min(2 * o_orderkey + 1)) AS root FROM orders GROUP BY 1)
SELECT 2 * o_custkey AS node, root FROM c UNION ALL SELECT 2 * o_orderkey + 1, root FROM orders JOIN c USING (o_custkey)""")
def order_components(spark, sf_dir):
    """Orders and customers linked by who ordered, over the whole table."""
    edges_ = bind.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("a"), (F.col("o_orderkey") * 2 + 1).alias("b"))
    return graph.components(edges_)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 97 AS b FROM lineitem), w(node, level) AS (
  SELECT 1::BIGINT, 0 UNION SELECT e.b, w.level + 1 FROM w JOIN e ON e.a = w.node WHERE w.level < 5)
SELECT node, min(level) AS level FROM w GROUP BY node""")
def reach_levels(spark, sf_dir):
    """SQL stops at five steps, which reach all of this dense graph; the operator stops where nothing new is reached."""
    rows = bind.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 97).alias("b")).distinct()
    return graph.levels(rows, spark.createDataFrame([(1,)], "node long"))


_TREE_EDGES = f"{bind.TREE}, te AS (SELECT c.tree, c.node AS child, c.parent, sqrt((c.z - p.z) ** 2 + (c.y - p.y) ** 2 + (c.x - p.x) ** 2) AS length FROM nodes c JOIN nodes p ON p.tree = c.tree AND p.node = c.parent)"


@query(f"""WITH {_TREE_EDGES}, k AS (SELECT tree, parent AS node, count(*) AS children FROM te GROUP BY 1, 2)
SELECT n.tree, count(*) AS nodes, any_value(coalesce(c.edges, 0)) AS edges, count_if(children > 1) AS branches, count_if(children IS NULL) AS ends, round(any_value(coalesce(c.cable, 0)), 6) AS cable
FROM nodes n LEFT JOIN k USING (tree, node) LEFT JOIN (SELECT tree, count(*) AS edges, sum(length) AS cable FROM te GROUP BY 1) c ON c.tree = n.tree GROUP BY n.tree""")
def tree_figures(spark, sf_dir):
    nodes = bind.tree(spark, sf_dir)
    return graph.tree_figures(nodes, graph.tree_edges(nodes)).withColumn("cable", F.round("cable", 6))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 250")
def top_orders(spark, sf_dir):
    return ranking.top(bind.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 250, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def top_three_each(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.top_each(rows, 3, ["l_suppkey"], F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")).drop("l_extendedprice")


@query("""WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS b, quantile_cont(n_chars, 0.75) AS c FROM documents)
SELECT doc_id, n_chars, CASE WHEN n_chars < a THEN 'Q1' WHEN n_chars < b THEN 'Q2' WHEN n_chars < c THEN 'Q3' ELSE 'Q4' END AS stratum FROM documents, q""")
def length_strata(spark, sf_dir):
    return ranking.strata(bind.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars")


@query("SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY sha256(source || '|' || lang || '|' || doc_id)) AS rk FROM documents) WHERE rk = 1")
def hash_picks(spark, sf_dir):
    return ranking.hash_pick(bind.table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["source", "lang", "doc_id"]).drop("digest")


@query("""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS rk, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
b AS (SELECT * FROM (VALUES (0, 0.0, 0.1), (1, 0.4, 0.6), (2, 0.9, 1.0)) v(band, lo, hi))
SELECT c_nationkey, band, arg_min(c_custkey, rk) AS c_custkey FROM r, b WHERE rk >= floor(n * lo::DOUBLE) AND rk < ceil(n * hi::DOUBLE) GROUP BY 1, 2""")
def rank_bands(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return ranking.bands(rows, ["c_nationkey"], [(0.0, 0.1), (0.4, 0.6), (0.9, 1.0)], F.desc("c_acctbal"), F.asc("c_custkey")).drop("c_acctbal")


@query("SELECT p_partkey, (p_partkey + p_size) % 3 AS turn FROM part")
def interleaved_parts(spark, sf_dir):
    return ranking.interleaved(bind.table(spark, sf_dir, "part").select("p_partkey", "p_size"), 3, F.col("p_partkey"), F.col("p_size")).drop("p_size")


@query("SELECT c_custkey, CAST(round_even(c_acctbal / 8, 0) AS BIGINT) AS voxel, CAST(floor(c_acctbal / 32) AS BIGINT) AS tile FROM customer")
def voxel_positions(spark, sf_dir):
    at = F.col("c_acctbal")
    return bind.table(spark, sf_dir, "customer").select("c_custkey", grid.to_voxel(at, 0.0, 8.0).alias("voxel"), grid.tile_of(at, 32).alias("tile"))


@query(f"WITH {bind.EVENTS} SELECT time_bucket(INTERVAL 1 hour, ts) AS begins, decision, count(*) AS n, round(sum(value), 6) AS value FROM ev WHERE reviewer IS NOT NULL AND item IS NOT NULL AND decision IN ('view', 'click', 'purchase') GROUP BY 1, 2")
def hourly_decisions(spark, sf_dir):
    rows = reviews.once(reviews.valid(bind.events(spark, sf_dir), ("view", "click", "purchase")))
    return reviews.per_window(rows).withColumn("value", F.round("value", 6))


@query(f"""WITH {bind.EVENTS} SELECT item, count(*) AS n, arg_min(decision, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS first,
  CASE WHEN count(DISTINCT decision) > 1 THEN 'mixed' ELSE arg_min(decision, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) END AS verdict
FROM (SELECT event_id, ts, decision, item * 1000 + reviewer % 1000 AS item FROM ev) GROUP BY item""")
def streamed_verdicts(spark, sf_dir):
    """The events as a stream with state for each item; what each batch gives goes to the shared folder, the last row an item counts."""
    kept = "event_id long, user_id long, event_type string, props string, value double, ts timestamp_ntz"
    stream = spark.readStream.schema(kept).parquet(f"{sf_dir}/events[.]parquet")  # as a pattern, which may be a file or a folder
    item = F.from_json("props", "k bigint")["k"] * 1000 + F.col("user_id") % 1000
    rows = stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("decision"), item.alias("item"))
    folder = scratch(spark, "verdicts")
    write = lambda batch, _: batch.write.mode("append").parquet(f"{folder}/rows")
    run = reviews.running_verdicts(rows).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    run.foreachBatch(write).start().awaitTermination()
    last = F.max_by(F.struct("n", "first", "verdict"), "n").alias("r")
    return spark.read.schema("item long, n long, first string, verdict string").parquet(f"{folder}/rows").groupBy("item").agg(last).select("item", "r.*")
