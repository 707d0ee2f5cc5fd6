"""Queries of rule tables, gates, build comparison, traces and figures of contacts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquarry.functions import boxes, keys
from meshquarry.operators import builds, gates, graph, metrics, ranking, relational, rules, spatial
from meshquarry.plans import bind
from meshquarry.plans.catalog import _GRID, TILE, part_shape, query

_KEY = "l_orderkey, l_linenumber"
_STATUS_OF = {1: "clean", 2: "Uncertain ", 3: "ok", 4: "odd", 5: "partial", 6: "resolved"}
_CAND = """cand AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_discount * 10 AS pc, l_tax * 12.5 AS ie, l_quantity / 50 AS sc, (l_partkey % 101) / 100 AS ma, (l_suppkey % 89) / 88 AS mc,
  CASE l_linenumber WHEN 1 THEN 'clean' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'ok' WHEN 4 THEN 'odd' WHEN 5 THEN 'partial' WHEN 6 THEN 'resolved' ELSE '' END AS status FROM lineitem),
c AS (SELECT *, (pc + ie + sc + ma + mc) / 5 AS m FROM (SELECT * REPLACE (least(1, greatest(0, pc)) AS pc, least(1, greatest(0, ie)) AS ie, least(1, greatest(0, sc)) AS sc, least(1, greatest(0, ma)) AS ma, least(1, greatest(0, mc)) AS mc) FROM cand))"""


def candidates(spark, sf_dir) -> DataFrame:
    """Candidates with five confidences and the status of their border."""
    status = F.lit(None).cast("string")
    for n, name in _STATUS_OF.items():
        status = F.when(F.col("l_linenumber") == n, name).otherwise(status)
    return bind.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_discount") * 10).alias("prediction"), (F.col("l_tax") * 12.5).alias("image"), (F.col("l_quantity") / 50).alias("segmentation"),
        (F.col("l_partkey") % 101 / 100).alias("agreement"), (F.col("l_suppkey") % 89 / 88).alias("morphology"), status.alias("status"),
    )


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {_CAND} SELECT {_KEY}, CASE WHEN pc < 0.2 OR ie < 0.15 THEN 'REJECTED' WHEN ma < 0.4 AND abs(pc - ie) > 0.4 THEN 'CONFLICTING'
  WHEN pc >= 0.75 AND ie >= 0.75 AND sc >= 0.75 AND ma >= 0.8 AND mc >= 0.7 AND status IN ('clean', 'ok', 'resolved') THEN 'SUPPORTED'
  WHEN m >= 0.6 AND ma >= 0.55 AND abs(pc - ie) <= 0.35 THEN 'PROBABLE'
  WHEN status IN ('uncertain', 'partial', 'crossing', 'ambiguous') OR (m >= 0.4 AND m < 0.6 AND abs(pc - ie) >= 0.25) THEN 'AMBIGUOUS' ELSE 'REVIEW' END AS verdict FROM c""")
def candidate_verdicts(spark, sf_dir):
    return candidates(spark, sf_dir).select("l_orderkey", "l_linenumber", rules.verdict().alias("verdict"))


_GAIN = f"""WITH {_CAND}, p AS (SELECT *, abs(pc - ie) * (1 - ma) AS k, CASE WHEN status IN ('uncertain', 'partial') THEN 0.35 WHEN status = 'odd' THEN 0.15 ELSE 0 END::DOUBLE AS pen FROM c),
r AS (SELECT *, [greatest(0, m * ma * (1 - k) - pen), greatest(0, m * 0.85 - k * 0.5), greatest(0, 0.25 + pen + (0.5 - abs(m - 0.5))), greatest(0, k * 1.5), greatest(0, (1 - mc) * 0.6 + (1 - m) * 0.2), CASE WHEN m < 0.35 THEN (0.35 - m) * 2 ELSE 0 END]::DOUBLE[] AS raw FROM p),
s AS (SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS w FROM r),
g AS (SELECT *, list_sum(list_transform(w, lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END)) AS entropy, entropy * (1 - m) * (1 - mc) AS gain FROM s)"""


@query(f"{_GAIN} SELECT {_KEY}, round(w[1], 9) AS supported, round(w[2], 9) AS probable, round(w[3], 9) AS ambiguous, round(w[4], 9) AS conflicting, round(w[5], 9) AS review, round(w[6], 9) AS rejected, round(entropy, 9) AS entropy, round(gain, 9) AS gain FROM g")
def candidate_masses(spark, sf_dir):
    rows = rules.with_gain(candidates(spark, sf_dir)).drop("l_suppkey", *rules.EVIDENCE, "status")
    return rounded(rows, *(c for c in rows.columns if not c.startswith("l_")))


@query(f"{_GAIN} SELECT {_KEY}, l_suppkey FROM g ORDER BY round(gain, 9) DESC, l_suppkey, {_KEY} LIMIT 200")
def review_queue(spark, sf_dir):
    rows = rounded(rules.with_gain(candidates(spark, sf_dir)), "gain")
    return ranking.top(rows, 200, F.desc("gain"), F.asc("l_suppkey"), F.asc("l_orderkey"), F.asc("l_linenumber")).select("l_orderkey", "l_linenumber", "l_suppkey")


_REGION = "r AS (SELECT p_partkey, (p_partkey % 53) / 52 AS tissue, (p_size % 50) / 8 AS info, (p_partkey % 31) / 60 AS border, (p_partkey % 17) / 100 AS artifact, (p_partkey % 41) / 40 AS doubt, (p_partkey % 7) / 6 AS prior FROM part)"
_CLASS = """CASE WHEN artifact >= 0.12 THEN 'ARTIFACT' WHEN tissue < 0.05 AND info < 0.8 THEN 'EMPTY' WHEN doubt >= 0.75 THEN 'UNCERTAIN' WHEN prior >= 0.5 AND doubt >= 0.45 THEN 'REPROCESS'
  WHEN border >= 0.25 OR info >= 4.5 THEN 'HIGH_COMPLEXITY' WHEN info < 1.2 AND border < 0.08 AND tissue < 0.35 THEN 'LOW_INFORMATION' ELSE 'NORMAL' END"""


@query(f"""WITH {_REGION}, k AS (SELECT *, {_CLASS} AS class FROM r) SELECT p_partkey, class, round(least(1, greatest(0, 0.3 * doubt + 0.25 * artifact + 0.2 * least(1, border / 0.5) + 0.15 * (1 - prior) + 0.1 * least(1, info / 8)
  + CASE class WHEN 'ARTIFACT' THEN 0.25 WHEN 'UNCERTAIN' THEN 0.22 WHEN 'REPROCESS' THEN 0.18 WHEN 'HIGH_COMPLEXITY' THEN 0.15 WHEN 'NORMAL' THEN 0.05 WHEN 'LOW_INFORMATION' THEN 0.02 ELSE 0 END)), 9) AS priority FROM k""")
def region_classes(spark, sf_dir):
    k = F.col("p_partkey")
    at = {"tissue": k % 53 / 52, "info": F.col("p_size") % 50 / 8, "border": k % 31 / 60, "artifact": k % 17 / 100, "doubt": k % 41 / 40, "prior": k % 7 / 6}
    rows = bind.table(spark, sf_dir, "part").select("p_partkey", *(v.alias(c) for c, v in at.items()))
    c = [F.col(x) for x in at]
    rows = rows.withColumn("class", rules.region_class(*c))
    return rows.select("p_partkey", "class", F.round(rules.region_priority(F.col("class"), *c[1:]), 9).alias("priority"))


def _side(a: str, b: str, axis: str) -> str:
    return f"greatest(0, least({a}.{axis}1, {b}.{axis}1) - greatest({a}.{axis}0, {b}.{axis}0) + 1)"


_VOL = {p: " * ".join(f"greatest(1, {p}.{x}1 - {p}.{x}0 + 1)" for x in "zyx") for p in "ab"}


@query(f"""WITH {bind.PARTS}, q AS (SELECT a.id AS a_id, b.id AS b_id, {" * ".join(_side("a", "b", x) for x in "zyx")} AS both_, {_VOL["a"]} AS va, {_VOL["b"]} AS vb,
  sqrt(((a.z0 + a.z1 - b.z0 - b.z1) / 2.0) ** 2 + ((a.y0 + a.y1 - b.y0 - b.y1) / 2.0) ** 2 + ((a.x0 + a.x1 - b.x0 - b.x1) / 2.0) ** 2) AS d, ((a.id * 7 + b.id) % 11) / 10 AS dir FROM parts a JOIN parts b ON b.id = a.id + 8),
s AS (SELECT *, both_ / least(va, vb) AS overlap, least(va, vb) / greatest(va, vb) AS ratio, both_ / (va + vb - both_) AS iou FROM q),
t AS (SELECT *, 0.5 * ratio + 0.5 * iou AS morph FROM s), u AS (SELECT *, least(1, greatest(0, 0.3 * overlap + 0.25 * dir + 0.25 * morph + 0.2 * exp(-d / 16.0))) AS conf FROM t)
SELECT a_id, b_id, round(iou, 9) AS iou, round(conf, 9) AS confidence, CASE WHEN conf >= 0.75 AND overlap >= 0.2 AND morph >= 0.5 THEN 'MATCH' WHEN conf >= 0.6 AND overlap >= 0.35 AND ratio < 0.4 THEN 'MERGE'
 WHEN overlap < 0.05 AND d < 8 AND dir < 0.3 THEN 'SPLIT' WHEN conf < 0.35 THEN 'HOLD' ELSE 'REVIEW' END AS action FROM u""")
def seam_actions(spark, sf_dir):
    """Objects on either side of a seam: here every part with the one eight further on."""
    rows = bind.parts(spark, sf_dir)
    a, b = (rows.select(*(F.col(c).alias(f"{p}_{c}") for c in rows.columns)) for p in "ab")
    pairs = a.join(b, F.col("b_id") == F.col("a_id") + 8)
    size = {p: F.lit(1) for p in "ab"}
    both, square = F.lit(1), F.lit(0.0)
    for x in "zyx":
        both = both * F.greatest(F.lit(0), F.least(F.col(f"a_{x}1"), F.col(f"b_{x}1")) - F.greatest(F.col(f"a_{x}0"), F.col(f"b_{x}0")) + 1)
        square = square + F.pow((F.col(f"a_{x}0") + F.col(f"a_{x}1") - F.col(f"b_{x}0") - F.col(f"b_{x}1")) / 2, F.lit(2))
        size = {p: v * F.greatest(F.lit(1), F.col(f"{p}_{x}1") - F.col(f"{p}_{x}0") + 1) for p, v in size.items()}
    low, high = F.least(*size.values()), F.greatest(*size.values())
    pairs = pairs.withColumns({"overlap": both / low, "ratio": low / high, "iou": rules.inclusive_iou("a_", "b_"), "d": F.sqrt(square), "dir": (F.col("a_id") * 7 + F.col("b_id")) % 11 / 10})
    pairs = pairs.withColumn("morph", 0.5 * F.col("ratio") + 0.5 * F.col("iou"))
    pairs = pairs.withColumn("confidence", rules.seam_confidence(F.col("overlap"), F.col("dir"), F.col("morph"), F.col("d"), 8))
    action = rules.seam_action(*(F.col(c) for c in ("confidence", "overlap", "morph", "ratio", "d", "dir")), 8)
    return rounded(pairs.select("a_id", "b_id", "iou", "confidence", action.alias("action")), "iou", "confidence")


@query("""WITH b AS (SELECT o_orderkey, (o_orderkey % 29) * 1.0::DOUBLE AS d, (o_orderkey % 23) / 22 AS dir, (o_custkey % 19) / 18 AS diam, (o_orderkey % 13) / 12 AS seg, (o_custkey % 11) / 10 AS img, (o_orderkey % 7) / 6 AS model FROM orders),
e AS (SELECT *, diam * (0.5 + 0.5 * dir) AS shape FROM b),
s AS (SELECT *, CASE WHEN d <= 5 THEN least(1, 1 - d / 5) ELSE 0 END + CASE WHEN dir > 0.7 THEN dir ELSE 0 END + CASE WHEN diam > 0.7 THEN diam ELSE 0 END + CASE WHEN shape > 0.6 THEN shape ELSE 0 END + CASE WHEN img > 0.55 THEN abs(img - 0.5) * 2 ELSE 0 END + CASE WHEN model > 0.55 THEN abs(model - 0.5) * 2 ELSE 0 END AS mg,
 CASE WHEN d > 5 THEN least(1, (d - 5) / 20) ELSE 0 END + CASE WHEN dir <= 0.7 THEN 1 - dir ELSE 0 END + CASE WHEN diam <= 0.7 THEN 1 - diam ELSE 0 END + CASE WHEN seg < 0.6 THEN 1 - seg ELSE 0 END + CASE WHEN shape <= 0.6 THEN 1 - shape ELSE 0 END + CASE WHEN img <= 0.55 THEN abs(img - 0.5) * 2 ELSE 0 END + CASE WHEN model <= 0.55 THEN abs(model - 0.5) * 2 ELSE 0 END AS sp FROM e),
n AS (SELECT *, round(mg / greatest(mg + sp, 1e-6), 9) AS m, round(sp / greatest(mg + sp, 1e-6), 9) AS s FROM s)
SELECT o_orderkey, m AS merge_share, s AS split_share, CASE WHEN abs(m - s) < 0.15 OR seg < 0.5 THEN 'REVIEW' WHEN m >= 0.62 THEN 'MERGE' WHEN s >= 0.62 THEN 'SPLIT' ELSE 'REVIEW' END AS decision FROM n""")
def branch_decisions(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = bind.table(spark, sf_dir, "orders").select("o_orderkey", (o % 13 / 12).alias("seg"), *(v.alias(n) for n, v in zip(("merge_share", "split_share"), rules.branch_sums((o % 29).cast("double"), o % 23 / 22, c % 19 / 18, o % 13 / 12, c % 11 / 10, o % 7 / 6), strict=True)))
    rows = rounded(rows, "merge_share", "split_share")
    return rows.select("o_orderkey", "merge_share", "split_share", rules.branch_decision(F.col("merge_share"), F.col("split_share"), F.col("seg")).alias("decision"))


_MESSAGES = ["GPU Out Of Memory", "bad checksum", "value is NaN", "worker died", "short read at 7", "assertion failed", "no idea", "Truncated file"]


@query(f"""WITH f AS (SELECT event_id, lower(({_MESSAGES!r})[1 + event_id % 9]) AS t FROM events)
SELECT event_id, CASE WHEN t LIKE '%oom%' OR t LIKE '%out of memory%' THEN 'OOM' WHEN t LIKE '%corrupt%' OR t LIKE '%checksum%' OR t LIKE '%truncated%' THEN 'CORRUPT_INPUT' WHEN t LIKE '%nan%' OR t LIKE '%inf%' THEN 'NAN'
 WHEN t LIKE '%crash%' OR t LIKE '%worker died%' THEN 'WORKER_CRASH' WHEN t LIKE '%truncat%' OR t LIKE '%short read%' THEN 'OUTPUT_TRUNCATED' WHEN t LIKE '%assertion%' THEN 'DETERMINISTIC_FAILURE' ELSE 'UNKNOWN' END AS diagnosis FROM f""")
def failure_diagnoses(spark, sf_dir):
    message = F.get(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 9).cast("int"))
    return bind.table(spark, sf_dir, "events").select("event_id", rules.diagnosis(message).alias("diagnosis"))


@query(f"""WITH {bind.VOXELS} SELECT block, label, round(1 - abs(2 * least(1, abs(avg(value))) - 1), 9) AS doubt, round((1 - abs(2 * least(1, abs(avg(value))) - 1)) * ln(1 + count(*)), 9) AS score FROM voxels GROUP BY block, label""")
def review_scores(spark, sf_dir):
    rows = bind.voxels(spark, sf_dir).groupBy("block", "label").agg(F.least(F.lit(1.0), F.abs(F.avg("value"))).alias("a"), F.count("*").alias("n"))
    doubt, score = rules.review_scores(F.col("a"), F.col("n"))
    return rows.select("block", "label", F.round(doubt, 9).alias("doubt"), F.round(score, 9).alias("score"))


_META = "meta AS (SELECT s_suppkey, s_nationkey % 3 AS checkpoint_a, s_nationkey % 4 AS checkpoint_b, s_suppkey % 5 AS config_a, s_suppkey % 2 AS config_b, s_suppkey % 7 AS splits FROM supplier)"


@query(f"""WITH {_META}, s AS (SELECT s_suppkey, unnest([{{'cause': 'checkpoint_changed', 'score': CASE WHEN checkpoint_a <> checkpoint_b THEN 3.0 ELSE 0 END}}, {{'cause': 'segmentation_config_changed', 'score': CASE WHEN config_a <> config_b THEN 2.5 ELSE 0 END + CASE WHEN splits > 0 THEN 1.0 ELSE 0 END}},
 {{'cause': 'boundary_reconciliation_changed', 'score': CASE WHEN splits > 0 THEN 1.5 + 0.1 * splits ELSE 0 END}}]) AS c FROM meta)
SELECT s_suppkey, c.cause AS cause, CAST(round(c.score, 4) AS DOUBLE) AS score, row_number() OVER (PARTITION BY s_suppkey ORDER BY c.score DESC, c.cause) AS rank FROM s WHERE c.score > 0""")
def likely_causes(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    rows = bind.table(spark, sf_dir, "supplier").select("s_suppkey", (n % 3).alias("ca"), (n % 4).alias("cb"), (k % 5).alias("ga"), (k % 2).alias("gb"), (k % 7).alias("splits"))
    split = F.col("splits") > 0
    weights = {
        "checkpoint_changed": [(~F.col("ca").eqNullSafe(F.col("cb")), 3.0)],
        "segmentation_config_changed": [(~F.col("ga").eqNullSafe(F.col("gb")), 2.5), (split, 1.0)],
        "boundary_reconciliation_changed": [(split, 1.5 + 0.1 * F.col("splits"))],
    }
    return rules.causes(rows, "s_suppkey", weights).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {bind.SITES} SELECT id, 'missing post' AS problem FROM sites WHERE pre IS NULL UNION ALL SELECT id, 'confidence out of range' FROM sites WHERE confidence > 0.95
UNION ALL SELECT id, 'expert review of an unverified site' FROM sites WHERE review = 'expert' AND NOT verified
UNION ALL SELECT id, 'orphan order' FROM sites WHERE evidence NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000)
UNION ALL SELECT o_orderkey::VARCHAR, 'no verified site' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT evidence FROM sites WHERE verified)""")
def integrity_report(spark, sf_dir):
    rows, orders = bind.sites(spark, sf_dir), bind.table(spark, sf_dir, "orders")
    own = gates.violations(rows, F.col("id"), {
        "missing post": F.col("pre").isNull(),
        "confidence out of range": F.col("confidence") > 0.95,
        "expert review of an unverified site": (F.col("review") == "expert") & ~F.col("verified"),
    })
    claims = relational.unsupported(orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("evidence")), "evidence", rows, F.col("verified"))
    lost = gates.dangling(rows, "id", "evidence", orders.where("o_totalprice > 1000"), "o_orderkey", "orphan order")
    return gates.all_of([own, lost, claims.select(F.col("evidence").cast("string").alias("id"), F.lit("no verified site").alias("problem"))])


_COHORT = "co AS (SELECT l_shipdate::DATE - DATE '1990-01-01' AS d, 'axis' || (l_partkey % 400) AS axis, CASE WHEN l_suppkey % 2 = 0 THEN 'train' ELSE 'validation' END AS split, l_suppkey AS source, CASE WHEN l_quantity > 45 THEN 'different' ELSE 'same' END AS kind FROM lineitem)"


def cohort(spark, sf_dir) -> DataFrame:
    return bind.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("axis"), F.col("l_partkey") % 400).alias("axis"), F.when(F.col("l_suppkey") % 2 == 0, "train").otherwise("validation").alias("split"), F.col("l_suppkey").alias("source"), F.when(F.col("l_quantity") > 45, "different").otherwise("same").alias("kind")
    )


@query(f"""WITH {_COHORT}, s AS (SELECT DISTINCT axis, split, source, kind FROM co),
n AS (SELECT axis, count(DISTINCT source) FILTER (split = 'train' AND kind = 'same') AS ts, count(DISTINCT source) FILTER (split = 'train' AND kind = 'different') AS td, count(DISTINCT source) FILTER (split = 'validation' AND kind = 'same') AS vs, count(DISTINCT source) FILTER (split = 'validation' AND kind = 'different') AS vd FROM s GROUP BY axis),
b AS (SELECT axis, count(*) AS both_ FROM (SELECT axis, source FROM s WHERE split = 'train' GROUP BY 1, 2 HAVING count(DISTINCT kind) = 2) GROUP BY axis)
SELECT axis, ts > 0 AND td > 0 AND vs > 0 AND vd > 0 AS covered, ts >= 2 AND td >= 2 AS repeated, coalesce(both_, 0) > 0 AS mixed, covered AND repeated AND mixed AS evaluable FROM n LEFT JOIN b USING (axis)""")
def axis_identifiability(spark, sf_dir):
    return gates.identifiable(cohort(spark, sf_dir), "axis", "same", "different").select("axis", "covered", "repeated", "mixed", "evaluable")


@query(f"WITH {_COHORT} SELECT axis, kind, count(DISTINCT source) AS sources, sources >= 2 AS replicated FROM co GROUP BY 1, 2")
def source_supply(spark, sf_dir):
    return gates.supply(cohort(spark, sf_dir), "axis")


_SIX = ["signup", "purchase", "error", "view", "click", "withdrawn"]


@query(f"WITH {bind.EVENTS}, x AS (SELECT d.decision, s.split, count(event_id) AS n FROM (SELECT unnest({_SIX!r}) AS decision) d CROSS JOIN (SELECT unnest([0, 1, 2]) AS split) s LEFT JOIN ev ON ev.decision = d.decision AND ev.reviewer % 3 = s.split GROUP BY 1, 2) SELECT decision, CAST(sum(n) AS BIGINT) AS total, count_if(n = 0) AS deficient, deficient = 0 AS eligible FROM x GROUP BY 1")
def axis_eligibility(spark, sf_dir):
    rows = bind.events(spark, sf_dir).withColumn("split", (F.col("reviewer") % 3).cast("int"))
    return gates.eligible(relational.crosstab(rows, ["decision", "split"], {"decision": _SIX, "split": [0, 1, 2]}), "decision")


@query(f"""WITH {bind.EVENTS}, g AS (SELECT item * 1000 + reviewer % 1000 AS item, count(DISTINCT decision) AS k, min(decision) AS kind, max(event_id) AS event FROM ev WHERE item IS NOT NULL AND reviewer IS NOT NULL GROUP BY 1)
SELECT item, CASE WHEN k > 1 THEN 'conflict' WHEN kind IN ('error', 'view') THEN 'excluded' ELSE 'effective' END AS state, CASE WHEN state = 'effective' THEN kind END AS kind, CASE WHEN state = 'effective' THEN event END AS event FROM g""")
def collapsed_decisions(spark, sf_dir):
    rows = bind.events(spark, sf_dir).where("item IS NOT NULL AND reviewer IS NOT NULL").select((F.col("item") * 1000 + F.col("reviewer") % 1000).alias("item"), "decision", "event_id")
    return gates.collapsed(rows, "item", "decision", ["event_id"], ["error", "view"])


@query(f"""WITH {bind.PARTS}, c AS (SELECT *, 'P' || id % 9 AS parent FROM parts), p AS (SELECT 'P' || k AS parent, 380 AS dz, 300 + k AS dy, 520 AS dx FROM range(8) t(k)), j AS (SELECT c.*, dz, dy, dx FROM c LEFT JOIN p USING (parent))
SELECT id::VARCHAR AS id, 'reserved parent' AS problem FROM j WHERE parent = 'P3' UNION ALL SELECT id::VARCHAR, 'missing parent' FROM j WHERE dz IS NULL UNION ALL SELECT id::VARCHAR, 'exceeds parent' FROM j WHERE z1 > dz OR y1 > dy OR x1 > dx
UNION ALL SELECT a.id || '/' || b.id, 'overlap across splits' FROM c a JOIN c b ON a.id < b.id AND a.parent = b.parent AND a.split <> b.split AND a.z0 < b.z1 AND b.z0 < a.z1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.x0 < b.x1 AND b.x0 < a.x1""")
def crop_violations(spark, sf_dir):
    crops = bind.parts(spark, sf_dir).withColumn("parent", F.concat(F.lit("P"), F.col("id") % 9))
    parents = spark.range(8).select(F.concat(F.lit("P"), "id").alias("parent"), F.lit(380).alias("dz"), (F.col("id") + 300).alias("dy"), F.lit(520).alias("dx"))
    return gates.plan_violations(crops, parents, ["train", "test"], ["P3"], TILE)


@query("""SELECT CAST(sum(CASE WHEN s IN ('validated', 'cached') THEN v ELSE 0 END) AS BIGINT) AS validated, CAST(sum(CASE WHEN s = 'rejected' THEN v ELSE 0 END) AS BIGINT) AS rejected, CAST(sum(CASE WHEN s = 'uncertain' THEN v ELSE 0 END) AS BIGINT) AS uncertain,
  round(validated / 10000000, 9) AS coverage, greatest(0, 10000000 - validated - rejected - uncertain) AS unaccounted FROM (SELECT ['validated', 'cached', 'rejected', 'uncertain', 'lost'][1 + o_orderkey % 5] AS s, o_custkey % 100 AS v FROM orders)""")
def completeness_ledger(spark, sf_dir):
    status = F.get(F.array(*map(F.lit, ("validated", "cached", "rejected", "uncertain", "lost"))), (F.col("o_orderkey") % 5).cast("int"))
    rows = bind.table(spark, sf_dir, "orders").select(status.alias("s"), (F.col("o_custkey") % 100).alias("v"))
    return rounded(gates.ledger(rows, "s", "v", 10_000_000), "coverage")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER w, 4) AS spent, round(sum(o_totalprice) OVER w, 4) <= 500000 AS allowed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def budget_totals(spark, sf_dir):
    rows = gates.running_budget(bind.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_custkey", "o_totalprice", 500_000, "o_orderdate", "o_orderkey")
    return rounded(rows.select("o_orderkey", "spent", "allowed"), "spent", digits=4)


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unknown' WHEN a.z <> b.z THEN 'mismatch' ELSE 'matched' END AS state
FROM (SELECT o_orderkey AS k, o_custkey % 8 AS z FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 300000 THEN 9 ELSE o_custkey % 8 END AS z FROM orders WHERE o_orderpriority NOT LIKE '1%') b USING (k)""")
def unblinded_decisions(spark, sf_dir):
    orders = bind.table(spark, sf_dir, "orders")
    z = F.col("o_custkey") % 8
    sealed = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), z.alias("z"))
    told = orders.where("o_orderpriority NOT LIKE '1%'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_totalprice") > 300000, 9).otherwise(z).alias("z"))
    return gates.unblinded(sealed, told, "k", ["z"])


_TWO = "a AS (SELECT DISTINCT l_suppkey * 2 + CASE WHEN l_linenumber <= 3 THEN 1 ELSE 0 END AS obj, l_orderkey AS m FROM lineitem), b AS (SELECT DISTINCT l_suppkey * 2 + 1000000 + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS obj, l_orderkey AS m FROM lineitem)"
_MATCH = f"""WITH {_TWO}, sa AS (SELECT obj, count(*) AS n FROM a GROUP BY 1), sb AS (SELECT obj, count(*) AS n FROM b GROUP BY 1), o AS (SELECT a.obj AS x, b.obj AS y, count(*) AS n FROM a JOIN b USING (m) GROUP BY 1, 2),
m AS (SELECT x, y, round(o.n / (sa.n + sb.n - o.n), 6) AS overlap FROM o JOIN sa ON sa.obj = x JOIN sb ON sb.obj = y WHERE o.n / (sa.n + sb.n - o.n) >= 0.25)"""


def _members(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = bind.table(spark, sf_dir, "lineitem")
    a = rows.select((F.col("l_suppkey") * 2 + F.when(F.col("l_linenumber") <= 3, 1).otherwise(0)).alias("object"), F.col("l_orderkey").alias("member"))
    b = rows.select((F.col("l_suppkey") * 2 + 1_000_000 + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)).alias("object"), F.col("l_orderkey").alias("member"))
    return a, b


@query(f"{_MATCH} SELECT x AS source, y AS target, overlap FROM m WHERE x IN (SELECT x FROM m GROUP BY 1 HAVING count(*) >= 2)")
def build_splits(spark, sf_dir):
    return rounded(builds.splits(builds.overlaps(*_members(spark, sf_dir), 0.25)), "overlap", digits=6)


@query(f"{_MATCH} SELECT x AS source, y AS target, overlap FROM m WHERE y IN (SELECT y FROM m GROUP BY 1 HAVING count(*) >= 2)")
def build_merges(spark, sf_dir):
    return rounded(builds.merges(builds.overlaps(*_members(spark, sf_dir), 0.25)), "overlap", digits=6)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS pre, l_partkey % 50 AS post, l_linenumber FROM lineitem), d AS (SELECT node, side, count(*) AS n FROM (SELECT DISTINCT pre, post, unnest([pre, post]) AS node, 'a' AS side FROM e WHERE l_linenumber <= 3 UNION ALL SELECT DISTINCT pre, post, unnest([pre, post]), 'b' FROM e WHERE l_linenumber >= 3) GROUP BY 1, 2)
SELECT node, coalesce(sum(n) FILTER (side = 'a'), 0)::BIGINT AS a, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS b, b - a AS delta FROM d GROUP BY node HAVING coalesce(sum(n) FILTER (side = 'a'), 0) <> coalesce(sum(n) FILTER (side = 'b'), 0) AND node NOT IN (SELECT pre FROM e WHERE pre = post)""")
def degree_changes(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pre"), (F.col("l_partkey") % 50).alias("post"), "l_linenumber")
    loops = rows.where("pre = post").select(F.col("pre").alias("node")).distinct()
    a, b = (relational.degrees(rows.where(c).select("pre", "post").distinct()) for c in ("l_linenumber <= 3", "l_linenumber >= 3"))
    return builds.changes(a, b, "node", "degree").join(loops, "node", "left_anti")


@query("""WITH c AS (SELECT o_custkey AS id, o_orderstatus AS s, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / count(*) / 100 AS v FROM orders GROUP BY 1, 2),
o AS (SELECT id, max(v) FILTER (s = 'O') AS a, max(v) FILTER (s = 'F') AS b FROM c GROUP BY 1)
SELECT id, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM o WHERE a <> b""")
def confidence_changes(spark, sf_dir):
    """Means of whole cents, whose sums don't depend on their order."""
    orders = bind.table(spark, sf_dir, "orders")
    mean = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("*") / 100
    a, b = (orders.where(f"o_orderstatus = '{s}'").groupBy(F.col("o_custkey").alias("id")).agg(mean.alias("v")) for s in "OF")
    return rounded(builds.changes(a, b, "id", "v", shared=True), "a", "b", "delta", digits=6)


@query(f"""WITH {bind.PARTS}, m AS (SELECT id, (z0 + z1) / 2.0 AS z, (y0 + y1) / 2.0 AS y, (x0 + x1) / 2.0 AS x, (z0 + z1) / 2.0 + id % 3 AS z2, (x0 + x1) / 2.0 - id % 2 AS x2 FROM parts)
SELECT id, round(sqrt((z2 - z) ** 2 + (x2 - x) ** 2), 6) AS distance FROM m WHERE sqrt((z2 - z) ** 2 + (x2 - x) ** 2) > 1""")
def moved_objects(spark, sf_dir):
    at = bind.parts(spark, sf_dir).select("id", *(((F.col(f"{x}0") + F.col(f"{x}1")) / 2).alias(x) for x in "zyx"))
    moved = at.withColumns({"z": F.col("z") + F.col("id") % 3, "x": F.col("x") - F.col("id") % 2})
    return rounded(builds.moved(at, moved, "id", 1.0), "distance", digits=6)


_SETS = "s AS (SELECT o_custkey AS c, o_orderstatus AS side, list_sort(list(DISTINCT o_orderkey % 4)) AS members FROM orders GROUP BY 1, 2), a AS (SELECT DISTINCT members FROM s WHERE side = 'O'), b AS (SELECT DISTINCT members FROM s WHERE side = 'F')"


@query(f"WITH {_SETS} SELECT array_to_string(coalesce(a.members, b.members), ',') AS members, CASE WHEN a.members IS NULL THEN 'added' WHEN b.members IS NULL THEN 'removed' ELSE 'shared' END AS state FROM a FULL JOIN b ON a.members = b.members")
def set_changes(spark, sf_dir):
    """Groups compared as sets of members, whatever they are called."""
    rows = bind.table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", (F.col("o_orderkey") % 4).alias("m"))
    a, b = (builds.member_sets(rows.where(f"o_orderstatus = '{s}'"), "o_custkey", "m") for s in "OF")
    return relational.keyed_diff(a, b, ["members"]).select(F.array_join("members", ",").alias("members"), "state")


_FLOW = "e AS (SELECT DISTINCT c_nationkey AS a, 100 + c_custkey % 40 AS b FROM customer UNION SELECT DISTINCT 100 + c_custkey % 40, 1000 + c_custkey FROM customer UNION SELECT n_regionkey + 50, n_nationkey FROM nation)"


def _flow(spark, sf_dir) -> DataFrame:
    """Provenance: regions, nations, batches and customers, each from the one before."""
    k, b = F.col("c_custkey"), F.col("c_custkey") % 40 + 100
    c = bind.table(spark, sf_dir, "customer")
    parts = [c.select(F.col("c_nationkey").cast("long").alias("a"), b.alias("b")), c.select(b.alias("a"), (k + 1000).alias("b")), bind.table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 50).cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("b"))]
    return gates.all_of(parts).distinct()


def _walk(start: int, forward: bool) -> str:
    frm, to = ("a", "b") if forward else ("b", "a")
    return f"WITH RECURSIVE {_FLOW}, w(node, level) AS (SELECT {start}::BIGINT, 0 UNION SELECT e.{to}, w.level + 1 FROM w JOIN e ON e.{frm} = w.node) SELECT node, min(level) AS level FROM w GROUP BY node HAVING min(level) > 0"


@query(_walk(1007, False))
def trace_back(spark, sf_dir):
    return graph.ancestors(_flow(spark, sf_dir), spark.createDataFrame([(1007,)], "node long"))


@query(_walk(52, True))
def trace_forward(spark, sf_dir):
    return graph.descendants(_flow(spark, sf_dir), spark.createDataFrame([(52,)], "node long"))


_TOUCH = f"""{bind.VOXELS}, f AS (SELECT a.block, least(a.label, b.label) AS lo, greatest(a.label, b.label) AS hi, (a.value + b.value) / 2 AS v FROM voxels a JOIN voxels b ON a.block = b.block AND a.label <> b.label AND a.label <> 0 AND b.label <> 0
 AND ((b.z = a.z + 1 AND b.y = a.y AND b.x = a.x) OR (b.z = a.z AND b.y = a.y + 1 AND b.x = a.x) OR (b.z = a.z AND b.y = a.y AND b.x = a.x + 1)))"""


@query(f"WITH {_TOUCH} SELECT lo, hi, count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high, {', '.join(f'round(quantile_cont(v, {q}), 6) AS p{t}' for q, t in ((0.01, '01'), (0.05, '05'), (0.5, '50'), (0.95, '95'), (0.99, '99')))} FROM f GROUP BY 1, 2")
def contact_figures(spark, sf_dir):
    """Of each pair of labels the affinity over all its contacts."""
    rows = spatial.contact_figures(spatial.contacts(bind.voxels(spark, sf_dir), "block", value="value"), "lo", "hi")
    return rounded(rows, *(c for c in rows.columns if c not in ("lo", "hi", "n")), digits=6)


@query(f"WITH {_TOUCH}, e AS (SELECT block, lo, hi, avg(v) AS mean, count(*) AS n FROM f GROUP BY ALL) SELECT lo, hi, round(sum(mean * n) / sum(n), 6) AS pooled FROM e GROUP BY 1, 2")
def pooled_affinity(spark, sf_dir):
    by = spatial.contacts(bind.voxels(spark, sf_dir), "block", value="value").groupBy("block", "lo", "hi").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return rounded(metrics.pooled(by, ["lo", "hi"], "mean", "n"), "pooled", digits=6)


@query("""WITH h AS (SELECT o_orderkey % 200 AS k, max(o_totalprice) AS boost FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), g AS (SELECT c_nationkey AS k, max(c_acctbal) AS boost FROM customer GROUP BY 1)
SELECT p_partkey, coalesce(h.boost, g.boost, 0) AS boost FROM part LEFT JOIN h ON h.k = p_partkey LEFT JOIN g ON g.k = p_size""")
def hinted_tasks(spark, sf_dir):
    """Tasks with the hint under their own key, else under their second one, else none."""
    h = bind.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy((F.col("o_orderkey") % 200).alias("p_partkey")).agg(F.max("o_totalprice").alias("boost"))
    g = bind.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("p_size")).agg(F.max("c_acctbal").alias("boost"))
    tasks = bind.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return relational.with_hint(tasks, [("p_partkey", h), ("p_size", g)], "boost", 0.0).select("p_partkey", "boost")


@query("SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem a WHERE l_linenumber = 1 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linenumber = 2 AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey)")
def fresh_items(spark, sf_dir):
    """What is eligible, less what is used, by a key of several columns."""
    rows = bind.table(spark, sf_dir, "lineitem")
    return relational.fresh(rows.where("l_linenumber = 1").select("l_orderkey", "l_partkey", "l_suppkey").distinct(), ["l_partkey", "l_suppkey"], rows.where("l_linenumber = 2"))


@query("SELECT o_custkey AS key, list_sort(list(DISTINCT o_orderstatus)) [1] AS first, count(DISTINCT o_orderstatus) AS origins FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) GROUP BY 1")
def exclusion_union(spark, sf_dir):
    """A union of sets of keys, with how many they come from."""
    orders = bind.table(spark, sf_dir, "orders")
    parts = {s: orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key")) for s in "OFP"}
    return relational.union_with_origin(parts, ["key"]).select("key", "first", "origins")


@query("WITH p AS (SELECT c_nationkey, c_custkey, (c_custkey * 7919 % 97)::DOUBLE AS z, (c_custkey * 104729 % 89)::DOUBLE AS y, (c_custkey * 1299709 % 83)::DOUBLE AS x FROM customer) SELECT c_custkey AS id FROM p a WHERE c_nationkey < 20 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.c_nationkey >= 20 AND (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2 < 64)")
def far_points(spark, sf_dir):
    rows = bind.customers(spark, sf_dir)
    return spatial.far_from(rows.where("nation < 20").select("id", "z", "y", "x"), rows.where("nation >= 20").select("z", "y", "x"), 8.0).select("id")


@query(f"""SELECT o_orderkey AS id, 'Q-' || upper(substr(sha256('seed|' || o_orderkey), 1, 12)) AS opaque, printf('z%03d_y%03d_x%03d', o_orderkey % 7, o_orderkey % 11, o_orderkey % 13) AS tile,
 (o_orderkey % 11)::INTEGER AS iy, o_orderpriority LIKE '1-%' AS well_formed, o_orderkey % 17 <> 0 AS finite FROM orders""")
def item_keys(spark, sf_dir):
    o = F.col("o_orderkey")
    tile = keys.tile_key(o % 7, o % 11, o % 13)
    value = F.when(o % 17 == 0, F.lit(float("nan"))).otherwise(o.cast("double"))
    return bind.table(spark, sf_dir, "orders").select(o.alias("id"), keys.opaque_id("Q-", F.lit("seed"), o).alias("opaque"), tile.alias("tile"), keys.tile_index(tile)[1].alias("iy"), keys.well_formed(F.col("o_orderpriority"), "1-").alias("well_formed"), keys.finite(value).alias("finite"))


@query(f"WITH {bind.EVENTS}, l AS (SELECT item, max(ts) AS last FROM ev WHERE item IS NOT NULL GROUP BY 1) SELECT item, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(last)) AS BIGINT) AS age, age > 86400 AS stale FROM l")
def stale_items(spark, sf_dir):
    last = bind.events(spark, sf_dir).where("item IS NOT NULL").groupBy("item").agg(F.max("ts").alias("last"))
    return relational.stale(last, "last", F.lit("2024-02-01").cast("timestamp"), 86_400).select("item", "age", "stale")


@query("SELECT a.n_regionkey AS held_out, list_sort(list(b.n_regionkey))::VARCHAR AS others FROM (SELECT DISTINCT n_regionkey FROM nation) a JOIN (SELECT DISTINCT n_regionkey FROM nation) b ON a.n_regionkey <> b.n_regionkey GROUP BY 1")
def fold_arrays(spark, sf_dir):
    rows = relational.leave_one_out(bind.table(spark, sf_dir, "nation"), "n_regionkey")
    return rows.groupBy("held_out").agg(F.array_sort(F.collect_list("n_regionkey")).cast("string").alias("others"))


@query(f"WITH {bind.EVENTS} SELECT reviewer % 10 AS source, count_if(decision = 'view') AS view, count_if(decision = 'click') AS click, count_if(decision = 'purchase') AS purchase FROM ev GROUP BY 1")
def exposure_by_source(spark, sf_dir):
    rows = bind.events(spark, sf_dir).select((F.col("reviewer") % 10).alias("source"), "decision")
    kinds = ["view", "click", "purchase"]
    return rows.groupBy("source").agg(*(F.count_if(F.col("decision") == k).alias(k) for k in kinds))


@query("""WITH r AS (SELECT l_orderkey, l_quantity / 50 AS p, l_returnflag = 'R' AS pos FROM lineitem), g AS (SELECT l_orderkey, pos, round(avg(p), 9) AS p FROM r GROUP BY 1, 2)
SELECT pos, count(*) AS items, round(avg(p), 9) AS mean, round(avg(CAST((p >= 0.5) = pos AS INTEGER)), 9) AS accuracy, round(avg(abs(p - 0.5)), 9) AS margin FROM g GROUP BY 1""")
def item_level_accuracy(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") / 50).alias("p"), (F.col("l_returnflag") == "R").alias("pos"))
    return rounded(metrics.item_accuracy(rows, "l_orderkey", "pos", "p"), "mean", "accuracy", "margin")


@query(f"""WITH {_GRID} SELECT tile, greatest(0, z0 - 4) AS rz0, least(nz, z1 + 4) AS rz1, greatest(0, y0 - 8) AS ry0, least(ny, y1 + 8) AS ry1, greatest(0, x0 - 8) AS rx0, least(nx, x1 + 8) AS rx1,
 (iz > 0)::INTEGER + (iz < tz - 1)::INTEGER + (iy > 0)::INTEGER + (iy < ty - 1)::INTEGER + (ix > 0)::INTEGER + (ix < tx - 1)::INTEGER AS faces FROM grid""")
def halo_chunks(spark, sf_dir):
    shape = part_shape(spark, sf_dir)
    return spatial.with_halo(spatial.tiles(spark, shape, TILE), shape, TILE, (4, 8, 8)).select("tile", *(f"r{x}{k}" for x in boxes.AXES for k in (0, 1)), "faces")


@query(f"""WITH {bind.VOXELS}, b AS (SELECT block, least(255, CAST(floor(abs(value) * 256) AS BIGINT)) AS bin FROM voxels), c AS (SELECT block, bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT block, round(sum(CASE WHEN bin BETWEEN 64 AND 192 THEN n ELSE 0 END) / sum(n), 9) AS tissue, round(-sum(n / 64 * log2(n / 64)), 9) AS information FROM c GROUP BY 1""")
def block_features(spark, sf_dir):
    rows = bind.voxels(spark, sf_dir).select("block", F.least(F.lit(255), F.floor(F.abs("value") * 256)).alias("bin"))
    return rounded(metrics.histogram_features(rows, "block", "bin", 64, 192), "tissue", "information")


@query(f"""WITH {bind.VOXELS} SELECT round(avg(abs(b.value - a.value)) FILTER (b.z = a.z + 1), 9) AS dz, round(avg(abs(b.value - a.value)) FILTER (b.y = a.y + 1), 9) AS dy, round(avg(abs(b.value - a.value)) FILTER (b.x = a.x + 1), 9) AS dx
FROM voxels a JOIN voxels b ON a.block = b.block AND ((b.z = a.z + 1 AND b.y = a.y AND b.x = a.x) OR (b.z = a.z AND b.y = a.y + 1 AND b.x = a.x) OR (b.z = a.z AND b.y = a.y AND b.x = a.x + 1))""")
def neighbour_steps(spark, sf_dir):
    rows = spatial.steps(bind.voxels(spark, sf_dir), "block", "value")
    mean: dict[str, Column] = {f"d{a}": F.round(F.avg(F.when(F.col("axis") == a, F.abs(F.col("next") - F.col("value")))), 9) for a in boxes.AXES}
    return rows.agg(*(v.alias(c) for c, v in mean.items()))
