"""Queries of streams with state: the work queue over the events, and the log of reviews that takes each item once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshquarry.plans.bind import table
from meshquarry.plans.catalog import query
from meshquarry.storage import scratch
from meshquarry.streaming import reviews, work

PATIENCE_S = 43_200
_SCHEMA = "event_id long, user_id long, event_type string, props string, value double, ts timestamp_ntz"
_EVENTS = f"""p AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts, event_id) AS r FROM (
  SELECT CAST(json_extract(props, '$.k') AS BIGINT) * 10 + user_id % 10 AS item, event_id, ts, 'w' || event_id % 2 AS who,
    CASE event_type WHEN 'click' THEN 'beat' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' ELSE 'claim' END AS kind FROM events) WHERE item IS NOT NULL),
w(item, r, state, worker, till, claims, fails) AS (
  SELECT DISTINCT item, 0::BIGINT, 'pending', NULL::VARCHAR, NULL::TIMESTAMP, 0::BIGINT, 0::BIGINT FROM p UNION ALL
  SELECT item, r, CASE WHEN claimed THEN 'running' WHEN mine AND kind = 'complete' THEN 'done' WHEN failed THEN CASE WHEN fails >= 2 THEN 'failed' ELSE 'retry' END ELSE now END,
    CASE WHEN claimed THEN who WHEN failed AND fails < 2 THEN NULL WHEN now <> 'pending' THEN worker END,
    CASE WHEN claimed OR (mine AND kind = 'beat') THEN ts + INTERVAL {PATIENCE_S} SECOND ELSE till END, claims + CAST(claimed AS BIGINT), fails + CAST(failed AS BIGINT)
  FROM (SELECT *, kind = 'claim' AND now IN ('pending', 'retry') AS claimed, coalesce(now = 'running' AND who = worker, false) AS mine, kind = 'fail' AND mine AS failed
    FROM (SELECT w.* EXCLUDE (r), p.* EXCLUDE (item), CASE WHEN state = 'running' AND p.ts > till THEN 'pending' ELSE state END AS now FROM w JOIN p ON p.item = w.item AND p.r = w.r + 1))),
last AS (SELECT item, arg_max(w, r) AS s FROM w GROUP BY item), gone AS (SELECT item, s, s.state = 'running' AND s.till < (SELECT max(ts) FROM events) AS out FROM last WHERE s.claims > 0),
states AS (SELECT item, CASE WHEN out THEN 'pending' ELSE s.state END AS state, CASE WHEN NOT coalesce(out, false) THEN s.worker END AS worker, s.claims AS claims, s.fails AS fails FROM gone)"""


def _stream(spark, sf_dir) -> DataFrame:
    """The events as a stream; the pattern may be a file or a folder."""
    return spark.readStream.schema(_SCHEMA).parquet(f"{sf_dir}/events[.]parquet").withColumn("item", F.from_json("props", "k bigint")["k"] * 10 + F.col("user_id") % 10)


def _states(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "beat").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise("claim")
    events = _stream(spark, sf_dir).select("item", "event_id", "ts", kind.alias("kind"), F.concat(F.lit("w"), F.col("event_id") % 2).alias("worker"), F.col("event_type").alias("cause"))
    folder = scratch(spark, "work")
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")
    work.run(work.changes(events, PATIENCE_S), sink, f"{folder}/state")
    end = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp")).first()[0]
    return work.standing(spark.read.parquet(f"{folder}/changes"), end)


@query(f"WITH RECURSIVE {_EVENTS} SELECT * FROM states")
def work_states(spark, sf_dir):
    return _states(spark, sf_dir)


@query(f"WITH RECURSIVE {_EVENTS} SELECT DISTINCT item, coalesce(state, 'pending') AS state FROM p LEFT JOIN states USING (item) WHERE coalesce(state, 'pending') IN ('pending', 'retry')")
def work_waiting(spark, sf_dir):
    """Every item that a worker may claim next, those that nobody has claimed yet among them."""
    item = F.from_json("props", "k bigint")["k"] * 10 + F.col("user_id") % 10
    items = table(spark, sf_dir, "events").select(item.alias("item")).where("item IS NOT NULL").distinct()
    return work.waiting(items, _states(spark, sf_dir))


@query("""WITH e AS (SELECT event_id, ts, event_type, CAST(json_extract(props, '$.k') AS BIGINT) * 10 + user_id % 10 AS item,
  CASE user_id % 7 WHEN 0 THEN ' Unknown ' WHEN 1 THEN 'TEST' WHEN 2 THEN '' ELSE 'r' || user_id END AS reviewer FROM events)
SELECT item, arg_min(reviewer, (ts, event_id)) AS reviewer, arg_min(event_type, (ts, event_id)) AS decision, arg_min(event_id, (ts, event_id)) AS event_id
FROM e WHERE event_type IN ('view', 'click', 'purchase') AND lower(trim(reviewer)) NOT IN ('', 'unknown', 'test') AND item IS NOT NULL GROUP BY item""")
def review_log(spark, sf_dir):
    """One decision an item, by a reviewer with a name; any decision in the log blocks a later one."""
    u = F.col("user_id") % 7
    reviewer = F.when(u == 0, " Unknown ").when(u == 1, "TEST").when(u == 2, "").otherwise(F.concat(F.lit("r"), F.col("user_id")))
    events = reviews.valid(_stream(spark, sf_dir).withColumns({"reviewer": reviewer, "decision": F.col("event_type")}), ("view", "click", "purchase"))
    folder = scratch(spark, "log")
    work.run(events.select("item", "event_id", "ts", "reviewer", "decision"), work.append_once(f"{folder}/log", ["item"], ["ts", "event_id"]), f"{folder}/state")
    return spark.read.parquet(f"{folder}/log").select("item", "reviewer", "decision", "event_id")
