"""The work queue against a plain walk over each item's events, with a stop and a restart; and the log that takes a key once."""

import datetime as dt
import random

from meshquarry.streaming import reviews, work

START = dt.datetime(2024, 5, 1, 8)
SCHEMA = "item long, event_id long, ts timestamp, kind string, worker string, cause string"


def walked(rows, patience, most, end):
    out = {}
    for item in {r[0] for r in rows if r[0] is not None}:
        state, worker, till, claims, fails = "pending", None, None, 0, 0
        for _, _, ts, kind, who, _ in sorted((r for r in rows if r[0] == item), key=lambda r: (r[2], r[1])):
            if state == "running" and ts > till:
                state, worker = "pending", None
            if kind == "claim" and state in ("pending", "retry") and who:
                state, worker, till, claims = "running", who, ts + patience, claims + 1
            elif state == "running" and who == worker:
                if kind == "beat":
                    till = ts + patience
                elif kind == "complete":
                    state = "done"
                elif kind.startswith("fail"):
                    fails += 1
                    state = "failed" if kind == "fail_for_good" or fails >= most else "retry"
                    worker = worker if state == "failed" else None
        if state == "running" and till < end:
            state, worker = "pending", None
        if claims:
            out[item] = (state, worker, claims, fails)
    return out


def test_like_a_walk_after_a_restart(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice([None, *range(12)]), i, START + dt.timedelta(seconds=i * 20 + r.randrange(10)), r.choice(["claim"] * 3 + ["beat", "complete", "fail", "fail", "fail_for_good", "other"]), r.choice(["a", "b", None]), r.choice(["x", "y", None])) for i in range(600)]
    patience, most, end = dt.timedelta(seconds=600), 2, START + dt.timedelta(seconds=20 * 600)
    sink = lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    for i in range(3):  # each run starts where the one before stopped
        spark.createDataFrame(rows[i * 200 : (i + 1) * 200], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        work.run(work.changes(stream, 600, most), sink, f"{tmp_path}/state")
    told = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    seen = [(x.item, x.seq) for x in told.collect()]
    assert len(seen) == len(set(seen)) and told.where("cause = 'expired'").count() > 0
    states = work.standing(told, end)
    assert {x.item: (x.state, x.worker, x.claims, x.fails) for x in states.collect()} == walked(rows, patience, most, end)
    items = spark.createDataFrame([(i,) for i in range(20)], "item long")
    want = {i for i in range(20) if walked(rows, patience, most, end).get(i, ("pending",))[0] in ("pending", "retry")}
    assert {x.item for x in work.waiting(items, states).collect()} == want


def test_log_takes_a_key_once(spark, tmp_path):
    path, cols = str(tmp_path / "log"), "item long, event_id long, ts timestamp"
    log = work.append_once(path, ["item"], ["ts", "event_id"])
    at = lambda *r: spark.createDataFrame([(i, e, START + dt.timedelta(minutes=m)) for i, e, m in r], cols)
    log(at((1, 5, 9), (1, 4, 9), (2, 1, 0), (None, 9, 0)), 0)
    log(at((1, 7, 1), (3, 8, 1)), 1)
    log(at((1, 7, 1), (3, 8, 1)), 1)  # the same batch again
    log(at((2, 3, 0)), 2)
    assert sorted((r.item, r.event_id) for r in spark.read.parquet(path).collect()) == [(1, 4), (2, 1), (3, 8)]


def test_leases_are_held_and_expire(spark, tmp_path):
    cols = "item long, worker string, ts timestamp"
    beats = [[(1, "a", 0), (2, "b", 0), (1, "b", 10)], [(1, "a", 50), (3, "c", 400)], [(4, "d", 2000)]]
    for i, rows in enumerate(beats):
        spark.createDataFrame([(k, w, START + dt.timedelta(seconds=s)) for k, w, s in rows], cols).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
    run = reviews.leases(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True)
    run.foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/out")).start().awaitTermination()
    got = {(r["item"], r["worker"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {(1, "a", "held"), (2, "b", "held"), (3, "c", "held"), (1, "a", "expired"), (2, "b", "expired")} <= got and not any(k == 1 and w == "b" for k, w, _ in got)
