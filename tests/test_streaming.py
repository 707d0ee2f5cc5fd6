import datetime as dt

import pytest

from meshquarry.streaming import reviews

START = dt.datetime(2024, 5, 1, 8)
SCHEMA = "event_id long, ts timestamp, reviewer string, decision string, item long, value double"


def event(i, minute, decision, item, reviewer="r1"):
    return i, START + dt.timedelta(minutes=minute), reviewer, decision, item, float(i)


@pytest.fixture
def files(spark, tmp_path):
    """Three batches; the second repeats an event, the third comes late by two hours in one row."""
    parts = [[event(1, 0, "same", 7), event(2, 5, "different", 8)], [event(3, 70, "same", 7), event(2, 5, "different", 8), event(4, 80, "same", 8)], [event(5, 400, "same", 9, " Unknown "), event(6, 410, "other", 9), event(7, 420, "different", None), event(8, 430, "same", 9)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    return f"{tmp_path}/in"


def collected(spark, stream, tmp_path, mode):
    out = f"{tmp_path}/out"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True)
    query.foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).start().awaitTermination()
    return [r.asDict() for r in spark.read.parquet(out).collect()]


def reader(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_valid_and_once(spark, files, tmp_path):
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(files)
    keep = lambda df: reviews.once(reviews.valid(df, ("same", "different")))
    told = sorted(r.event_id for r in keep(rows).collect())
    assert told == [1, 2, 3, 4, 8]
    assert sorted(r["event_id"] for r in collected(spark, keep(reader(spark, files)), tmp_path, "append")) == told


def test_windows_close_once_and_as_in_batch(spark, files, tmp_path):
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(files)
    told = {(r.begins, r.decision): (r.n, r.value) for r in reviews.per_window(rows).collect()}
    found = collected(spark, reviews.per_window(reader(spark, files)), tmp_path, "append")
    assert found and len({(r["begins"], r["decision"]) for r in found}) == len(found)
    assert all(told[r["begins"], r["decision"]] == (r["n"], r["value"]) for r in found)


def test_running_verdicts(spark, files, tmp_path):
    rows = collected(spark, reviews.running_verdicts(reader(spark, files).where("item IS NOT NULL")), tmp_path, "update")
    last = {r["item"]: r for r in sorted(rows, key=lambda r: r["n"])}
    assert [(r["n"], r["first"], r["verdict"]) for _, r in sorted(last.items())] == [(2, "same", "same"), (3, "different", "mixed"), (3, "same", "mixed")]


def test_no_decision_decides_nothing(spark, tmp_path):
    rows = [event(1, 0, None, 7), event(2, 5, "same", 7), event(3, 6, None, 8), event(4, 7, "same", 7)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part=0")
    got = {r["item"]: (r["n"], r["first"], r["verdict"]) for r in collected(spark, reviews.running_verdicts(reader(spark, f"{tmp_path}/in")), tmp_path, "update")}
    assert got == {7: (3, "same", "same"), 8: (1, None, None)}
