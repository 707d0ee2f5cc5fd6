"""A work queue over streams: items are claimed, kept by beats, completed, failed and given back; and a log that takes each key once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meshquarry.sources.json_records import exists

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States in which an item waits for a worker, and those that nothing ends.
WAITING, ENDED = ("pending", "retry"), ("done", "failed")
_CHANGES = "item long, seq long, at timestamp, state string, worker string, till timestamp, claims long, fails long, cause string"


class Work(StatefulProcessor):
    """The state of one item: its lease in one variable, its failures by cause in another, and a timer for the lease's end."""

    def __init__(self, patience_s: int, most_fails: int):
        self.patience, self.most = patience_s * 1_000_000, most_fails

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "seq long, state string, worker string, till long, claims long")
        self.causes = handle.getMapState("causes", "cause string", "n long")

    def _row(self, key: tuple, at: int, now: tuple, fails: int, cause: str | None) -> tuple:
        seq, state, worker, till, claims = now
        return key[0], seq, _time(at), state, worker, _time(till), claims, fails, cause

    def _fails(self) -> int:
        return sum(self.causes.getValue(k)[0] for k in self.causes.keys())

    def _timer(self, till: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if till is not None:
            self.handle.registerTimer(till // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, state, worker, till, claims = self.lease.get() if self.lease.exists() else (0, "pending", None, None, 0)
        fails, out = self._fails(), []
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for ts, kind, who, cause in events[["ts", "kind", "worker", "cause"]].itertuples(index=False):
            at = ts.value // 1000
            if state == "running" and at > till:
                seq, state, worker, at_end, till = seq + 1, "pending", None, till, None
                out.append(self._row(key, at_end, (seq, state, worker, till, claims), fails, "expired"))
            mine = state == "running" and who == worker
            if kind == "claim" and state in WAITING and who:
                state, worker, till, claims, why = "running", who, at + self.patience, claims + 1, None
            elif kind == "beat" and mine:
                till, why = max(till, at + self.patience), None
            elif kind == "complete" and mine:
                state, till, why = "done", None, None
            elif kind in ("fail", "fail_for_good") and mine:
                why = cause if isinstance(cause, str) else "unknown"
                self.causes.updateValue((why,), ((self.causes.getValue((why,))[0] if self.causes.containsKey((why,)) else 0) + 1,))
                fails += 1
                state, till = "failed" if kind == "fail_for_good" or fails >= self.most else "retry", None
                worker = None if state == "retry" else worker
            else:
                continue
            seq += 1
            out.append(self._row(key, at, (seq, state, worker, till, claims), fails, why))
        if out:
            self.lease.update((seq, state, worker, till, claims))
            self._timer(till if state == "running" else None)
            yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.lease.exists():
            return
        seq, state, _, till, claims = self.lease.get()
        if state == "running" and till < timerValues.getCurrentWatermarkInMs() * 1000:
            self.lease.update((seq + 1, "pending", None, None, claims))
            yield _frame([self._row(key, till, (seq + 1, "pending", None, None, claims), self._fails(), "expired")])


def _time(us: int | None) -> pd.Timestamp | None:
    return None if us is None else pd.Timestamp(us * 1000, tz="UTC")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _CHANGES.split(", ")])
    return out.assign(at=pd.to_datetime(out["at"], utc=True), till=pd.to_datetime(out["till"], utc=True))


def changes(events: DataFrame, patience_s: int = 7200, most_fails: int = 3, delay: str = "10 minutes") -> DataFrame:
    """A row each time that a stream of events (item, event_id, ts, kind, worker, cause) changes an item's state; other events,
    and those without an item or a time, change nothing.

    `claim` takes a waiting item for `patience_s` seconds of event time, `beat` of its worker prolongs that, `complete` ends it,
    `fail` gives it back until it has failed `most_fails` times, `fail_for_good` ends it at once. A lease that runs out gives the item
    back, by the next event or by a timer; only the worker that holds an item can change it. Events of a batch count by time, then
    event_id; those older than the watermark are left out. Needs the RocksDB state store (`ROCKS`), and an item's events of one
    batch are one task's.
    """
    rows = events.where("item IS NOT NULL AND ts IS NOT NULL").select(F.col("item").cast("long").alias("item"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "kind", "worker", "cause")
    return rows.withWatermark("ts", delay).groupBy("item").transformWithStateInPandas(Work(patience_s, most_fails), _CHANGES, "append", "eventtime")


def standing(changed: DataFrame, at: object) -> DataFrame:
    """Of all changes so far, each item's state at a time, given as a column or literal: a lease that has run out by then counts as given back, whether or
    not a timer has told so yet."""
    row = F.struct(*(c.split()[0] for c in _CHANGES.split(", ")[1:]))
    last = changed.groupBy("item").agg(F.max_by(row, "seq").alias("r")).select("item", "r.*")
    gone = (F.col("state") == "running") & (F.col("till") < F.lit(at))
    return last.select("item", F.when(gone, "pending").otherwise(F.col("state")).alias("state"), F.when(~gone, F.col("worker")).alias("worker"), "claims", "fails")


def waiting(items: DataFrame, states: DataFrame) -> DataFrame:
    """The items (item, ...) that wait for a worker: never claimed, given back, or failed and to be tried again."""
    now = states.select("item", F.col("state"))
    return items.join(now, "item", "left").withColumn("state", F.coalesce("state", F.lit("pending"))).where(F.col("state").isin(*WAITING))


def append_once(path: str, key: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` sink: a log in Parquet that takes the first row of each key, by the given order, and none for a key that an
    earlier batch has logged. A batch that runs again after a failure writes its own folder anew and adds nothing twice."""

    def write(batch: DataFrame, n: int) -> None:
        first = F.struct(*order)
        rest = [c for c in batch.columns if c not in key]
        new = batch.dropna(subset=list(key)).groupBy(*key).agg(F.min_by(F.struct(*rest), first).alias("__row")).select(*key, "__row.*")
        if exists(batch.sparkSession, f"{path}/batch=*"):
            logged = batch.sparkSession.read.parquet(path).where(F.col("batch") < n).select(*key)
            new = new.join(logged, list(key), "left_anti")
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """Runs a stream over what there is now, from where its checkpoint stands, with the RocksDB state store."""
    spark: SparkSession = stream.sparkSession
    conf, name = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    finally:
        conf.set(name, before) if before else conf.unset(name)
