"""Sinks that write once: content-addressed payloads, guarded tables and receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshquarry.functions.canonical import canonical
from meshquarry.sources.json_records import exists


def put_once(rows: DataFrame, path: str, payload: str = "payload") -> None:
    """Appends the payloads whose SHA-256 the store (sha256, size, payload) lacks; equal ones are stored once. For one writer
    at a time."""
    content = F.col(payload).cast("binary")
    new = rows.select(F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size"), content.alias("payload")).dropDuplicates(["sha256"])
    if exists(rows.sparkSession, path):
        new = new.join(rows.sparkSession.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").parquet(path)


def put_records(rows: DataFrame, path: str) -> DataFrame:
    """Stores each row's canonical JSON, and gives the rows with its sha256 as their reference."""
    held = rows.withColumn("__payload", canonical(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), rows.schema))
    put_once(held.select(F.col("__payload").alias("payload")), path)
    return held.withColumn("sha256", F.sha2("__payload", 256)).drop("__payload")


def get(refs: DataFrame, path: str) -> DataFrame:
    """The payloads that references (sha256, ...) name, with a state: `intact`, `damaged` where the content no longer has that
    digest, or `absent`."""
    held = refs.sparkSession.read.parquet(path).select("sha256", "payload").dropDuplicates(["sha256"])
    state = F.when(F.col("payload").isNull(), "absent").when(F.sha2("payload", 256) == F.col("sha256"), "intact").otherwise("damaged")
    return refs.join(held, "sha256", "left").withColumn("state", state)


def write_new(df: DataFrame, path: str) -> None:
    """Refuses to write over anything."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def digest(df: DataFrame) -> str:
    """A digest of the rows whatever their order: count and sum of 64-bit hashes, columns by name."""
    by_name = [F.col(f"`{c}`") for c in sorted(df.columns)]
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*by_name).cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}:{r.h or 0}"


def write_same(df: DataFrame, path: str) -> bool:
    """Writes where nothing is (True); does nothing where the same rows are (False); else raises."""
    if not exists(df.sparkSession, path):
        write_new(df, path)
        return True
    if digest(df.sparkSession.read.parquet(path)) != digest(df):
        raise ValueError(f"other rows are at {path}")
    return False


def latest_receipts(receipts: DataFrame) -> DataFrame:
    """Of receipts (tool, at, status, payload) each tool's last, ties by payload."""
    row = F.struct("at", "status", "payload")
    return receipts.groupBy("tool").agg(F.max_by(row, F.struct("at", "payload")).alias("r")).select("tool", "r.*")
