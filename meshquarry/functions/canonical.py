"""One text for equal data: keys sorted, no spaces, chosen keys left out at any depth. Its digest is the data's identity."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: Column, kind: T.DataType, without: Iterable[str] = ()) -> Column:
    """The JSON text of a typed value. Fields and keys are in order of their code units; a missing value is `null`, also as a whole. Floating
    numbers without a fraction below 10^15 are written as whole ones, others as Spark casts them, those that are no numbers as
    strings; dates, times and intervals as strings, bytes as strings of hex digits. So a long and a double of equal value agree, as do
    a struct and a map with the same keys. Keys of maps are their values' text; equal ones stay in the map's order."""
    without = frozenset(without)
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), canonical(value.getField(f.name), f.dataType, without)) for f in sorted(kind.fields, key=lambda f: f.name) if f.name not in without]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), canonical(e["value"], kind.valueType, without).alias("text")))
        if without:
            entries = F.filter(entries, lambda e: ~e["key"].isin(*without))
        ordered = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        text = F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["text"])), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: canonical(v, kind.elementType, without)), ","), F.lit("]"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        number = value.cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
        odd = F.isnan(number) | (F.abs(number) == float("inf"))
        text = F.when(odd, _quoted(number.cast("string"))).when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        text = value.cast("string")
    else:
        text = _quoted(F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(text)


def _quoted(text: Column) -> Column:
    """A JSON string, escaped as Spark escapes it."""
    held = F.to_json(F.array(text))
    return F.substring(held, F.lit(2), F.char_length(held) - 2)


def canonical_text(text: Column, without: Sequence[str] = ()) -> Column:
    """The same for a JSON text: keys sorted and some left out at any depth, whole floating numbers as whole ones. Null for what is no
    JSON, has numbers that are none, or nests too deep; of a key that repeats, the last counts."""
    gone = frozenset(without)

    def scrub(v: object) -> object:
        if isinstance(v, dict):
            return {k: scrub(x) for k, x in v.items() if k not in gone}
        if isinstance(v, list):
            return [scrub(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else v

    def refused(name: str) -> None:
        raise ValueError(name)

    def one(s: str | None) -> str | None:
        try:
            return None if s is None else json.dumps(scrub(json.loads(s, parse_constant=refused)), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)


def identified(rows: DataFrame, *columns: str, without: Iterable[str] = (), name: str = "identity") -> DataFrame:
    """Rows with the SHA-256 of the named columns' canonical text, as one object; all columns where none is named. The order of
    columns, fields and keys does not matter."""
    chosen = [f for f in rows.schema.fields if not columns or f.name in columns]
    held = F.struct(*(F.col(f"`{f.name}`") for f in chosen))
    return rows.withColumn(name, F.sha2(canonical(held, T.StructType(chosen), without), 256))


def set_digests(rows: DataFrame, group: Sequence[str], *columns: str, digits: int = 4) -> DataFrame:
    """(group, n, digest): how many different values of the columns a group has, and a digest of them that neither their order nor
    repeats change. It is the SHA-256 of the digests of buckets, in order, and a bucket's is that of its values' SHA-256, in order; a
    bucket is named by the first hex digits. So no task holds a group: with four digits a bucket is 1 / 65,536 of it, and the
    buckets' digests take 4 MB at most. All null values are values too."""
    own = identified(rows.select(*group, *columns), *columns, name="__id").select(*group, "__id").distinct()
    own = own.withColumn("__at", F.substring("__id", 1, digits))
    buckets = own.groupBy(*group, "__at").agg(F.count("*").alias("__n"), F.sha2(F.array_join(F.array_sort(F.collect_list("__id")), ""), 256).alias("__d"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__d"))), lambda b: b["__d"])
    return buckets.groupBy(*group).agg(F.sum("__n").alias("n"), F.sha2(F.array_join(whole, ""), 256).alias("digest"))
