"""Record collections in JSON, and event logs, read with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collection(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The rows of one collection in JSON documents `{name: [...], ...}`: a file, a folder or a glob. A document without the
    collection has no rows; a value of the wrong type fails the read. An absent path gives an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = T.StructType([T.StructField(name, T.ArrayType(T._parse_datatype_string(schema)))])
    rows = spark.read.schema(whole).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)
    return rows.select(F.explode(name).alias("r")).select("r.*")


def event_log(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """Events, one JSON object a line; blank lines are none, damaged ones fail the read. The same schema for batch and stream."""
    reader = (spark.readStream if streaming else spark.read).schema(schema).option("mode", "FAILFAST")
    return reader.json(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0
