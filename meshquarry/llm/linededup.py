"""Line dedup by range-partitioned hashes, in DataFrame functions alone.

Lines are hashed, the hashes dealt out by range and sorted within each range by document and position; one pass in that
order sees each line's first document and gives, for later ones, the positions to drop. What returns to a document is its
keep bitmap in compressed form (lengths of runs), never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.llm.common import SPACES, cut, documents, lower_az, set_aside

LEAST_CHARS = 10
#: Lines of one in so many documents are counted to find hot ones; a hot line has a share of HOT_SHARE or more of those, so
#: there are at most 1 / HOT_SHARE, about 1 MB. This decides only which of two exact routes a line takes.
SAMPLE, HOT_SHARE = 64, 1 / 20_000
HOT_LEAST = 20


def line_key(line: Column) -> Column:
    return lower_az(F.btrim(line, F.lit(SPACES)))


def _rows(docs: DataFrame) -> DataFrame:
    """Documents with `row`, a hash of the text: with doc_id, what a bitmap belongs to."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"__text": text, "__row": F.xxhash64(text)})


def _lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of the lines whose key is long enough; h1 and h2 are 128 bits of hash."""
    key = line_key(F.col("line"))
    return (
        rows.where("doc_id IS NOT NULL")
        .select("doc_id", F.col("__row").alias("row"), F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "row", "pos", key.alias("key"))
        .where(F.char_length("key") >= least_chars)
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, row, runs): for documents that lose lines, their bitmap as lengths of runs, kept and dropped by turns,
    kept first (0 if the first line goes); lines after the last run stay. row: xxhash64 of the text.

    Texts are read once here; the hashes, without text, are kept in the shared folder. Hot lines, found in a sample, take a route without a shuffle: their first documents are combined before the shuffle
    and joined back as a table of bounded size. All others share one shuffle by range; neither route drops a row.
    """
    lines = cut(_lines(_rows(docs), least_chars))
    sample = lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).groupBy("h1", "h2").count()
    total = sample.agg(F.sum("count")).first()[0] or 0
    hot = sample.where(F.col("count") >= max(HOT_LEAST, HOT_SHARE * total)).select("h1", "h2")
    hot = F.broadcast(hot)  # at most 1 / HOT_SHARE rows
    first = lines.join(hot, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    late = lines.join(F.broadcast(first), ["h1", "h2"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "row", "pos")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = W.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    streamed = (
        lines.join(hot, ["h1", "h2"], "left_anti")
        .repartitionByRange(n, "h1", "h2")
        .withColumn("first", F.first("doc_id").over(order))
        .where(F.col("doc_id") > F.col("first"))
        .select("doc_id", "row", "pos")
    )
    pos, at = F.col("pos"), lambda x, i: F.get(x, i)
    starts = F.filter(pos, lambda p, i: (i == 0) | (F.coalesce(at(pos, i - 1), F.lit(-2)) != p - 1))
    ends = F.filter(pos, lambda p, i: F.coalesce(at(pos, i + 1), F.lit(-2)) != p + 1)
    runs = F.flatten(F.transform(F.col("starts"), lambda s, i: F.array(s - F.when(i == 0, 0).otherwise(at(F.col("ends"), i - 1) + 1), at(F.col("ends"), i) - s + 1)))
    return (
        late.unionByName(streamed)
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set("pos")).alias("pos"))
        .select("doc_id", "row", starts.alias("starts"), ends.alias("ends"))
        .select("doc_id", "row", runs.alias("runs"))
    )


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines that a bitmap keeps."""
    flags = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    return F.when(runs.isNull(), lines).otherwise(F.filter(lines, lambda _, i: F.coalesce(F.get(flags, i), F.lit(True))))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """All columns of `docs`, with n_lines, n_dropped, kept_text (the lines that stay, joined by line feeds) and keep_runs.

    A line's key has ends stripped of white space and A-Z lower-cased. A key of `least_chars` code points or more that
    two or more documents hold loses its lines in all but the smallest doc_id; there, repeats stay. A null or empty text
    is one empty line. Rows with a null doc_id keep all lines and count for no other. Rows that share a doc_id are one
    document. Columns n_lines, n_dropped, kept_text and keep_runs of the input are replaced; an empty table gives an
    empty one.
    """
    docs, named = set_aside(docs, "__text", "__row", "__id", "__hash")
    rows, out = _rows(docs), ["n_lines", "n_dropped", "kept_text", "keep_runs"]
    bits = keep_bitmaps(docs.select("doc_id", "text"), least_chars).select(F.col("doc_id").alias("__id"), F.col("row").alias("__hash"), F.col("runs").alias("keep_runs"))
    rows = rows.drop(*out).join(bits, (F.col("doc_id") == F.col("__id")) & (F.col("__row") == F.col("__hash")), "left")
    lines = F.split("__text", "\n", -1)
    dropped = F.aggregate(F.col("keep_runs"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("i")), lambda s, n: F.struct((s["n"] + F.when(s["i"] % 2 == 1, n).otherwise(0)).alias("n"), (s["i"] + 1).alias("i")), lambda s: s["n"])
    return named(rows.withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(dropped, F.lit(0)).cast("long"),
        "kept_text": F.when(F.col("keep_runs").isNull(), F.col("__text")).otherwise(F.array_join(kept_lines(lines, F.col("keep_runs")), "\n")),
    }).drop("__text", "__row", "__id", "__hash"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
