"""License scans by ordered signature rules, in DataFrame functions alone.

Texts become words in lower case joined by single blanks. A first test, for any rule's keyword among the text's distinct
words, leaves most texts at once; in the others each rule is tried whose keyword occurs, by a literal pattern that is
compiled once. Detections are sorted by start, longest first, and one fold over them
drops those that lie within an earlier one of the same or a stronger priority. All of it happens within a row: nothing is
shuffled and no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.llm.common import documents, lower_az, set_aside
from meshquarry.llm.license_rules import BASE, Rule, rules

#: Runs of what is no word character: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` are words, after A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = "\x01"
_PLACES = "array<struct<start:int,words:int>>"
_DETECTION = "array<struct<start:int,till:int,priority:int,weight:double,label:string>>"


def _blanks(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _places(padded: Column, pattern: Column) -> Column:
    """(start, words) of all matches of a pattern of whole words, first to last."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    found = F.regexp_extract_all(padded, whole, F.lit(0))
    marked = F.split(F.btrim(F.regexp_replace(padded, whole, F.lit(_MARK + "$0"))), " ", -1)
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i)), lambda i: i.isNotNull())
    return F.when(F.size(found) == 0, F.array().cast(_PLACES)).otherwise(F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (_blanks(m) + 1).alias("words"))))


def _detections(padded: Column, table: list[Rule]) -> Column:
    """Of the rules whose keyword is among `__words`, all matches. The rules are one SQL expression: as many columns built one by
    one take the driver longer than the scan takes the executors."""
    by_keyword: dict[tuple, list[str]] = {}
    for i, r in enumerate(table):
        by_keyword.setdefault(r.keywords, []).append(f"if(rlike(__padded, r' (?:{r.pattern}) '), {i}, null)")
    words = lambda k: ", ".join(f"'{w}'" for w in k)
    found = F.expr(f"concat({', '.join(f'if(arrays_overlap(__words, array({words(k)})), array({", ".join(rs)}), array())' for k, rs in by_keyword.items())}, array(cast(null as int)))")
    rows = ", ".join(f"named_struct('label', '{r.label}', 'priority', {r.priority}, 'weight', {r.weight}D, 'pattern', r'{r.pattern}')" for r in table)
    hit = F.transform(F.array_compact(found), lambda i: F.get(F.expr(f"array({rows})"), i)) if table else F.array()
    one = lambda r: F.transform(_places(padded, r["pattern"]), lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["words"]).alias("till"), r["priority"].alias("priority"), r["weight"].alias("weight"), r["label"].alias("label")))
    return F.flatten(F.transform(hit, one)).cast(_DETECTION)


def _unsuppressed(found: Column, priorities: list[int]) -> Column:
    """Detections that don't lie within another of the same or a stronger priority (of equals, the first by label stays)."""
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["till"]).alias("back"), d["priority"].alias("priority"), d["label"].alias("label"), d["weight"].alias("weight"))))
    name = "p{}".format
    start = F.struct(*(F.lit(-1).alias(name(p)) for p in priorities), F.array().cast(_DETECTION).alias("kept"))

    def step(s: Column, d: Column) -> Column:
        till = -d["back"]
        reach = F.greatest(*(F.when(d["priority"] >= p, s[name(p)]).otherwise(-1) for p in priorities), F.lit(-1))
        one = F.struct(d["start"].alias("start"), till.alias("till"), d["priority"].alias("priority"), d["weight"].alias("weight"), d["label"].alias("label"))
        further = (F.when((d["priority"] == p) & (till > s[name(p)]), till).otherwise(s[name(p)]).alias(name(p)) for p in priorities)
        return F.struct(*further, F.when(reach >= till, s["kept"]).otherwise(F.array_append(s["kept"], one)).alias("kept"))

    return F.aggregate(order, start, step, lambda s: s["kept"])


def scan(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """All columns of `docs` and n_words, base (places of the fixed phrases: start, words, label, by start and label),
    detections (start, till, priority, weight, label; of the rules, after suppression).

    A null or empty text has no words and empty arrays. Columns of these names in the input are replaced. Each row stands
    alone, so repeated rows, ties and tables of any size make no difference; the rules are literals of the plan.
    """
    table = rules() if table is None else table
    padded = F.col("__padded")

    def fixed(phrase: str, label: str) -> Column:
        places = F.when(F.contains(padded, F.lit(f" {phrase} ")), _places(padded, F.lit(phrase))).otherwise(F.array().cast(_PLACES))
        return F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["words"].alias("words"), F.lit(label).alias("label")))

    base = F.concat(*(fixed(*b) for b in BASE))
    gate = sorted({k for r in table for k in r.keywords} | {p.split()[0] for p, _ in BASE})
    docs, named = set_aside(docs.drop("n_words", "base", "detections"), "__padded", "__words", "__found")
    rows = docs.withColumn("__padded", F.concat(F.lit(" "), F.btrim(F.regexp_replace(lower_az(F.coalesce(F.col("text"), F.lit(""))), _BETWEEN, " ")), F.lit(" ")))
    rows = rows.withColumn("__words", F.array_intersect(F.split("__padded", " ", -1), F.array(*map(F.lit, gate))))
    gated = F.size("__words") > 0
    rows = rows.withColumns({
        "n_words": F.when(padded == "  ", 0).otherwise(_blanks(padded) - 1).cast("long"),
        "base": F.when(gated, F.array_sort(base)).otherwise(F.array().cast("array<struct<start:int,words:int,label:string>>")),
        "__found": F.when(gated, _detections(padded, table)).otherwise(F.array().cast(_DETECTION)),
    })
    kept = F.when(F.size("__found") == 0, F.array().cast(_DETECTION)).otherwise(_unsuppressed(F.col("__found"), sorted({r.priority for r in table})))
    return named(rows.withColumn("detections", kept).drop("__padded", "__words", "__found"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.transform("base", lambda b: b["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0))["start"].cast("long").alias("first_word"),
        F.get("base", F.size("base") - 1)["start"].cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.aggregate("detections", F.lit(0.0), lambda s, d: F.greatest(s, d["weight"])).alias("score"),
    )
