"""Personal data: patterns, and the terms of the corpus that reveal them.

A protected entity is one value that a pattern finds (an address, a card). A term discloses it as far as knowing the term
tells the entity: with shares of documents, PMI = log2(p(term, entity) / (p(term) p(entity))), of at most
IC = -log2 p(entity). The documents that hold the two together are counted by unlike surroundings of the entity, so that
copies and near copies of a passage are one piece of evidence, and less one, since a single one proves nothing. Where
PMI / IC exceeds GENERALISE the term is replaced by its kind, where it exceeds REMOVE it is removed, in every document
that holds it, with the entity or without. An entity of two unlike documents can thus have terms that few other hold.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.llm.common import documents, lower_az, set_aside, stored

KINDS = ("email", "ip", "card", "phone", "term")
COUNTS = ["n_email", "n_ip", "n_card", "n_phone"]
#: Words on either side of an entity that count as together with it, and as its surroundings; thresholds of PMI / IC.
WINDOW, AROUND, GENERALISE, REMOVE = 128, 16, 0.8, 0.9
#: Candidate terms up to this number of bytes are sent to all tasks before words are counted; more are joined after it.
SENT = 16_000_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match that could start within a run of digits could start at the run.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Stripped from both ends of a word to give its term.
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LUHN = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_LUHN[int(d)] for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+` and _DOMAIN, in time that is linear in the text."""
    at, end = text.find("@"), 0
    while at >= 0:
        before = text[end:at]
        if (start := end + len(before.rstrip(_LOCAL))) < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind: leftmost matches of each pattern that meet its further conditions."""
    out = []
    out += [(a, 0, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) < 4 and int(d or 0) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def entity(text: str, span: tuple[int, int, int]) -> str:
    a, kind, b = span
    return f"{KINDS[kind]}:{text[a:b].translate(_AZ) if kind < 2 else _digits(text[a:b])}"


def _terms(text: str) -> list[tuple[int, int, str]]:
    """(start, end, term) of the words, where the ends are without what is stripped."""
    out = []
    for m in _WORD.finditer(text):
        left = m[0].lstrip(EDGE)
        if term := left.rstrip(EDGE):
            a = m.end() - len(left)
            out.append((a, a + len(term), term.translate(_AZ)))
    return out


def _outside(words: list[tuple[int, int, str]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """The words that touch no span. ends[i]: the furthest end of the spans up to the i-th."""
    starts, ends = [s[0] for s in spans], []
    for s in spans:
        ends.append(max(s[2], ends[-1] if ends else 0))
    return [w for w in words if (i := bisect_right(starts, w[1] - 1)) == 0 or ends[i - 1] <= w[0]]


def entities(text: str, spans: list[tuple[int, int, int]]) -> dict[str, int]:
    """Each entity with a sketch of its surroundings: the least hash of the pairs of adjacent words around all its places,
    which near copies mostly share and other documents do not."""
    words = _outside(_terms(text), spans)
    starts, out = [w[0] for w in words], {}
    for s in spans:
        i = bisect_right(starts, s[0])
        near = [w[2] for w in words[max(0, i - AROUND) : i + AROUND]]
        sketch = min((xxhash.xxh64_intdigest(f"{a} {b}") >> 1 for a, b in pairwise(("", *near))), default=0)
        name = entity(text, s)
        out[name] = min(sketch, out.get(name, sketch))
    return out


def near_terms(text: str, spans: list[tuple[int, int, int]], wanted: set[str]) -> list[tuple[str, str]]:
    """(entity, term), each once, for the words near the base spans of `wanted` entities."""
    words = _outside(_terms(text), spans)
    starts, out = [w[0] for w in words], {}
    for s in spans:
        if (name := entity(text, s)) in wanted:
            i = bisect_right(starts, s[0])
            out.update(((name, w[2]), None) for w in words[max(0, i - WINDOW) : i + WINDOW])
    return list(out)


def base(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_email, n_ip, n_card, n_phone, base_spans, entities, held): what the patterns find in every row, and
    the text where they find anything (else null). row: xxhash64 of doc_id and text. Nulls count as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    several = pa.list_(pa.struct([("entity", pa.string()), ("sketch", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = [t or "" for t in b.column(2).to_pylist()]
                spans = [base_spans(t) for t in texts]
                counts = [pa.array([sum(x[1] == k for x in s) for s in spans], pa.int64()) for k in range(4)]
                found = [[{"entity": e, "sketch": h} for e, h in entities(t, s).items()] if s else [] for t, s in zip(texts, spans, strict=True)]
                held = pa.array([t if s else None for t, s in zip(texts, spans, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *counts, pa.array(map(spelled, spans), pa.string()), pa.array(found, several), held], names=["doc_id", "row", *COUNTS, "base_spans", "entities", "held"])

    schema = f"doc_id {kind}, row long, {', '.join(c + ' long' for c in COUNTS)}, base_spans string, entities array<struct<entity:string,sketch:long>>, held string"
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(run, schema)


def words(docs: DataFrame) -> DataFrame:
    """(row, term): the distinct terms of each row. Texts are split between words, at blanks with what is stripped around
    them, which gives the terms of _terms()."""
    edge = "[" + re.sub(r"([\\\]\[^&-])", r"\\\1", EDGE) + "]*"
    terms = F.split(F.btrim(lower_az(F.col("text")), F.lit(EDGE)), edge + r"[\x20\x09-\x0D]+" + edge)
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), F.explode(F.array_distinct(terms)).alias("term")).where("term <> ''")


def term_counts(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(term, n_term): how many rows hold each term (each of `wanted`), combined before the shuffle."""
    held = words(docs).select("term")
    if wanted is not None and (wanted.agg(F.sum(F.octet_length("term") + 40)).first()[0] or 0) <= SENT:
        held, wanted = held.join(F.broadcast(wanted), "term", "left_semi"), None
    counts = held.groupBy("term").agg(F.count("*").alias("n_term"))
    return counts if wanted is None else counts.join(wanted, "term", "left_semi")


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, share): the terms whose share PMI / IC of an entity exceeds GENERALISE, over all of `docs`.

    All counts are of rows, or of the unlike surroundings among them, combined before each shuffle. Pairs are formed only
    for entities with two unlike surroundings, since no other has evidence, and only within their windows.
    """
    n = F.lit(float(docs.count()))
    held = found.select("row", F.explode("entities").alias("e")).select("row", "e.*")
    known = held.groupBy("entity").agg(F.count("*").alias("n_entity"), F.min("sketch").alias("low"), F.max("sketch").alias("high"))
    known = stored(known.where("low <> high").select("entity", "n_entity"), "entities")
    wanted = held.select("row", "entity").distinct().join(known.select("entity"), "entity").groupBy("row").agg(F.collect_list("entity").alias("wanted"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                b = whole.slice(at, 1)
                held, wanted, e = (b.column(i)[0].as_py() for i in range(3))
                sketch = {x["entity"]: x["sketch"] for x in e}
                pairs = near_terms(held, base_spans(held), set(wanted))
                for i in range(0, len(pairs), 50_000):
                    part = pairs[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.string()), pa.array([sketch[x[0]] for x in part], pa.int64())], names=["entity", "term", "sketch"])

    pairs = found.join(wanted, "row").select("held", "wanted", "entities").mapInArrow(near, "entity string, term string, sketch long")
    pairs = pairs.groupBy("entity", "term", "sketch").agg(F.count("*").alias("rows")).groupBy("entity", "term").agg(F.count("*").alias("both"), F.sum("rows").alias("rows"))
    # A term is in `rows` documents at least: pairs that can't exceed GENERALISE go before the corpus is counted.
    ic = F.log2(n / F.col("n_entity"))
    share = lambda n_term: F.log2((F.col("both") - 1) * n / (F.col(n_term) * F.col("n_entity"))) / ic
    pairs = stored(pairs.where("both > 1").join(known, "entity").where((ic > 0) & (share("rows") > GENERALISE)), "pairs")
    counts = term_counts(docs, stored(pairs.select("term").distinct(), "terms"))
    return pairs.join(counts, "term").select("entity", "term", share("n_term").alias("share")).where(F.col("share") > GENERALISE)


def term_spans(text: str, spans: list[tuple[int, int, int]], terms: set[str]) -> list[tuple[int, int, int]]:
    return [(a, 4, b) for a, b, w in _outside(_terms(text), spans) if w in terms]


def _parsed(spans: str) -> list[tuple[int, int, int]]:
    return [(int(a), KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in spans.split(","))] if spans else []


_RESULT = ["doc_id", "row", *COUNTS, "base_spans", "spans", "removed"]


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_email, n_ip, n_card, n_phone, base_spans, spans, removed) of every row; spans as `kind:start:end`,
    comma-joined by start, then kind, in code points, end exclusive. spans holds the base spans and those of disclosing
    terms; removed lists the terms that are to go, the others are to be generalised. row: xxhash64 of doc_id and text.

    Null and empty texts have none. Rows that repeat count as so many documents, and get the same spans. Other columns are
    ignored; an empty table gives an empty one.

    The texts in which patterns find something are kept in the shared folder. Disclosing terms are then looked up among
    the words of all rows; only rows that hold one are marked anew. Spark sends the terms, or the rows' own terms, to all
    tasks only while they are small, and else joins by shuffles that adaptive execution splits.
    """
    docs = docs.select("doc_id", "text")
    found = stored(base(docs), "found")
    shares = disclosing(docs, found.where(F.col("held").isNotNull()))
    shares = stored(shares.groupBy("term").agg(F.max("share").alias("share")), "shares")
    own = words(docs).join(shares, "term").groupBy("row", "term").agg(F.max("share").alias("share"))
    own = stored(own.groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("terms")), "marks")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                base, spans, removed = [], [], []
                for t, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    share = {y["term"]: y["share"] for y in x}
                    base.append(base_spans(t))
                    spans.append(spelled(sorted(base[-1] + term_spans(t, base[-1], set(share)))))
                    removed.append(sorted(w for w, v in share.items() if v > REMOVE))
                counts = [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *counts, pa.array(map(spelled, base), pa.string()), pa.array(spans, pa.string()), pa.array(removed, pa.list_(pa.string()))], names=_RESULT)

    schema = f"doc_id {kind}, row long, {', '.join(c + ' long' for c in COUNTS)}, base_spans string, spans string, removed array<string>"
    marked = docs.withColumn("row", F.xxhash64("doc_id", "text")).join(own, "row").select("doc_id", "row", "text", "terms").mapInArrow(run, schema)
    plain = found.join(own.select("row"), "row", "left_anti").withColumns({"spans": F.col("base_spans"), "removed": F.array().cast("array<string>")})
    return plain.select(*_RESULT).unionByName(marked)


def redact(text: str | None, spans: str | None, removed: list[str] | None) -> str | None:
    """The text with each span replaced: patterns by [KIND], removed terms by nothing, others by what they look like."""
    if not spans:
        return text
    gone, out, at = set(removed), [], 0
    for a, kind, b in _parsed(spans):
        if b <= at:
            continue
        term = text[a:b]
        if kind < 4:
            new = f"[{KINDS[kind].upper()}]"
        else:
            new = "" if term.translate(_AZ) in gone else "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[TERM]"
        out += [text[at : max(a, at)], new]
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """All columns of `docs` with `text` redacted. Texts without a finding, nulls among them, stay as they are."""
    docs, named = set_aside(docs, "__key", "__row", "__spans", "__removed")
    data = personal_data(docs).where("spans <> ''").select(F.col("row").alias("__row"), "spans", "removed").dropDuplicates(["__row"])
    redacted = F.udf(redact, "string", useArrow=True)
    rows = docs.withColumn("__key", F.xxhash64("doc_id", "text")).join(data.withColumnsRenamed({"spans": "__spans", "removed": "__removed"}), F.col("__key") == F.col("__row"), "left")
    return named(rows.withColumn("text", redacted("text", "__spans", "__removed")).drop("__key", "__row", "__spans", "__removed"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
