"""Ordered rule tables and scores, as columns: the first rule that holds decides. All stay within code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states, weights and thresholds below are those of the data model.
CLEAN, UNCLEAR = ("clean", "ok", "resolved"), ("uncertain", "partial", "crossing", "ambiguous")
CLASS_BOOST = {"ARTIFACT": 0.25, "UNCERTAIN": 0.22, "REPROCESS": 0.18, "HIGH_COMPLEXITY": 0.15, "NORMAL": 0.05, "LOW_INFORMATION": 0.02, "EMPTY": 0.0}
FAILURES = (
    ("OOM", ("oom", "out of memory", "hiperroroutofmemory")),
    ("CORRUPT_INPUT", ("corrupt", "checksum", "truncated")),
    ("NAN", ("nan", "inf", "nonfinite")),
    ("WORKER_CRASH", ("crash", "segfault", "worker died")),
    ("OUTPUT_TRUNCATED", ("truncat", "short read", "incomplete write")),
    ("DETERMINISTIC_FAILURE", ("assertion",)),
)


def first_of(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule whose condition is true."""
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(otherwise))


def within_unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))


def entropy(*masses: Column) -> Column:
    """In bits, of masses that add up to one; an empty one adds nothing."""
    return reduce(Column.__add__, (F.when(m > 0, -m * F.log2(m)).otherwise(0.0) for m in masses))


def _evidence(names: Sequence[str]) -> tuple[list[Column], Column]:
    parts = [within_unit(F.col(n)) for n in names]
    return parts, reduce(Column.__add__, parts) / len(parts)


EVIDENCE = ("prediction", "image", "segmentation", "agreement", "morphology")


def verdict(names: Sequence[str] = EVIDENCE, status: str = "status") -> Column:
    """Of a candidate with five confidences and the status of its border."""
    (pc, ie, sc, ma, mc), mean = _evidence(names)
    state, gap = F.lower(F.trim(F.coalesce(F.col(status), F.lit("")))), F.abs(pc - ie)
    strong = (pc >= 0.75) & (ie >= 0.75) & (sc >= 0.75) & (ma >= 0.80) & (mc >= 0.70)
    rules = [
        ((pc < 0.20) | (ie < 0.15), "REJECTED"),
        ((ma < 0.40) & (gap > 0.40), "CONFLICTING"),
        (strong & state.isin(*CLEAN), "SUPPORTED"),
        ((mean >= 0.60) & (ma >= 0.55) & (gap <= 0.35), "PROBABLE"),
        (state.isin(*UNCLEAR) | ((mean >= 0.40) & (mean < 0.60) & (gap >= 0.25)), "AMBIGUOUS"),
    ]
    return first_of(rules, "REVIEW")


def with_gain(df: DataFrame, names: Sequence[str] = EVIDENCE, status: str = "status") -> DataFrame:
    """`df` with the six soft masses of the verdicts (which add up to one), their entropy and the information gain of a review."""
    (pc, ie, _, ma, mc), mean = _evidence(names)
    state, conflict = F.lower(F.trim(F.coalesce(F.col(status), F.lit("")))), F.abs(pc - ie) * (1 - ma)
    penalty = F.when(state.isin(*UNCLEAR), 0.35).when(state.isin(*CLEAN, ""), 0.0).otherwise(0.15)
    raw = {
        "supported": mean * ma * (1 - conflict) - penalty,
        "probable": mean * 0.85 - conflict * 0.5,
        "ambiguous": F.lit(0.25) + penalty + (0.5 - F.abs(mean - 0.5)),
        "conflicting": conflict * 1.5,
        "review": (1 - mc) * 0.6 + (1 - mean) * 0.2,
        "rejected": F.when(mean < 0.35, (0.35 - mean) * 2).otherwise(0.0),
    }
    rows = df.withColumns({k: F.greatest(F.lit(0.0), v) for k, v in raw.items()} | {"__mean": mean, "__morphology": mc})
    total = reduce(Column.__add__, (F.col(k) for k in raw))
    rows = rows.withColumn("__total", F.when(total == 0, 1.0).otherwise(total)).withColumns({k: F.col(k) / F.col("__total") for k in raw})
    rows = rows.withColumn("entropy", entropy(*(F.col(k) for k in raw)))
    return rows.withColumn("gain", F.col("entropy") * (1 - F.col("__mean")) * (1 - F.col("__morphology"))).drop("__mean", "__morphology", "__total")


def region_class(tissue: Column, information: Column, border: Column, artifact: Column, doubt: Column, prior: Column) -> Column:
    return first_of(
        [
            (artifact >= 0.12, "ARTIFACT"),
            ((tissue < 0.05) & (information < 0.8), "EMPTY"),
            (doubt >= 0.75, "UNCERTAIN"),
            ((prior >= 0.5) & (doubt >= 0.45), "REPROCESS"),
            ((border >= 0.25) | (information >= 4.5), "HIGH_COMPLEXITY"),
            ((information < 1.2) & (border < 0.08) & (tissue < 0.35), "LOW_INFORMATION"),
        ],
        "NORMAL",
    )


def region_priority(class_: Column, information: Column, border: Column, artifact: Column, doubt: Column, prior: Column) -> Column:
    base = 0.30 * doubt + 0.25 * artifact + 0.20 * F.least(F.lit(1.0), border / 0.5) + 0.15 * (1 - prior) + 0.10 * F.least(F.lit(1.0), information / 8)
    boost = reduce(lambda rest, c: F.when(class_ == c[0], c[1]).otherwise(rest), CLASS_BOOST.items(), F.lit(0.05))
    return within_unit(base + boost)


def inclusive_iou(a: str, b: str) -> Column:
    """Of two boxes whose ends belong to them."""
    both = one = two = F.lit(1)
    for axis in "zyx":
        (a0, a1), (b0, b1) = ((F.col(f"{p}{axis}0"), F.col(f"{p}{axis}1")) for p in (a, b))
        both = both * F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)
        one, two = one * F.greatest(F.lit(1), a1 - a0 + 1), two * F.greatest(F.lit(1), b1 - b0 + 1)
    return both / (one + two - both)


def seam_confidence(overlap: Column, direction: Column, morphology: Column, distance: Column, halo: float) -> Column:
    return within_unit(0.30 * overlap + 0.25 * direction + 0.25 * morphology + 0.20 * F.exp(-distance / max(1.0, 2.0 * halo)))


def seam_action(confidence: Column, overlap: Column, morphology: Column, volume_ratio: Column, distance: Column, direction: Column, halo: float) -> Column:
    return first_of(
        [
            ((confidence >= 0.75) & (overlap >= 0.20) & (morphology >= 0.50), "MATCH"),
            ((confidence >= 0.60) & (overlap >= 0.35) & (volume_ratio < 0.40), "MERGE"),
            ((overlap < 0.05) & (distance < halo) & (direction < 0.30), "SPLIT"),
            (confidence < 0.35, "HOLD"),
        ],
        "REVIEW",
    )


def branch_sums(distance: Column, direction: Column, diameters: Column, segmentation: Column, image: Column, model: Column) -> tuple[Column, Column]:
    """(share for merging, share for splitting) of the evidence on two branches: each item speaks for one side with a score."""
    shape = diameters * (0.5 + 0.5 * direction)
    items = [  # (speaks for a merge, score if so, score if not; None: says nothing then)
        (distance <= 5, F.least(F.lit(1.0), 1 - distance / 5), F.least(F.lit(1.0), (distance - 5) / 20)),
        (direction > 0.7, direction, 1 - direction),
        (diameters > 0.7, diameters, 1 - diameters),
        (segmentation >= 0.6, F.lit(0.0), 1 - segmentation),
        (shape > 0.6, shape, 1 - shape),
        (image > 0.55, F.abs(image - 0.5) * 2, F.abs(image - 0.5) * 2),
        (model > 0.55, F.abs(model - 0.5) * 2, F.abs(model - 0.5) * 2),
    ]
    merge = reduce(Column.__add__, (F.when(c, score).otherwise(0.0) for c, score, _ in items))
    split = reduce(Column.__add__, (F.when(c, 0.0).otherwise(score) for c, _, score in items))
    total = F.greatest(merge + split, F.lit(1e-6))
    return merge / total, split / total


def branch_decision(merge: Column, split: Column, segmentation: Column) -> Column:
    return first_of([((F.abs(merge - split) < 0.15) | (segmentation < 0.5), "REVIEW"), (merge >= 0.62, "MERGE"), (split >= 0.62, "SPLIT")], "REVIEW")


def diagnosis(message: Column, deterministic: Column | None = None) -> Column:
    """Of a failure by its message: the first kind one of whose words stands in it."""
    text = F.lower(F.coalesce(message, F.lit("")))
    found = [(reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words)), name) for name, words in FAILURES]
    if deterministic is not None:
        found[-1] = (found[-1][0] | F.coalesce(deterministic, F.lit(False)), found[-1][1])
    return first_of(found, "UNKNOWN")


def causes(changes: DataFrame, key: str, weights: dict[str, Sequence[tuple[Column, Column | float]]]) -> DataFrame:
    """(key, cause, score, rank) of rows of `changes`: for each cause the sum of the weights whose conditions hold; causes
    without any are left out, and ranks go by score, then name."""
    scores = [F.struct(F.lit(name).alias("cause"), F.round(reduce(Column.__add__, (F.when(c, w).otherwise(0.0) for c, w in ws)), 4).alias("score")) for name, ws in weights.items()]
    ranked = F.array_sort(F.filter(F.array(*scores), lambda s: s["score"] > 0), lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(F.when(a["cause"] < b["cause"], -1).otherwise(1)))
    return changes.select(key, F.posexplode(ranked).alias("rank", "c")).select(key, "c.cause", "c.score", (F.col("rank") + 1).alias("rank"))


def review_scores(affinity: Column, contacts: Column) -> tuple[Column, Column]:
    """(how undecided an affinity is, that weighed by the size of the contact)."""
    doubt = 1 - F.abs(2 * affinity - 1)
    return doubt, doubt * F.log1p(contacts)
