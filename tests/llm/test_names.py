"""Columns of the input that are named like helper columns keep their values."""

import pytest
from pyspark.sql import functions as F

from meshquarry.llm import decontam, langid, licenses, linededup, neardup, pii, tokenfile

HELPERS = ["__row", "__text", "__at", "__id", "__hash", "__key", "__spans", "__removed", "__found", "__padded", "__words"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"line one of all documents\nown words {i} mail a{i}@ex.org alpha beta gamma {'x' * i}", *[f"{c}{i}" for c in HELPERS], "kept") for i in range(12)]
    rows.append((12, rows[3][1], *[f"{c}12" for c in HELPERS], "kept"))
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in HELPERS) + ", __row_own0 string")


@pytest.mark.parametrize("name", ["decontaminate", "representatives", "dedup_lines", "sanitise", "identify", "accepted", "scan"])
def test_helper_names(spark, clashing, name):
    benchmark = spark.createDataFrame([(1, "none of these words are anywhere else at all")], "item_id long, text string")
    model = langid.fit(clashing.withColumn("lang", F.lit("en")))
    out = {
        "decontaminate": lambda: decontam.decontaminate(clashing, benchmark),
        "representatives": lambda: neardup.representatives(clashing),
        "dedup_lines": lambda: linededup.dedup_lines(clashing),
        "sanitise": lambda: pii.sanitise(clashing),
        "identify": lambda: langid.identify(clashing, model),
        "accepted": lambda: langid.accepted(clashing, model),
        "scan": lambda: licenses.scan(clashing),
    }[name]()
    assert [c for c in out.columns if c in clashing.columns] == clashing.columns
    got = out.collect()
    assert len(got) >= 11 and all(r[c] == f"{c}{r.doc_id}" for r in got for c in HELPERS) and {r["__row_own0"] for r in got} == {"kept"}


def test_ids_of_other_kinds_are_refused(spark):
    with pytest.raises(TypeError):
        tokenfile.write_tokens(spark.createDataFrame([("a", "b")], "doc_id string, text string"), "/nowhere")
