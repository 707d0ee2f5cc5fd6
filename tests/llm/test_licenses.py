import re

import pytest

from meshquarry.llm import licenses as L
from meshquarry.llm.license_rules import BASE, rules


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def places(ws, phrase):
    p = phrase.split()
    return [i for i in range(len(ws)) if ws[i : i + len(p)] == p]


def naive(text):
    ws = words(text)
    padded = f" {' '.join(ws)} "
    found = []
    for r in rules():
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", padded):
            start = padded[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, r.priority, r.label, r.weight))
    found = sorted(set(found), key=lambda d: (d[0], -d[1], *d[2:]))
    return [d for i, d in enumerate(found) if not any(e[1] >= d[1] and e[2] <= d[2] for e in found[:i])]


TEXTS = [
    None,
    "",
    "...",
    "MIT License mit license, mit-license",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "the gnu general public license. CC BY-SA 4.0 and cc by and CC-BY 4.0. ccc by",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. MIT License",
    "été mitélicense mit licenses amit license",
    "BSD 3-Clause License; SPDX-License-Identifier: BSD-3-Clause",
    "word " * 5000 + "apache license " * 300 + "word",
]


@pytest.fixture(scope="module")
def scanned(spark):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, base string, n_words int")
    return {r.doc_id: r for r in L.scan(df).collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_scan_like_brute_force(scanned, i):
    ws, row = words(TEXTS[i]), scanned[i]
    assert row.n_words == len(ws)
    assert sorted((b.start, b.label) for b in row.base) == sorted((s, label) for phrase, label in BASE for s in places(ws, phrase))
    assert sorted({(d.start, d.till, d.priority, d.label) for d in row.detections}) == sorted(d[:4] for d in naive(TEXTS[i]))


def test_each_rule_holds_its_keyword():
    for r in rules():
        assert 1 <= r.priority <= 6 and 0 < r.weight <= 1
        plain = re.sub(r"\(\?:[^)]*\)\??", " ", r.pattern)  # what isn't optional or a choice
        assert {w for w in plain.replace(" ?", " ").split()} & {k[:3] for k in r.keywords} or any(k.split("v")[0][:3] in r.pattern for k in r.keywords)
    assert len(rules()) > 200 and len({(r.label, r.pattern) for r in rules()}) == len(rules())


KEYED = ["released under gplv2", "lgpl v2.1 and LGPLv3", "agplv3", "beerware license", "beer ware license", "cc-by-nc-sa 4.0", "Creative Commons Attribution NonCommercial ShareAlike"]


def test_query_like_brute_force(spark, tmp_path):
    texts = TEXTS + KEYED
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.op10_licenses(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ws, found, row = words(t), naive(t), got[i]
        base = [(s, label) for phrase, label in BASE for s in places(ws, phrase)]
        assert (row.n_words, row.n_base) == (len(ws), len(base))
        assert (row.first_word, row.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert row.base_labels == ",".join(sorted({x for _, x in base})) and row.labels == ",".join(sorted({x for _, x in base} | {d[3] for d in found}))
        assert row.score == max((d[4] for d in found), default=0.0)
    assert [got[len(TEXTS) + k].labels for k in range(7)] == ["gpl-2.0", "lgpl-2.1,lgpl-3.0", "agpl-3.0", "beerware", "beerware", "cc-by,cc-by-nc-sa-4.0", "cc-by-nc-sa"]


def test_odd_rows(odd, none):
    assert L.scan(none).collect() == []
    assert L.scan(odd).count() == odd.count()
