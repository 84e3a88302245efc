"""Licence scans against the same rules in plain Python, and planted licences."""

import re

import pytest
from conftest import SMALL

from tallyloom.llm import license_rules, licenses, registry

RULES = license_rules.rules()
PATTERNS = [re.compile(p, re.ASCII) for *_, p in RULES]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(w):
    places = {label: [i for i in range(len(w)) if tuple(w[i : i + len(p)]) == p] for label, p in {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}.items()}
    every = [i for own in places.values() for i in own]
    return len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(x for x in places if places[x]))


def brute_found(w):
    found = []
    for i in range(len(w)):
        context = " ".join(w[i : i + 40])
        for k, (_, label, priority, _) in enumerate(RULES):
            if m := PATTERNS[k].match(context):
                found.append((i, i + len(m[0].split(" ")), label, priority, k))
    rank = lambda d: (d[3], d[1] - d[0], -d[4])
    return [d for d in found if not any(o[0] <= d[0] and o[1] >= d[1] and rank(o) > rank(d) for o in found)]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        w = words_of(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(w), r
        found = brute_found(w)
        labels = sorted({*filter(None, r.base_labels.split(",")), *(d[2] for d in found)})
        assert r.labels == ",".join(labels), (r, found)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check(registry.QUERIES["op12_licenses"](spark, SMALL).collect(), texts)


PLANTED = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0,apache",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only,gpl",
    "Released under the MIT License.": "MIT,mit",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "GNU Lesser General Public License v2.1": "LGPL-2.1-only,gpl",
    "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
    "Permission is hereby granted, free of charge,\nto any person obtaining a copy\n * of this software and associated documentation files (the Software)": "MIT",
    "see https://creativecommons.org/licenses/by-sa/3.0/": "CC-BY-SA-3.0",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": "CC-BY-NC-SA-4.0",
    "BSD 3-Clause License": "BSD-3-Clause",
    "Mozilla Public License Version 2.0": "MPL-2.0",
    "GPL version 2.1 is none, gplv3 is": "GPL-3.0-only,GPL-any",
    "a license to mitigate apache helicopters": "",
    "MITÉ license, mit licenses, MIT  -- LICENSE": "MIT,mit",
    "submit license": "",
    "CC0 1.0 Universal": "CC0-1.0",
    "": "",
    " \n": "",
}


def test_planted_licences(spark):
    rows = [(k, t, "x", 5) for k, t in enumerate(PLANTED)] + [(100, None, "x", 5), (101, "mit license " * 3000 + "gpl " * 3000, "x", 5), (101, "mit license " * 3000 + "gpl " * 3000, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Labels string, n_words int")
    got = licenses.find_licenses(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id < 100:
            assert ",".join(r["labels"]) == list(PLANTED.values())[r.doc_id], (list(PLANTED)[r.doc_id], r)
        if r.doc_id == 101:
            assert r["labels"] == ["GPL-any", "MIT", "mit"] and len(r.phrases.mit) == 3000 and len(r.detections) == 6000
    assert licenses.find_licenses(df.limit(0)).collect() == []


def must(pattern):
    """What every match of a pattern holds, with ~ for what may differ."""
    p = re.sub(r"\(\?!.*?\)", "", pattern[4 : -len(")(?= |$)")]).replace("(?:", "(")
    for _ in range(9):
        p = re.sub(r"\([^()]*\|[^()]*\)", "~", re.sub(r"\([^()]*\)(\?|\*|\{0?,?\d*(,\d+)?\})", "~", p))
    return re.sub(r".\?", "~", re.sub(r"\[[^\]]*\][?*]?", "~", p))


def test_rules_have_stems():
    """No rule can match a text that the stems leave out."""
    assert len(RULES) > 400 and len({label for _, label, _, _ in RULES}) > 100
    for keyword, label, _, pattern in RULES:
        need = must(pattern)
        assert any(s in need for s in licenses.STEMS) or re.search(rf"(?<![a-z0-9~])({'|'.join(licenses.SHORT)})", need), (label, pattern)
        assert pattern.startswith(f"^(?:{keyword}")


def test_native(spark):
    plan = registry.QUERIES["op12_licenses"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", ["gnu general public license version 3 or any later version", "the mit license", "cc by 4 0 and cc by sa"])
def test_suppression(spark, text):
    got = licenses.find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(d.start, d.stop, d.label) for d in got.detections] == [d[:3] for d in brute_found(words_of(text))]
