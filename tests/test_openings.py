"""Openings, bypassed reasoning and segments by the rules in plain Python."""

import re

from conftest import SMALL
from pyspark.sql import functions as F

from tallyloom.functions import openings


def plain_segments(text):
    text = (text or "").strip()
    if not text:
        return []
    for pattern in (r"(?=\n?\s*(?:Step\s*\d+|\d+[\.)])\s+)", r"\n\s*\n+", r"(?<=[.!?。！？])\s+"):
        pieces = [p.strip() for p in re.split(pattern, text) if p.strip()]
        if len(pieces) >= 2:
            return pieces
    return pieces


def test_segments(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["Step 1 a\nStep 2: b\n Step  3 c", "1. one 2) two 12. three", "12. only", "a\n\nb\n \n\nc", "One. Two! Three", "一。 二？ 三", "", None, "  ", "no end", "3.5 and 4.5 x", "Step1 go Step2 stop"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", openings.segments(F.col("t")).alias("s")).collect():
        assert r.s == plain_segments(texts[r.i]), texts[r.i][:80]


MODES = [
    ("Let me think", None, None, True, "Other"), ("We were there", None, None, True, "Other"), ("First of all", None, None, True, "Other"), ("Some [note] here", "p", ["x:placeholder"], True, "Other"), ("[note] here", "p", ["x:placeholder"], True, "CSI"),
    ("[note] here", "p", ["x:placeholder"], False, "Other"), ("[note] here", None, ["x:placeholder"], True, "Other"), ("[note] here", "p", [], True, "Other"), ("Okay, x", None, None, False, "DRI"), (" So the answer is", None, None, False, "DAI"), ("So what", None, None, False, "DRI"),
    ("so what", None, None, False, "Other"), ("\\boxed{3}", None, None, False, "DAI"), ("42.", None, None, False, "DAI"), ("42", None, None, False, "Other"), ("answer is 3", None, None, False, "DAI"), (None, None, None, True, "Other"), ("", "p", ["keywords:x"], True, "Other"),
    ("cat and dog", "use 'cat' or \"dog\"", ["keywords:existence"], True, "CSI"), ("cat and dog" + " x" * 200, "use 'cat' or \"dog\"", ["keywords:existence"], True, "Other"), ("cat only", "use 'cat' or \"dog\"", ["keywords:existence"], True, "Other"), ("Answer: [ Placeholder ]", "p", ["a", "placeholder"], True, "CSI"),
]


def test_modes(spark):
    df = spark.createDataFrame(MODES, "r string, p string, ids array<string>, e boolean, want string")
    for row in df.withColumn("mode", openings.opening_mode(F.col("r"), F.col("p"), F.col("ids"), F.col("e"))).collect():
        assert row.mode == row.want, row


def test_bypass(spark):
    rows = [("because " + "w " * 40, True, False), ("w " * 40, True, True), ("because", True, True), ("w " * 40, False, False), (None, True, True), ("x " * 40 + "let's go", True, False), ("x " * 40 + "lets go", True, True)]
    df = spark.createDataFrame(rows, "t string, tagged boolean, want boolean")
    assert [(r.t, r.b.bypass_reasoning) for r in df.select("t", openings.bypass(F.col("t"), F.col("tagged")).alias("b")).collect()] == [(t, w) for t, _, w in rows]
