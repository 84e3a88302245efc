"""Answers: cases of extraction, normal forms, comparison and grading."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import algebra, answers

EXTRACTED = {
    r"...therefore \boxed{42}.": ("42", "boxed"), r"final is \boxed{\frac{3}{7}}": (r"\frac{3}{7}", "boxed"), "Some reasoning.\nAnswer: 540": ("540", "answer_line"), "... blah blah 123": ("123", "last_number"), "": ("", "none"),
    "She has 9 eggs at $2 each = $18": ("18", "last_number"), "So the answer is 3.5 metres": ("3.5 metres", "the_answer_is"), "The answer is obviously unknown": ("", "none"), "ANSWER: 7": ("7", "answer_line"), r"\boxed {42}": ("42", "boxed"),
    "we get 1/2": ("1/2", "last_number"), "1,234": ("234", "last_number"), r"\boxed{}": ("", "boxed"), "Answer:\n 9. \nrest": ("9", "answer_line"), "the answer is 4..": ("4", "the_answer_is"), r"x \sqrt{2}": (r"\sqrt{2}", "last_latex"),
    r"\boxed{1} and \boxed{2}": ("2", "boxed"), "Answer: 3\nAnswer: 4": ("4", "answer_line"), r"\boxed{" + "7" * 100_000 + "}": ("7" * 100_000, "boxed"), "5" + " " * 500: ("", "none"),
}
SAME = [("540", "540", ""), ("540", "540", "integer_0_999"), (r"\frac{1}{2}", r"\frac{1}{2}", ""), ("0.5", "1/2", ""), (r"\boxed{\$18}", "18", "numeric"), (r"\boxed{$18}", "18", "numeric"), (r"\boxed{70,000}", "70000", "numeric"), (r"\boxed{1,234,567}", "1234567", "numeric"), (r"\boxed{18 dollars}", "18", "numeric"), (r"\boxed{25%}", "25", "numeric"), (r"\boxed{\$70,000}", "70000", "numeric"), ("007", "7", "integer_0_999"), (r"\frac12", "0.5", ""), (r"\sqrt{8}", r"2\sqrt{2}", ""), ("(x+1)**2", "x**2+2*x+1", ""), ("+5", "5", ""), ("1e3", "1000", "")]
DIFFERENT = [("541", "540", ""), ("541", "540", "integer_0_999"), ("x+1", "x+2", ""), ("", "", ""), ("18", "19", "numeric"), ("1/3", "0.333", ""), ("2x", "x2", ""), (None, "1", ""), ("1", None, "")]
NUMBERS = {r"\boxed{$70,000}": "70000", "$18": "18", "18 dollars": "18", "18%": "18", "70,000": "70000", "€ 5 kg.": "5", "3¥": "3", "1,23": "1,23", None: ""}
DAPO = {("Answer: x=5 km", "5"): 1.0, ("Answer: 12,000", "12000"): 1.0, (r"Answer: \frac12", r"\frac{1}{2}"): 1.0, ("answer : $7$ points", "7"): 1.0, ("Answer: 8", "7"): -1.0, ("no", "7"): -1.0, (r"Answer: \text{A and B}", "A and B"): 1.0, (r"Answer: \sqrt2", r"\sqrt{2}"): 1.0}


def test_extraction(spark):
    df = spark.createDataFrame([(t,) for t in [*EXTRACTED, None]], "t string")
    got = {r.t: (r.a.value, r.a.method) for r in df.select("t", answers.extract(F.col("t")).alias("a")).collect()}
    assert {**got, None: ("", "none")} == {**EXTRACTED, None: ("", "none")} and got[None] == ("", "none")


def test_comparison(spark):
    rows = [(*r, True) for r in SAME] + [(*r, False) for r in DIFFERENT]
    df = spark.createDataFrame(rows, "a string, b string, kind string, want boolean")
    got = algebra.compare(df, "a", "b", answers.decided(F.col("a"), F.col("b"), F.col("kind")), "same").collect()
    assert [(r.a, r.b, r.same) for r in got] == [(r[0], r[1], r[3]) for r in rows]


def test_number_forms_and_scores(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x string")
    assert {r.x: r.n for r in df.select("x", answers.normalize_number(F.col("x")).alias("n")).collect()} == NUMBERS
    df = spark.createDataFrame(list(DAPO), "t string, gold string")
    assert {(r.t, r.gold): r.s for r in df.select("t", "gold", answers.dapo_score(F.col("t"), F.col("gold"))["score"].alias("s")).collect()} == DAPO


@pytest.mark.parametrize(("a", "b", "same"), [
    ("0.5", r"\frac{1}{2}", True), (r"\sqrt{\sqrt{16}}", "2", True), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt{2}}{2}", True), (r"2^{3^2}", "512", True), ("(a+b)(a-b)", "a^2-b^2", False), (r"(a+b)(a-b)\cdot 1", "a**2-b**2", True), (r"\sqrt[3]{27}", "3", True),
    (r"\frac{x^2-1}{x-1}", r"x+1 \cdot 1", True), (r"3\pi", r"\pi \cdot 3", True), (r"\sin^2", "1", False), ("x", "y", False), ("((((", "1", False), ("1/0", "1/0*2", False), ("(" * 200 + "1" + ")" * 200, "1", False), ("2^(10**9)", "3", False), ("5!", "120", True),
    ("9" * 390, "9" * 390 + ".0", True), (r"\sqrt{2}", "1.41421356", False), ("abc", "bca", False), (r"abc", r"bca \cdot 1", False), (r"a b c \cdot 1", r"b c a \cdot 1", True), ("-2^2", "-4", True), ("2**-1", "0.5", True), (r"|-3|\cdot 1", "3", True),
])
def test_identity(a, b, same):
    assert algebra.same_value(a, b) is same


@pytest.mark.parametrize(("a", "b", "right"), [
    ("[1, 2)", r"\left[1,2\right)", True), ("[1,2)", "(1,2)", False), ("Interval.Ropen(1, 2)", "[1,2)", True), ("Interval(0, 1/2)", "[0, 0.5]", True), ("(1, 2)", "1, 2", True), ("(1,2,3)", "(1,2)", False), (r"\{2, 1\}", "{1,2}", True), ("{1,2}", "{1,3}", False),
    (r"\begin{pmatrix}1 & 2\\3 & 4\end{pmatrix}", "Matrix([[1,2],[3,4.0]])", True), (r"\begin{bmatrix}1 & 2\end{bmatrix}", "[[1,3]]", False), ("25%", "0.25", True), ("50", "0.5", True), ("3.14159", r"\pi", True), ("3.2", r"\pi", False), ("Point(1, 2)", "(1,2)", True),
    ("(0,1) \\cup (2,3)", "(0, 1)∪(2, 3)", True), ("(0,1)∪(2,3)", "(0,1]∪(2,3)", False), (r"(0,1) \cup (2,3)", r"(0,1.0)\cup(2,3)", True), ("1,000", "1000", True), ("Yes", "yes", True), ("", "1", False), (r"(\frac{1}{2}, x^2)", "(0.5, x**2)", True), ("x = 3", "3", False),
])
def test_grading(a, b, right):
    assert algebra.graded(a, b) is right
