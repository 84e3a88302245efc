"""Whether two written answers have the same value: formulas, and intervals, tuples, sets and matrices of them.

Formulas of sums, products, quotients and whole powers are compared at points chosen by
their letters, modulo a prime: different ones agree at all of them only by a chance of
about their degree in 2 ** 61. Those with roots or functions are compared as numbers at
such points. Work is bounded by steps, not by time: what takes more is left as different.
Only rows that text and numbers leave open should get here.
"""

from __future__ import annotations

import cmath
import math
import re
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 61) - 1
POINTS, MOST_TOKENS, MOST_DEPTH, MOST_POWER = 3, 400, 40, 10_000
CLOSE = 1e-12
DROPPED = re.compile(r"\\(?:left|right|displaystyle|,|;|!|:| |quad|qquad)(?![a-zA-Z])|\^\{?\\circ\}?|\\?[$%]|\s+|\\text\{[^{}]*\}|\\mbox\{[^{}]*\}")
TOKEN = re.compile(r"\\[a-zA-Z]+|\d+\.\d+|\.\d+|\d+\.?|\*\*|[a-zA-Z]+|.", re.DOTALL)
FUNCTIONS = {f: getattr(cmath, f) for f in ("sin", "cos", "tan", "exp", "log", "sinh", "cosh", "tanh", "asin", "acos", "atan")} | {"ln": cmath.log, "abs": abs}
CONSTANTS = {"pi": math.pi, "e": math.e, "E": math.e}
SAME_SIGN = {"\\cdot": "*", "\\times": "*", "\\div": "/", "**": "^", "\\lbrack": "[", "\\rbrack": "]", "\\{": "{", "\\}": "}"}


class Open(Exception):
    """Nothing can be said: not a formula, or too much work."""


class Irrational(Exception):
    """Not made of sums, products, quotients and whole powers alone."""


class Reader:
    """A formula as nested tuples. In LaTeX letters stand for themselves and products need no sign; in plain text words are names."""

    def __init__(self, text: str):
        self.latex = "\\" in text
        self.tokens = [SAME_SIGN.get(t, t) for t in TOKEN.findall(DROPPED.sub("", text))]
        if self.latex:
            self.tokens = [c for t in self.tokens for c in (t if t.isalpha() else [t])]
        if not 0 < len(self.tokens) <= MOST_TOKENS:
            raise Open
        self.at = self.depth = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        t = self.peek()
        if not t or (wanted and t != wanted):
            raise Open
        self.at += 1
        return t

    def whole(self) -> tuple:
        out = self.sum()
        if self.peek():
            raise Open
        return out

    def sum(self) -> tuple:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise Open
        out = self.product()
        while self.peek() in ("+", "-"):
            out = (self.take(), out, self.product())
        self.depth -= 1
        return out

    def product(self) -> tuple:
        out = self.signed()
        while True:
            if self.peek() in ("*", "/"):
                out = (self.take(), out, self.signed())
            elif self.latex and (self.peek()[:1].isalnum() or self.peek() in ("(", "{") or self.peek()[:1] == "\\"):
                out = ("*", out, self.power())
            else:
                return out

    def signed(self) -> tuple:
        if self.peek() in ("+", "-"):
            sign = self.take()
            own = self.signed()
            return own if sign == "+" else ("-", ("n", Fraction(0)), own)
        return self.power()

    def power(self) -> tuple:
        base = self.atom()
        if self.peek() == "!":
            self.take()
            base = ("f", "!", base)
        if self.peek() == "^":
            self.take()
            return ("^", base, self.argument(signed=True))
        return base

    def argument(self, signed: bool = False) -> tuple:
        """What follows ^, \\frac or \\sqrt: a group, or one sign."""
        if self.peek() in ("{", "("):
            return self.group()
        if signed:
            return self.signed()
        if self.peek().isdigit() and len(self.peek()) > 1:
            first, self.tokens[self.at] = self.peek()[0], self.peek()[1:]
            return ("n", Fraction(first))
        return self.atom()

    def group(self) -> tuple:
        end = {"{": "}", "(": ")", "[": "]", "|": "|"}[self.take()]
        out = self.sum()
        self.take(end)
        return out

    def atom(self) -> tuple:
        t = self.peek()
        if t in ("(", "{", "["):
            return self.group()
        if t == "|":
            return ("f", "abs", self.group())
        self.take()
        if t[0].isdigit() or (t[0] == "." and len(t) > 1):
            return ("n", Fraction(t.rstrip(".")))
        name = t.lstrip("\\")
        if name in ("frac", "dfrac", "tfrac") and t[0] == "\\":
            return ("/", self.argument(), self.argument())
        if name == "sqrt":
            degree = self.group() if self.peek() == "[" else ("n", Fraction(2))
            return ("^", self.argument(), ("/", ("n", Fraction(1)), degree))
        if name in FUNCTIONS and (t[0] == "\\" or self.peek() == "("):
            return ("f", name, self.argument() if self.peek() in ("(", "{") else self.power())
        if not name.isalpha() or (t[0] == "\\" and name not in ("pi", "theta", "alpha", "beta", "gamma", "lambda", "mu", "phi", "omega", "infty")):
            raise Open
        return ("v", name)


def exact(node: tuple) -> Fraction:
    """The value of an exponent, which has to be a plain number."""
    kind = node[0]
    if kind == "n":
        return node[1]
    if kind in ("+", "-", "*", "/"):
        a, b = exact(node[1]), exact(node[2])
        if kind == "/" and b == 0:
            raise Open
        return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b
    raise Irrational


def residue(node: tuple, point: int) -> int:
    kind = node[0]
    if kind == "n":
        return node[1].numerator * pow(node[1].denominator, -1, PRIME) % PRIME
    if kind == "v":
        if node[1] == "infty":
            raise Irrational
        return int.from_bytes(f"{zlib.crc32(f'{point}:{node[1]}'.encode()):x}:{point}".encode(), "big") * 0x9E3779B97F4A7C15 % PRIME
    if kind == "f":
        raise Irrational
    if kind == "^":
        n = exact(node[2])
        if n.denominator != 1:
            raise Irrational
        if abs(n) > MOST_POWER:
            raise Open
        a = residue(node[1], point)
        if a == 0 and n <= 0:
            raise Open
        return pow(a, int(n), PRIME)
    a, b = residue(node[1], point), residue(node[2], point)
    if kind == "/":
        if b == 0:
            raise Open
        return a * pow(b, -1, PRIME) % PRIME
    return (a + b if kind == "+" else a - b if kind == "-" else a * b) % PRIME


def number(node: tuple, point: int | None) -> complex:
    """The value at a point; without one, letters leave it open."""
    kind = node[0]
    if kind == "n":
        return complex(node[1])
    if kind == "v":
        if node[1] in CONSTANTS:
            return complex(CONSTANTS[node[1]])
        if point is None or node[1] == "infty":
            raise Open
        return complex(0.5 + 2 * zlib.crc32(f"{point}:{node[1]}".encode()) / 2**32)
    if kind == "f":
        a = number(node[2], point)
        if node[1] == "!":
            if a.imag or a.real < 0 or a.real > 100 or a.real != int(a.real):
                raise Open
            return complex(math.factorial(int(a.real)))
        return complex(FUNCTIONS[node[1]](a))
    a, b = number(node[1], point), number(node[2], point)
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b if kind == "/" else a**b


def near(a: complex, b: complex, tolerance: float) -> bool:
    return cmath.isfinite(a) and cmath.isfinite(b) and abs(a - b) <= tolerance * max(abs(a), abs(b)) or a == b


def same_value(a: str, b: str) -> bool:
    """Whether two formulas are identical; what can't be read, or takes too much work, is not."""
    try:
        x, y = Reader(a).whole(), Reader(b).whole()
        try:
            return all(residue(x, k) == residue(y, k) for k in range(POINTS))
        except Irrational:
            return all(near(number(x, k), number(y, k), CLOSE) for k in range(POINTS))
    except (Open, Irrational, ArithmeticError, ValueError, RecursionError):
        return False


def value_of(text: str) -> complex | None:
    try:
        return number(Reader(text).whole(), None)
    except (Open, ArithmeticError, ValueError, RecursionError):
        return None


def parts_of(text: str, sign: str = ",") -> list[str]:
    """What stands between the signs that no bracket holds."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if depth == 0 and text.startswith(sign, i):
            out.append(text[start:i].strip())
            start = i + len(sign)
    return [*out, text[start:].strip()]


INTERVALS = {"Interval": "[]", "Interval.open": "()", "Interval.Lopen": "(]", "Interval.Ropen": "[)", "Point": "()", "FiniteSet": "{}"}
MATRIX = re.compile(r"^\\begin\{([pbvBV]?matrix|array)\}(?:\{[lcr|]*\})?(.*?)\\end\{\1\}$", re.DOTALL)


def shape(text: str) -> tuple[str, list]:
    """("matrix", rows), ("union", parts), a pair of brackets with parts, or ("", [text])."""
    t = re.sub(r"\\(?:left|right)(?![a-zA-Z])", "", text).strip().replace("\\{", "{").replace("\\}", "}").replace("\\lbrack", "[").replace("\\rbrack", "]")
    if m := MATRIX.match(t):
        return "matrix", [[c.strip() for c in row.split("&")] for row in m[2].strip().removesuffix("\\\\").split("\\\\")]
    if m := re.match(r"^(Interval(?:\.\w+)?|Point|FiniteSet)\((.*)\)$", t, re.DOTALL):
        if m[1] in INTERVALS:
            return INTERVALS[m[1]], parts_of(m[2])
    if t.startswith("Matrix(") and t.endswith(")"):
        t = t[7:-1].strip()
    if t.startswith("[[") and t.endswith("]]"):
        return "matrix", [parts_of(row.strip()[1:-1]) for row in parts_of(t[1:-1])]
    for sign in ("\\cup", "∪"):
        if len(found := parts_of(t, sign)) > 1:
            return "union", found
    if len(t) > 1 and t[0] in "([{" and t[-1] in ")]}":
        inner = parts_of(t[1:-1])
        if len(inner) > 1 or t[0] == "{":
            return t[0] + t[-1], inner
    found = parts_of(t)
    return ("", found) if len(found) > 1 and not re.fullmatch(r"-?\d{1,3}(,\d{3})+(\.\d+)?", t) else ("", [t])


def plain_number(text: str) -> float | None:
    t = re.sub(r"^\$(?=\d+(\.\d+)?)", "", text.strip())
    t = re.sub(r"^(\d+(?:\.\d+)?)\\?%$", r"\1", t).replace("{,}", "").replace(",", "")
    return float(t) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t) else None


def graded(given: str, truth: str, percent: bool = True, tolerance: float = 1e-4, depth: int = 0) -> bool:
    """Whether an answer is right: equal text, numbers within the tolerance (also as per cent), or the same shape with equal parts.

    Brackets have to be the same, but a list may go without them. Sets may come in any order, all else may not.
    """
    a, b = given.strip(), truth.strip()
    if a.lower() == b.lower() or a.replace(" ", "") == b.replace(" ", ""):
        return True
    if not a or len(a) + len(b) > 4000 or depth > 4:
        return False
    x, y = plain_number(a), plain_number(b)
    if x is not None and y is not None:
        return any(math.isclose(v, x, rel_tol=tolerance) for v in ((y / 100, y, y * 100) if percent else (y,)))
    (kind, own), (wanted, others) = shape(a), shape(b)
    if kind == "matrix" and wanted == "matrix":
        return [len(r) for r in own] == [len(r) for r in others] and all(graded(p, q, percent, tolerance, depth + 1) for r, s in zip(own, others) for p, q in zip(r, s))
    if len(own) > 1 or len(others) > 1 or "{}" in (kind, wanted):
        if kind != wanted and kind and wanted or len(own) != len(others):
            return False
        if kind == wanted == "{}":
            left = list(others)
            for p in own:
                hit = next((k for k, q in enumerate(left) if graded(p, q, percent, tolerance, depth + 1)), None)
                if hit is None:
                    return False
                left.pop(hit)
            return True
        return all(graded(p, q, percent, tolerance, depth + 1) for p, q in zip(own, others))
    if same_value(a, b):
        return True
    u, v = value_of(a), value_of(b)
    return u is not None and v is not None and near(u, v, tolerance)


def by_pairs(test: Callable[[str, str], bool]) -> Callable:
    """A column function of two texts, worked out once for equal pairs of a batch; null if either is."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            known: dict[tuple[str, str], bool] = {}
            out = []
            for pair in zip(a, b):
                if pair[0] is None or pair[1] is None:
                    out.append(None)
                    continue
                if pair not in known:
                    known[pair] = test(*pair)
                out.append(known[pair])
            yield pd.Series(out, dtype="object")

    return run


def compare(df: DataFrame, a: str, b: str, decided: Column, out: str, test: Callable[[str, str], bool] = same_value) -> DataFrame:
    """Add a column: what is decided already, else the test. Texts of decided rows don't go to Python; null texts are different."""
    told = df.withColumn("_decided", decided)
    undecided = F.col("_decided").isNull()
    asked = told.withColumn("_tested", by_pairs(test)(F.when(undecided, F.col(a)), F.when(undecided, F.col(b))))
    return asked.withColumn(out, F.coalesce("_decided", "_tested", F.lit(False))).drop("_decided", "_tested")
