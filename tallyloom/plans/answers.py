"""Queries on answers: finding, normal forms, comparing and scoring. Their SQL states the rules by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import algebra as A
from tallyloom.functions import answers as N
from tallyloom.functions import scorers as S
from tallyloom.sources import views as V

from .registry import query


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _strip(x: str, marks: str = "\\s") -> str:
    return f"regexp_replace({x}, '^[{marks}]+|[{marks}]+$', '', 'g')"


_BOX = r"'\\boxed\s*\{((?:[^{}]|\{[^{}]*\})*)\}'"
_FOUND = r"""f1 AS (SELECT *, regexp_extract_all(response, {box}, 1) AS b, regexp_extract_all(response, '(?im)^\s*Answer\s*:\s*(.+?)\s*$', 1) AS l,
        regexp_extract_all(response, '(?i)\b(?:the\s+answer\s+is|final\s+answer\s*[:\-]?)\s*([\-+]?\s*[\d\\{{][^\n\r]{{0,120}})', 1) AS s,
        regexp_extract_all(right(response, 400), '\\frac\s*\{{[^{{}}]*\}}\s*\{{[^{{}}]*\}}|\\sqrt\s*\{{[^{{}}]*\}}|\\boxed\s*\{{[^{{}}]*\}}') AS f, regexp_extract_all(right(response, 400), '-?\d+(?:\.\d+)?(?:/\d+)?') AS n FROM {{source}}),
    f2 AS (SELECT *, CASE WHEN len(b) > 0 THEN {b} WHEN len(l) > 0 THEN rtrim({l}, '.') WHEN len(s) > 0 THEN rtrim({s}, '.') WHEN len(f) > 0 THEN f[-1] WHEN len(n) > 0 THEN n[-1] ELSE '' END AS value,
        CASE WHEN len(b) > 0 THEN 'boxed' WHEN len(l) > 0 THEN 'answer_line' WHEN len(s) > 0 THEN 'the_answer_is' WHEN len(f) > 0 THEN 'last_latex' WHEN len(n) > 0 THEN 'last_number' ELSE 'none' END AS method FROM f1)""".format(
    box=_BOX, b=_strip("b[-1]"), l=_strip("l[-1]"), s=_strip("s[-1]")
)


def _macro(x: str, steps: list[str]) -> str:
    """A step a line; each sees the one before as t."""
    out = x
    for step in steps:
        out = step.replace("{t}", f"({out})")
    return out


_DECOR = [r"regexp_replace({t}, '\\left\s*', '', 'g')", r"regexp_replace({t}, '\\right\s*', '', 'g')", r"regexp_replace({t}, '\\text\s*\{([^{}]*)\}', '\1', 'g')", r"regexp_replace({t}, '\\mbox\s*\{([^{}]*)\}', '\1', 'g')"]
_DECOR += [f"replace({{t}}, {_q(a)}, {_q(b)})" for a, b in (("\\$", "$"), ("\\%", "%"), ("\\!", ""), ("\\;", ""), ("\\,", ""), ("\\$", "$"), ("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"), ("\\cdot", "*"), ("\\times", "*"))]


def _normal(table: str, column: str, out: str) -> str:
    """Common table expressions that end in one called `table` with the normal form of `column` as `out`."""
    first = _macro(_strip(f"coalesce({column}, '')"), _DECOR)
    inner = lambda o, c: f"CASE WHEN starts_with({{t}}, '{o}') AND ends_with({{t}}, '{c}') THEN {_strip('substr({t}, 2, greatest(len({t}) - 2, 0))')} ELSE {{t}} END".replace("{t}", "t")
    return (
        f"{table}_1 AS (SELECT *, {first} AS t FROM {{source}}), {table}_2 AS (SELECT * EXCLUDE t, {inner('{', '}')} AS t FROM {table}_1), {table}_3 AS (SELECT * EXCLUDE t, {inner('$', '$')} AS t FROM {table}_2), "
        f"{table} AS (SELECT * EXCLUDE t, lower(regexp_replace(regexp_replace(rtrim(t, '.;,'), '\\s+', '', 'g'), '^\\+', '')) AS {out} FROM {table}_3)"
    )


def _number(table: str, column: str, out: str) -> str:
    """As _normal(), for the numeric form."""
    first = f"{table}_0 AS (SELECT *, coalesce(regexp_extract_all({column}, {_BOX}, 1)[1], {column}) AS u FROM {{source}})"
    units = r"regexp_replace(translate(_w, '$€£¥', ''), '(?i)\s*(dollars?|usd|cents?|pounds?|kg|kgs|km|m|ft|feet|inches|meters|degrees?|hours?|minutes?|seconds?|days?|years?|months?|%)\s*$', '')"
    commas = r"regexp_replace(regexp_replace({t}, '(\d),(\d{3})\b', '\1\2', 'g'), '(\d),(\d{3})\b', '\1\2', 'g')".replace("{t}", units)
    return f"{first}, {_normal(table + '_n', 'u', '_w').replace('{source}', table + '_0')}, {table} AS (SELECT * EXCLUDE (u, _w), rtrim({commas}, '.;,') AS {out} FROM {table}_n)"


def _chain(source: str, *parts: str) -> str:
    """Each part reads what the one before made."""
    out = []
    for part in parts:
        out.append(part.replace("{source}", source))
        source = part.rsplit(" AS (SELECT", 1)[0].rsplit(" ", 1)[-1].split(",")[-1].strip()
    return "WITH " + ", ".join(out)


def _float(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '^[+-]?(\d[\d_]*\.?\d*|\.\d+)(e[+-]?\d+)?$') THEN try_cast(replace({x}, '_', '') AS DOUBLE) END"


def _int(x: str) -> str:
    return rf"CASE WHEN regexp_matches({_strip(x)}, '^[+-]?\d+$') AND try_cast({_strip(x)} AS INT) BETWEEN 0 AND 999 THEN try_cast({_strip(x)} AS INT) END"


_BOTH = (_normal("na", "value", "na"), _normal("nb", "gold", "nb"), _number("fa", "value", "fa"), _number("fb", "gold", "fb"))
_SAME = f"""CASE WHEN na = nb AND na <> '' THEN true WHEN kind IN ('numeric', 'integer_0_999') AND coalesce(abs(({_float('fa')}) - ({_float('fb')})) < 1e-6, false) THEN true
    WHEN kind = 'integer_0_999' AND ({_int('value')}) IS NOT NULL AND ({_int('gold')}) IS NOT NULL THEN ({_int('value')}) = ({_int('gold')}) ELSE coalesce(({_float('na')}) = ({_float('nb')}), false) END"""


@query("f01_extract_answer", f"{_chain('v_responses', _FOUND)} SELECT doc_id, value FROM f2")
def f01(spark, d):
    return V.responses(spark, d).select("doc_id", N.extract(F.col("response"))["value"].alias("value"))


@query("f01_methods", f"{_chain('v_responses', _FOUND)} SELECT method, count(*) AS n FROM f2 GROUP BY method")
def f01_methods(spark, d):
    return V.responses(spark, d).select(N.extract(F.col("response"))["method"].alias("method")).groupBy("method").agg(F.count("*").alias("n"))


@query("f01_claims", f"{_chain('v_claims', _FOUND)} SELECT doc_id, value, method FROM f2")
def f01_claims(spark, d):
    return V.claims(spark, d).select("doc_id", N.extract(F.col("response")).alias("a")).select("doc_id", "a.value", "a.method")


@query("f03_normal_forms", f"{_chain('v_claims', _FOUND, _normal('na', 'value', 'x'), _normal('nb', 'gold', 'y'))} SELECT doc_id, x, y FROM nb")
def f03(spark, d):
    r = V.claims(spark, d).select("doc_id", "gold", N.extract(F.col("response"))["value"].alias("value"))
    return r.select("doc_id", N.normalize(F.col("value")).alias("x"), N.normalize(F.col("gold")).alias("y"))


@query("f04_number_forms", f"{_chain('v_claims', _FOUND, _number('fa', 'value', 'x'), _number('fb', 'gold', 'y'))} SELECT doc_id, x, y, {_float('x')} AS fx, {_int('value')} AS ix FROM fb")
def f04_f05(spark, d):
    r = V.claims(spark, d).select("doc_id", "gold", N.extract(F.col("response"))["value"].alias("value"))
    x, y = N.normalize_number(F.col("value")), N.normalize_number(F.col("gold"))
    return r.select("doc_id", x.alias("x"), y.alias("y"), N.as_float(x).alias("fx"), N.as_int(F.col("value")).alias("ix"))


@query("f06_equivalent", f"{_chain('(SELECT *, chr(0) AS kind FROM v_responses)', _FOUND, *_BOTH)} SELECT doc_id, {_SAME} AS correct FROM fb")
def f06(spark, d):
    return V.responses(spark, d).select("doc_id", N.score_response(F.col("response"), F.col("gold"))["correct"].cast("boolean").alias("correct"))


@query("f08_scored_responses", f"""{_chain('v_claims', _FOUND, *_BOTH)} SELECT doc_id, value AS extracted_answer, method AS extraction_method, method = 'none' AS extraction_failure,
    CASE WHEN value <> '' AND {_SAME} THEN 1 ELSE 0 END AS correct, na AS normalized_extracted, nb AS normalized_gold FROM fb""")
def f08(spark, d):
    return V.claims(spark, d).select("doc_id", N.score_response(F.col("response"), F.col("gold"), F.col("kind")).alias("s")).select("doc_id", "s.*")


# The rule's replacements, one after the other.
_DAPO = ["split_part({t}, '=', -1)", *[f"replace({{t}}, {_q(a)}, {_q(b)})" for a, b in (*N.SUBSTITUTED, *((r, "") for r in N.REMOVED))]]
_DAPO += [r"regexp_replace({t}, '(.*?)(\$)(.*?)(\$)(.*)', '$\3$', 'g')", *[rf"regexp_replace({{t}}, '{p}', '\2', 'g')" for p in (r"(\\text\{)(.*?)(\})", r"(\\textbf\{)(.*?)(\})", r"(\\overline\{)(.*?)(\})", r"(\\boxed\{)(.*)(\})")]]
_DAPO += [r"regexp_replace({t}, '(frac)([^{])(.)', 'frac{\2}{\3}', 'g')", r"regexp_replace({t}, '(sqrt)([^{])', 'sqrt{\2}', 'g')", "replace({t}, '$', '')"]


def _dapo(x: str) -> str:
    bare = "replace(t, ',', '')"
    return f"(SELECT {_strip(f'CASE WHEN regexp_full_match({bare}, {_q("[0-9]+")}) THEN {bare} ELSE t END')} FROM (SELECT {_macro(x, _DAPO)} AS t))"


_ANSWER = r"coalesce(regexp_extract_all(right(response, 300), '(?i)Answer\s*:\s*([^\n]+)', 1)[-1], '[INVALID]')"


def _dapo_query(view: str) -> str:
    return f"SELECT doc_id, CASE WHEN pred = {_dapo('gold')} THEN 1.0::DOUBLE ELSE -1 END AS score, pred FROM (SELECT doc_id, gold, {_dapo('a')} AS pred FROM (SELECT *, {_ANSWER} AS a FROM {view}))"


@query("f09_dapo_score", _dapo_query("v_responses"))
def f09(spark, d):
    s = N.dapo_score(F.col("response"), F.col("gold"))
    return V.responses(spark, d).select("doc_id", s["score"].alias("score"), s["pred"].alias("pred"))


@query("f09_dapo_claims", _dapo_query("v_claims"))
def f09_claims(spark, d):
    s = N.dapo_score(F.col("response"), F.col("gold"))
    return V.claims(spark, d).select("doc_id", s["score"].alias("score"), s["pred"].alias("pred"))


@query("x13_boxed_score", _dapo_query("v_claims").replace(_ANSWER, r"coalesce(regexp_extract_all(right(response, 300), '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1)[-1], '[INVALID]')"))
def x13(spark, d):
    s = S.boxed_score(F.col("response"), F.col("gold"))
    return V.claims(spark, d).select("doc_id", s["score"].alias("score"), s["pred"].alias("pred"))


def _formulas(spark, d, forms):
    """Pairs of formulas built from the numbers of each line; s is 1 where they differ."""
    q, n, k, s = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int"), (F.col("l_suppkey") % 7 + 1).cast("int"), (F.col("l_suppkey") % 2).cast("int")
    lines = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), n.alias("n"), k.alias("k"), s.alias("s"), (F.col("l_partkey") % len(forms)).alias("form"))
    a, b = (F.element_at(F.array(*[F.format_string(f[i][0], *[F.expr(x) for x in f[i][1]]) for f in forms]), (F.col("form") + 1).cast("int")) for i in (0, 1))
    return lines.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))


_EQUATIONS = (
    ((r"\frac{%d}{%d}", ("q*k", "n*k")), ("%d/%d", ("q", "n+s"))), ((r"\sqrt{%d}", ("q*q*n",)), (r"%d\sqrt{%d}", ("q", "n+s"))), (("(x+%d)**2", ("q",)), ("x**2+%d*x+%d", ("2*q", "q*q+s"))),
    ((r"\frac{%d}{%d}", ("q", "4+s")), ("0.25*%d", ("q",))), ((r"%d^{2 \cdot %d}", ("n", "k")), ("(%d*%d)**%d+%d", ("n", "n", "k", "s"))),
)
_SHAPES = (
    (("[%d, %d)", ("q", "n")), ("Interval.%s(%d, %d.0)", ("if(s=0, 'Ropen', 'open')", "q", "n"))), ((r"\{%d, %d\}", ("q", "n+50")), ("{%d, %d}", ("n+50+s*60", "q"))),
    ((r"\begin{pmatrix}%d & %d\\ %d & 1\end{pmatrix}", ("q", "n", "k")), ("Matrix([[%d, %d], [%d, %d]])", ("q", "n", "k", "1+s"))), (("%d%%", ("q",)), ("%.2f", ("CAST((q+s*60)/100 AS DOUBLE)",))),
    ((r"\left(\frac{%d}{2}, %d\right)", ("q", "n")), ("(0.5*%d, %d)", ("q", "n+s"))),
)


@query("f07_symbolic", "SELECT l_orderkey, l_linenumber, l_suppkey % 2 = 0 AS same FROM lineitem")
def f07_d12(spark, d):
    """Formulas that differ in text throughout; the SQL knows from the numbers they are made of which are the same."""
    pairs = _formulas(spark, d, _EQUATIONS)
    return A.compare(pairs, "a", "b", N.decided(F.col("a"), F.col("b")), "same").select("l_orderkey", "l_linenumber", "same")


@query("f16_graded", "SELECT l_orderkey, l_linenumber, l_suppkey % 2 = 0 AS right FROM lineitem")
def f16(spark, d):
    pairs = _formulas(spark, d, _SHAPES)
    return A.compare(pairs, "a", "b", F.when(F.col("a") == F.col("b"), True), "right", A.graded).select("l_orderkey", "l_linenumber", "right")


@query("f08_symbolic_claims")
def f08_f06_f07(spark, d):
    """Claims scored with all legs: text, numbers and, where these leave it open, algebra."""
    r = V.claims(spark, d).select("doc_id", "gold", "kind", N.extract(F.col("response")).alias("a")).select("doc_id", "gold", "kind", F.nullif("a.value", F.lit("")).alias("value"))
    return A.compare(r, "value", "gold", N.decided(F.col("value"), F.col("gold"), F.col("kind")), "correct").select("doc_id", "value", "correct")
