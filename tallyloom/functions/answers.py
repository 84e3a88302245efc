"""Answers: finding them in responses, bringing them to a normal form, comparing and scoring them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import let

NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
#: Possessive, so that long boxes need no deep stack; braces inside may nest once.
BOXED = r"\\boxed\s*\{((?:[^{}]++|\{[^{}]*+\})*+)\}"
# How answers are announced, fragments and numbers that stand for one, units that may follow a number.
ANSWER_LINE = r"^\s*Answer\s*:\s*(.+?)\s*$"
ANNOUNCED = r"\b(?:the\s+answer\s+is|final\s+answer\s*[:\-]?)\s*([\-+]?\s*[\d\\{][^\n\r]{0,120})"
FRAGMENT = r"\\frac\s*\{[^{}]*\}\s*\{[^{}]*\}|\\sqrt\s*\{[^{}]*\}|\\boxed\s*\{[^{}]*\}"
PLAIN_NUMBER = r"-?\d+(?:\.\d+)?(?:/\d+)?"
UNITS = r"dollars?|usd|cents?|pounds?|kg|kgs|km|m|ft|feet|inches|meters|degrees?|hours?|minutes?|seconds?|days?|years?|months?|%"
RENAMED = (("\\!", ""), ("\\;", ""), ("\\,", ""), ("\\$", "$"), ("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"), ("\\cdot", "*"), ("\\times", "*"))
# What the competition scorer replaces and removes, in this order.
SUBSTITUTED = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}",
    "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
INVALID = "[INVALID]"


def last(x: Column, pattern: str, group: int = 1) -> Column:
    """The last match's group; null without a match."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), group), F.lit(-1))


def strip(x: Column, marks: str = r"\s") -> Column:
    """Without white space (or other marks) at either end."""
    return F.regexp_replace(x, rf"(?U)^[{marks}]+|[{marks}]+\z", "")


def extract(x: Column) -> Column:
    """Struct of the answer and how it was found: boxed, answer_line, the_answer_is, last_latex, last_number or none.

    The last box, which may be empty, goes before the last answer line and that before the last announcement; the
    other two look at the final 400 characters. A null or empty text has no answer. A way is tried only if those
    before it find nothing.
    """
    tail = F.right(x, F.lit(400))
    unpointed = lambda c: F.regexp_replace(strip(c), r"\.+\z", "")
    ways = (
        ("boxed", F.contains(x, F.lit("\\boxed")), last(x, f"(?U){BOXED}"), strip),
        ("answer_line", F.contains(x, F.lit(":")), last(x, f"(?idmuU){ANSWER_LINE}"), unpointed),
        ("the_answer_is", F.lit(True), last(x, f"(?iuU){ANNOUNCED}"), unpointed),
        ("last_latex", F.contains(tail, F.lit("\\")), last(tail, f"(?U){FRAGMENT}", 0), lambda c: strip(strip(c, "$"))),
        ("last_number", F.lit(True), last(tail, f"(?U){PLAIN_NUMBER}", 0), lambda c: c),
    )

    def first_of(rest: tuple) -> Column:
        if not rest:
            return F.struct(F.lit("").alias("value"), F.lit("none").alias("method"))
        name, possible, found, clean = rest[0]
        return let(F.when(possible, found), lambda f: F.when(f.isNotNull(), F.struct(clean(f).alias("value"), F.lit(name).alias("method"))).otherwise(first_of(rest[1:])))

    return first_of(ways)


def undecorated(x: Column) -> Column:
    """LaTeX without sizes, text boxes and thin spaces; signs for products and per cent are plain."""
    t = F.regexp_replace(F.regexp_replace(x, r"(?U)\\left\s*", ""), r"(?U)\\right\s*", "")
    for box in ("text", "mbox"):
        t = F.regexp_replace(t, rf"(?U)\\{box}\s*\{{([^{{}}]*)\}}", "$1")
    t = F.replace(F.replace(t, F.lit("\\$"), F.lit("$")), F.lit("\\%"), F.lit("%"))
    for a, b in RENAMED:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def normalize(x: Column) -> Column:
    """Lower case without decoration, one pair of outer braces and dollars, marks at the end, white space, a leading plus; null is empty."""
    t = F.regexp_replace(undecorated(strip(F.coalesce(x, F.lit("")))), r"(?sU)^\{\s*(.*?)\s*\}\z", "$1")
    t = F.regexp_replace(t, r"(?sU)^\$(?:\s*(.*?)\s*\$)?\z", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"[.;,]+\z", ""), r"(?U)\s+", "")
    return F.lower(F.regexp_replace(t, r"^\+", ""))


def normalize_number(x: Column) -> Column:
    """The normal form of the first box, or of all, without currency, one unit at the end and thousands commas."""
    t = normalize(F.when(F.contains(x, F.lit("\\boxed")), F.coalesce(F.try_element_at(F.regexp_extract_all(x, F.lit(f"(?U){BOXED}"), 1), F.lit(1)), x)).otherwise(x))
    t = F.regexp_replace(F.regexp_replace(t, "[$€£¥]", ""), rf"(?iuU)\s*({UNITS})\s*\z", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)(?<=\d),(?=\d{3}\b)", ""), r"[.;,]+\z", "")


def as_float(x: Column) -> Column:
    """What is written as a decimal number (1_000, 1e5 and inf are), else null."""
    digits = r"\d+(?:_\d+)*"
    well = x.rlike(rf"(?i)^[+-]?(?:(?:{digits}\.?(?:{digits})?|\.{digits})(?:e[+-]?{digits})?|inf|infinity)\z")
    return F.when(well, F.replace(x, F.lit("_"), F.lit("")).try_cast("double"))


def as_int(x: Column, low: int = 0, high: int = 999) -> Column:
    """What is written as a whole number from low to high, else null."""
    t = strip(x)
    n = F.when(t.rlike(r"^[+-]?\d+(?:_\d+)*\z"), F.replace(t, F.lit("_"), F.lit("")).try_cast("decimal(38,0)"))
    return F.when(n.between(low, high), n.cast("int"))


def decided(a: Column, b: Column, kind: Column | None = None) -> Column:
    """Whether two answers are the same as far as text and numbers tell; null where only algebra could.

    kind is numeric, integer_0_999 or anything else. Equal normal forms are the same; numbers of the first two kinds
    within a millionth; two whole numbers of the second kind only if equal; otherwise normal forms that are equal
    numbers. A null is never the same as anything.
    """
    kind = F.coalesce(kind, F.lit("")) if kind is not None else F.lit("")
    forms = F.struct(*[F.struct(normalize(x).alias("text"), let(normalize_number(x), lambda n: as_float(n)).alias("number"), as_int(x).alias("whole")).alias(k) for k, x in (("a", a), ("b", b))])

    def compared(f: Column) -> Column:
        x, y = f["a"], f["b"]
        close = (x["number"] == y["number"]) | (F.abs(x["number"] - y["number"]) < 1e-6)
        return (
            F.when((x["text"] == y["text"]) & (x["text"] != ""), True).when(kind.isin("numeric", "integer_0_999") & F.coalesce(close, F.lit(False)), True)
            .when((kind == "integer_0_999") & x["whole"].isNotNull() & y["whole"].isNotNull(), x["whole"] == y["whole"])
            .when(F.coalesce(as_float(x["text"]) == as_float(y["text"]), F.lit(False)), True)
        )

    return F.when(a.isNull() | b.isNull(), False).otherwise(let(forms, compared))


def equivalent(a: Column, b: Column, kind: Column | None = None) -> Column:
    """decided(), with what is left open taken as different."""
    return F.coalesce(decided(a, b, kind), F.lit(False))


def score_response(x: Column, gold: Column, kind: Column | None = None) -> Column:
    """The six fields of a scored response, its extracted answer being compared with gold as by equivalent()."""

    def fields(found: Column) -> Column:
        right = (found["value"] != "") & equivalent(found["value"], gold, kind)
        return F.struct(
            found["value"].alias("extracted_answer"), found["method"].alias("extraction_method"), (found["method"] == "none").alias("extraction_failure"),
            F.when(right, 1).otherwise(0).alias("correct"), normalize(found["value"]).alias("normalized_extracted"), normalize(gold).alias("normalized_gold"),
        )

    return let(extract(x), fields)


def dapo_normalize(x: Column) -> Column:
    """The competition scorer's normal form: what follows the last =, without units, boxes and dollars, short fractions and roots spelled out."""
    t = F.substring_index(x, "=", -1)
    for a, b in (*SUBSTITUTED, *((r, "") for r in REMOVED)):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"(?d).*?\$(.*?)\$.*", r"\$$1\$")
    for box in (r"\\text\{(.*?)\}", r"\\textbf\{(.*?)\}", r"\\overline\{(.*?)\}", r"\\boxed\{(.*)\}"):
        t = F.regexp_replace(t, f"(?d){box}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"(?d)frac([^{])(.)", "frac{$1}{$2}"), r"sqrt([^{])", "sqrt{$1}")
    t = F.replace(t, F.lit("$"), F.lit(""))
    return strip(let(t, lambda t: F.when(t.rlike(r"(?U)^,*\d[\d,]*\z"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)))


def scored(pred: Column, gold: Column) -> Column:
    return let(pred, lambda p: F.struct(F.when(p == gold, 1.0).otherwise(-1.0).alias("score"), F.coalesce(p == gold, F.lit(False)).alias("acc"), p.alias("pred")))


def dapo_score(x: Column, gold: Column) -> Column:
    """Struct of score (1 or -1), acc and pred from the last answer line of the final 300 characters."""
    found = last(F.right(x, F.lit(300)), r"(?iuU)Answer\s*:\s*([^\n]+)")
    return scored(dapo_normalize(F.coalesce(found, F.lit(INVALID))), dapo_normalize(gold))


def gsm8k_score(x: Column, gold: Column, *, strict: bool = True, format_score: float = 0.0) -> Column:
    """1 for the gold number after the last #### (or, if not strict, the last number), else what a well-formed answer is worth."""
    tail = F.right(x, F.lit(300))
    found = last(tail, r"#### (-?[0-9.,]+)") if strict else last(tail, f"({NUMBER})")
    clean = F.replace(F.replace(found, F.lit(","), F.lit("")), F.lit("$"), F.lit(""))
    return F.when(clean.isNull(), 0.0).when(clean == gold, 1.0).otherwise(format_score)


def qa_normalize(x: Column) -> Column:
    """Lower case, without punctuation and articles, single blanks."""
    t = F.regexp_replace(F.lower(x), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(a|an|the)\b", " "), r"\s+", " "))


def qa_match(x: Column, golds: Column, *, within: bool = False) -> Column:
    """Whether the last answer tag equals (or holds) one of the golds."""
    said = qa_normalize(F.coalesce(last(x, "(?s)<answer>(.*?)</answer>"), F.lit("")))
    return F.exists(golds, lambda g: said.contains(qa_normalize(g)) if within else said == qa_normalize(g))


def choice(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1), F.lit(""))


def accuracy(acc: Column, score: Column, instruction: Column) -> Column:
    """A missing flag is a score of 1 or more where instructions are checked, else false."""
    return F.coalesce(acc, instruction & (score >= 1), F.lit(False))
