"""Text measures of responses, as native expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# The families of markers that responses are searched for (a family counts all of its patterns).
MARKERS = {
    "step": (
        r"(?i)\bstep\s*\d+\b", r"(?i)\b(first(?:ly)?|second(?:ly)?|third(?:ly)?|fourth(?:ly)?|finally)\b", r"(?i)\b(therefore|thus|hence|so that|so,)\b",
        r"(?i)\b(we need to|we have to|we should|let me)\b", r"(?i)\b(let's|let us)\b", r"(首先|然后|其次|接着|最后|因此|所以)",
    ),
    "equation": (
        r"\\frac\s*\{", r"\\sqrt\s*\{", r"\\boxed\s*\{", r"[A-Za-z0-9)\]]\s*\^\s*[{A-Za-z0-9(]", r"\d+\s*[+\-*/=×÷]\s*\d+", r"[=≤≥<>]", r"\$[^$]{1,200}\$",
    ),
    "verification": (
        r"(?i)\b(check|checking|verify|verified|substitute|plug back|sanity check|double[- ]?check|re[- ]?check)\b", r"(?i)\b(let's check|let's verify|let us check)\b", r"(验证|检查|代入|回代|复核)",
    ),
    "over_reasoning": (
        r"(?i)\blet's think\b", r"(?i)\bstep by step\b", r"(?i)\bwe need to\b", r"(?i)\b(reasoning|analysis|deliberately)\b", r"(?i)\b(therefore|hence|thus)\b", r"(首先|然后|因此|所以|推理|思考)",
    ),
}

SENTENCE = r"(?<=[.!?])\s+|\n+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being worked out once."""
    return F.transform(F.array(value), body)[0]


_shared: ContextVar[tuple[set[str], dict[tuple[str, str], Column]] | None] = ContextVar("shared", default=None)


@contextmanager
def sharing(*texts: Column) -> Iterator[dict[tuple[str, str], Column]]:
    """While expressions are made: the parts of these texts that are asked for, each once. They stand in columns named by shared_name()."""
    held: dict[tuple[str, str], Column] = {}
    token = _shared.set(({repr(t) for t in texts}, held))
    try:
        yield held
    finally:
        _shared.reset(token)


def shared_name(kind: str, text: str, held: dict[tuple[str, str], Column]) -> str:
    return f"_part_{list(held).index((kind, text))}"


def part(kind: str, x: Column, made: Column) -> Column:
    """A part of a text: a column of its own where it is shared, else the expression."""
    texts, held = _shared.get() or (set(), {})
    if repr(x) not in texts:
        return made
    held.setdefault((kind, repr(x)), made)
    return F.col(shared_name(kind, repr(x), held))


def words(x: Column) -> Column:
    return part("words", x, F.regexp_extract_all(x, F.lit(r"(?U)\b\w+\b"), 0))


def sentences(x: Column) -> Column:
    return part("sentences", x, F.filter(F.transform(F.split(x, SENTENCE), lambda s: F.trim(s, F.lit(" \t\n\r\x0b\x0c"))), lambda s: s != ""))


def pieces(x: Column) -> Column:
    """Parts between white space; none of an empty text."""
    return part("pieces", x, F.array_remove(F.split(x, r"\s+"), ""))


def unpunctuated(x: Column) -> Column:
    """Parts between white space, all ASCII punctuation having been taken out."""
    return part("unpunctuated", x, pieces(unsigned(x)))


def unsigned(x: Column) -> Column:
    """The text without ASCII punctuation."""
    return part("unsigned", x, F.regexp_replace(x, r"\p{Punct}", ""))


def first_sentence(x: Column, most: int = 500) -> Column:
    return F.left(F.trim(F.split(F.trim(x), SENTENCE, 2)[0]), F.lit(most))


def prefix(x: Column, n: int = 8) -> Column:
    return F.array_join(F.slice(pieces(x), 1, n), " ")


def density(count: Column, n: Column) -> Column:
    return count * 100.0 / F.greatest(n, F.lit(1))


def marker_counts(x: Column) -> dict[str, Column]:
    return {k: reduce(add, [F.regexp_count(x, F.lit(p)) for p in own]) for k, own in MARKERS.items()}


def answer_position(x: Column) -> Column:
    """Where the last boxed answer, answer line or else number ends, as a share of the text; null without any."""
    n = F.length(x).cast("double")

    def end(p: str) -> Column:
        return F.nullif(F.length(F.regexp_extract(x, f"(?s)^(.*(?:{p}))", 1)), F.lit(0))

    at = F.coalesce(end(r"\\boxed\{[^{}]*\}"), end(r"(?i)answer\s*:[^\n]*"), end(r"\d"))
    return F.when((n > 0) & at.isNotNull(), F.least(at / n, F.lit(1.0)))


def without_thinking(x: Column) -> Column:
    """What follows the last closing think tag, without answer tags."""
    return F.trim(F.regexp_replace(F.substring_index(F.replace(x, F.lit("<|assistant|>"), F.lit("")), "</think>", -1), "</?answer>", ""))


def split_answer(x: Column) -> tuple[Column, Column]:
    """Reasoning before the first answer tag, and what the tag holds (to the end if it isn't closed)."""
    tagged = x.contains("<answer>")
    return F.when(tagged, F.substring_index(x, "<answer>", 1)).otherwise(x), F.when(tagged, F.regexp_extract(x, "(?s)<answer>(.*?)(?:</answer>|$)", 1)).otherwise("")


def prompt_hash(x: Column) -> Column:
    return F.substring(F.md5(x), 1, 16)


def strip_chat(x: Column) -> Column:
    """A prompt without the chat envelope of system, user and assistant lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)^(system\n.*?\n)?user\n", ""), r"\n?assistant\n?$", ""))


def ngram_list(tokens: Column, n: int) -> Column:
    """All runs of n tokens; these are worked out once, not for each run."""

    def runs(t: Column) -> Column:
        size = F.size(t)
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)
