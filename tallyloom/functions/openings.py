"""How responses begin, and whether they reason before they answer."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import let

# Openings of deliberation, with case and in lower case, and of answers.
DELIBERATE = (
    "Step 1:", "Step 1.", "Step 1 ", "Step1:", "Step1.",
    "To solve", "To find", "To compute", "To determine",
    "First,", "First we ", "First, we", "First let",
    "We first", "We need", "We are asked", "We have", "We want",
    "I'll solve", "I will solve", "I need to",
    "Let's solve", "Let's break", "Let's tackle", "Let's compute",
    "Let's find", "Let's denote", "Let's compute", "Let's see",
    "Let us solve", "Let us break", "Let us tackle", "Let us denote",
    "Let me solve", "Let me find",
    "Alright,", "Okay,", "OK,", "Right,",
    "Alright ", "Okay ", "OK ",
    "So,", "So ", "Now,", "Now ",
    "Given ", "Given,", "Suppose", "Consider", "Define",
    "Note that", "Recall", "Observe",
)
DELIBERATE_LOWER = (
    "to solve", "to find", "to compute", "to determine",
    "let's solve", "let's break", "let's tackle", "let's compute",
    "let's denote", "let's set", "let's find", "let's see",
    "let us solve", "let us break", "let us tackle", "let us denote",
    "we need to", "we have to", "we want to", "we are asked", "we first",
    "first,", "first we ", "first, we",
    "i'll solve", "i will solve", "i need to",
    "step 1:", "step 1.", "step1:", "step1.",
    "alright,", "alright ", "okay,", "okay ", "ok,",
    "so,", "now,", "given ", "suppose", "consider", "define",
    "note that", "recall", "observe",
)
DIRECT = (
    "Answer:",
    "Final answer:", "Final Answer:",
    "The answer is", "The final answer is",
    "Therefore, the answer", "Therefore the answer",
    "Thus, the answer", "Thus the answer",
    "So, the answer", "So the answer",
    "Hence, the answer", "Hence the answer",
    "ANSWER:",
)
DIRECT_LOWER = (*(s.lower() for s in DIRECT), "answer is")
BARE = r"^\s*\\?boxed\{|^\s*\$?-?\d+(\.\d+)?[\s\.\,\$]|^\s*\\boxed\s*\{"
REASONING = r"\b(step|first|second|third|then|next|therefore|thus|so|hence|because|consider|let|let's|compute|simplify|substitute)\b"
QUOTED = r"""['"]([A-Za-z][\w\s-]{1,40}?)['"]"""


def begins(x: Column, openings: tuple[str, ...]) -> Column:
    return x.rlike("^(?:" + "|".join(re.escape(o) for o in openings) + ")")


def dumps_surface(response: Column, prompt: Column, ids: Column) -> Column:
    """Whether a response begins with what a checker looks for.

    With a placeholder among the instruction ids: `[placeholder]` in the first 80 characters, or a word in brackets at
    their start. With keywords among them: two or more of the prompt's quoted words there, in a response of at most
    300 characters. A null response, prompt or list has none.
    """
    has = lambda part: F.exists(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.coalesce(i.contains(part), F.lit(False)))
    text = F.coalesce(response, F.lit(""))

    def looked(head: Column) -> Column:
        placeholder = head.rlike(r"(?iuU)\[\s*placeholder\s*\]") | head.rlike(r"(?U)^\[[a-zA-Z][a-zA-Z\s_-]{1,30}\]")
        low = F.lower(head)
        words = F.filter(F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(f"(?U){QUOTED}"), 1), lambda k: low.contains(F.lower(k)))
        return (has("placeholder") & placeholder) | (has("keywords") & (F.size(words) >= 2) & (F.length(text) <= 300))

    return let(F.left(F.regexp_replace(text, r"(?U)^\s+", ""), F.lit(80)), looked)


def opening_mode(response: Column, prompt: Column | None = None, ids: Column | None = None, enabled: Column | bool = False) -> Column:
    """CSI, DAI (answers at once), DRI (deliberates) or Other.

    CSI is looked for only where it is enabled and there are a prompt and ids; it goes first. Then openings of answers
    with their case, bare numbers and boxes, openings of deliberation, and both again in lower case. A null response is Other.
    """
    surface = F.lit(False)
    if prompt is not None and ids is not None:
        on = enabled if isinstance(enabled, Column) else F.lit(enabled)
        surface = F.coalesce(on, F.lit(False)) & prompt.isNotNull() & F.coalesce(F.size(ids) > 0, F.lit(False)) & dumps_surface(response, prompt, ids)

    def told(s: Column) -> Column:
        low = F.lower(s)
        return (
            F.when(surface, "CSI").when(begins(s, DIRECT) | s.rlike(f"(?U){BARE}"), "DAI").when(begins(s, DELIBERATE), "DRI")
            .when(begins(low, DIRECT_LOWER), "DAI").when(begins(low, DELIBERATE_LOWER), "DRI").otherwise("Other")
        )

    return let(F.regexp_replace(F.coalesce(response, F.lit("")), r"(?U)^\s+", ""), told)


def bypass(trace: Column, tagged: Column) -> Column:
    """Struct of whether reasoning was bypassed and on what grounds: a tagged answer after fewer than 30 words, or without a word of reasoning."""
    t = F.coalesce(trace, F.lit(""))
    n, reasons = F.regexp_count(t, F.lit(r"(?U)\b\w+\b")), t.rlike(f"(?iuU){REASONING}")
    return F.struct(
        (tagged & ((n < 30) | ~reasons)).alias("bypass_reasoning"), n.cast("long").alias("reasoning_word_count"), F.length(t).cast("long").alias("reasoning_char_count"), reasons.alias("has_reasoning_markers"),
    )


def segments(x: Column) -> Column:
    """Steps and numbered items if there are two or more, else paragraphs, else sentences, also of Chinese; trimmed, none of them empty."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    clean = lambda a: F.filter(F.transform(a, bare), lambda s: s != "")

    def cut(t: Column) -> Column:
        steps = clean(F.split(t, r"(?U)(?=\n?\s*(?:Step\s*\d+|\d+[\.)])\s+)"))
        paragraphs = clean(F.split(t, r"(?U)\n\s*\n+"))
        whole = clean(F.split(t, r"(?U)(?<=[.!?。！？])\s+"))
        return let(steps, lambda a: F.when(F.size(a) >= 2, a).otherwise(let(paragraphs, lambda b: F.when(F.size(b) >= 2, b).otherwise(whole))))

    return let(bare(F.coalesce(x, F.lit(""))), cut)
