"""Queries on openings of responses, bypassed reasoning and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import openings as O
from tallyloom.functions import texts as X
from tallyloom.sources import views as V

from .registry import query

#: What responses begin with here.
_BEGINNINGS = (
    "Step 1: ", " First, we see ", "\n Let me think. ", "Let me solve ", "We were there. ", "We have ", "First of all ", "Okay so ", "OKAY, ", "so, ", "So the answer is ", "the answer is ", "Answer is ", "Final Answer: ", "\\boxed{4} ", " boxed{4}", "-3.5 ", "$7$ ", "12x ",
    "[placeholder] ", "see [ PLACEHOLDER ] ", "[note] ", "Some [note] here ", "[a-b c] ", "Given that ", "given that ", "Recall ", "RECALL ", "I'll solve ", "Note that ", "noted: ", "", "Hence the answer ", "let's set ", "Let's set ", "Suppose ",
)
_N = len(_BEGINNINGS)
_OPENED = f"""(SELECT doc_id, source AS prompt_id, [{', '.join("'" + b.replace("'", "''") + "'" for b in _BEGINNINGS)}][doc_id % {_N} + 1] || left(text, 250 + doc_id % 97) AS response,
    'Use ''' || coalesce(split_part(text, ' ', 1), '') || ''' and "' || coalesce(split_part(text, ' ', 2), '') || '" please' AS prompt,
    CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ['detectable_content:number_placeholders'] WHEN 2 THEN ['keywords:existence'] WHEN 3 THEN ['length:words', 'keywords:existence', 'x:placeholder'] ELSE [] END AS ids, doc_id % 7 <> 0 AS enabled FROM documents)"""


def _opened(spark, d):
    k, i = F.col("doc_id") % _N + 1, F.col("doc_id") % 5
    word = lambda n: F.coalesce(F.split_part("text", F.lit(" "), F.lit(n)), F.lit(""))
    ids = F.when(i == 1, F.array(F.lit("detectable_content:number_placeholders"))).when(i == 2, F.array(F.lit("keywords:existence"))).when(i == 3, F.array(F.lit("length:words"), F.lit("keywords:existence"), F.lit("x:placeholder"))).when(i == 4, F.array().cast("array<string>"))
    response = F.concat(F.element_at(F.array(*[F.lit(b) for b in _BEGINNINGS]), k.cast("int")), F.left("text", F.lit(250) + F.col("doc_id") % 97))
    return V.table(spark, d, "documents").select("doc_id", F.col("source").alias("prompt_id"), response.alias("response"), F.concat(F.lit("Use '"), word(1), F.lit("' and \""), word(2), F.lit('" please')).alias("prompt"), ids.alias("ids"), (F.col("doc_id") % 7 != 0).alias("enabled"))


def _any(x: str, openings: tuple[str, ...]) -> str:
    return "list_bool_or([" + ", ".join(f"starts_with({x}, '" + o.replace("'", "''") + "')" for o in openings) + "])"


_HEAD = r"left(regexp_replace(response, '^\s+', ''), 80)"
_SURFACE = rf"""coalesce((len(list_filter(coalesce(ids, []), lambda i: contains(i, 'placeholder'))) > 0 AND (regexp_matches({_HEAD}, '(?i)\[\s*placeholder\s*\]') OR regexp_matches({_HEAD}, '^\[[a-zA-Z][a-zA-Z\s_-]{{1,30}}\]')))
    OR (len(list_filter(coalesce(ids, []), lambda i: contains(i, 'keywords'))) > 0 AND len(response) <= 300 AND len(list_filter(regexp_extract_all(prompt, '[''"]([A-Za-z][\p{{L}}\p{{N}}_\s-]{{1,40}}?)[''"]', 1), lambda k: contains(lower({_HEAD}), lower(k)))) >= 2), false)"""
_MODE = rf"""SELECT *, CASE WHEN enabled AND prompt IS NOT NULL AND len(ids) > 0 AND surface THEN 'CSI' WHEN {_any('s', O.DIRECT)} OR regexp_matches(s, '^\s*\\?boxed\{{|^\s*\$?-?\d+(\.\d+)?[\s\.\,\$]|^\s*\\boxed\s*\{{') THEN 'DAI' WHEN {_any('s', O.DELIBERATE)} THEN 'DRI'
    WHEN {_any('lower(s)', O.DIRECT_LOWER)} THEN 'DAI' WHEN {_any('lower(s)', O.DELIBERATE_LOWER)} THEN 'DRI' ELSE 'Other' END AS mode FROM (SELECT *, {_SURFACE} AS surface, regexp_replace(response, '^\s+', '') AS s FROM {_OPENED})"""


def _modes(spark, d):
    r, p, i = F.col("response"), F.col("prompt"), F.col("ids")
    return _opened(spark, d).select("doc_id", "prompt_id", O.opening_mode(r, p, i, F.col("enabled")).alias("mode"), O.dumps_surface(r, p, i).alias("surface"))


@query("f31_opening_modes", f"SELECT prompt_id, round(avg((mode = 'DRI')::INT), 6) AS dri, round(avg((mode = 'DAI')::INT), 6) AS dai, round(avg((mode = 'CSI')::INT), 6) AS csi FROM ({_MODE}) GROUP BY prompt_id")
def f31_p16(spark, d):
    return _modes(spark, d).groupBy("prompt_id").agg(*[F.avg((F.col("mode") == k).cast("double")).alias(k.lower()) for k in ("DRI", "DAI", "CSI")])


@query("f31_modes", f"SELECT doc_id, mode FROM ({_MODE})")
def f31(spark, d):
    return _modes(spark, d).select("doc_id", "mode")


@query("f32_surface", f"SELECT doc_id, surface FROM ({_MODE})")
def f32(spark, d):
    return _modes(spark, d).select("doc_id", "surface")


_TRACE = r"""SELECT doc_id, doc_id % 2 = 0 AS tagged, CASE doc_id % 3 WHEN 0 THEN left(text, 120) WHEN 1 THEN text || ' Consider this.' ELSE text END AS t FROM documents"""


@query("f42_bypass", rf"""SELECT doc_id, tagged AND (n < 30 OR NOT r) AS bypass_reasoning, n AS reasoning_word_count, length(t) AS reasoning_char_count, r AS has_reasoning_markers FROM (
    SELECT *, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) AS n, regexp_matches(t, '(?i)(^|[^\p{{L}}\p{{N}}_])(step|first|second|third|then|next|therefore|thus|so|hence|because|consider|let|let''s|compute|simplify|substitute)($|[^\p{{L}}\p{{N}}_])') AS r FROM ({_TRACE}))""")
def f42(spark, d):
    k, text = F.col("doc_id") % 3, F.col("text")
    said = F.concat(F.when(k == 0, F.left(text, F.lit(120))).when(k == 1, F.concat(text, F.lit(" Consider this."))).otherwise(text), F.when(F.col("doc_id") % 2 == 0, F.lit("<answer>4</answer>")).otherwise(""))
    trace, _ = X.split_answer(said)
    return V.table(spark, d, "documents").select("doc_id", O.bypass(trace, said.contains("<answer>")).alias("b")).select("doc_id", "b.*")


@query("f45_segments")
def f45(spark, d):
    """Whole documents; held against plain Python in the tests, as SQL engines here have no look-ahead."""
    return V.table(spark, d, "documents").select("doc_id", O.segments(F.col("text")).alias("segments"))
