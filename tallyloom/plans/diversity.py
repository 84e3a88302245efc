"""Queries on how alike the texts of a group are."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import diversity as D
from tallyloom.sources import views as V

from .registry import query

_TOKENS = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(\P{N})(\p{P})', '\1 \2 ', 'g'), '(\p{P})(\P{N})', ' \1 \2', 'g'), '(\p{S})', ' \1 ', 'g'), '[\s\p{Z}]+'), lambda x: x <> '')"""
#: By its definition: every row is held against every other row of its group.
_BLEU = f"""WITH k AS (SELECT conv_id AS g, turn AS r, {_TOKENS} AS t FROM conversations),
    o AS (SELECT unnest([1, 2, 3, 4]) AS n),
    c AS (SELECT g, r, n, gram, count(*) AS c FROM (SELECT g, r, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS gram FROM k, o) GROUP BY ALL),
    m AS (SELECT a.g, a.r, a.n, a.gram, any_value(a.c) AS c, coalesce(max(b.c), 0) AS best FROM c a LEFT JOIN c b ON a.g = b.g AND a.n = b.n AND a.gram = b.gram AND a.r <> b.r GROUP BY a.g, a.r, a.n, a.gram),
    s AS (SELECT g, r, n, sum(least(c, best)) AS hit, sum(c) AS total FROM m GROUP BY g, r, n),
    p AS (SELECT *, sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g, r ORDER BY n) AS h FROM s),
    l AS (SELECT a.g, a.r, len(any_value(a.t)) AS size, min(struct_pack(d := abs(len(a.t) - len(b.t)), l := len(b.t))).l AS ref FROM k a JOIN k b ON a.g = b.g AND a.r <> b.r GROUP BY a.g, a.r),
    f AS (SELECT l.g, l.r, CASE WHEN size = 0 OR coalesce(max(hit), 0) = 0 THEN 0 ELSE exp(least(0, 1 - ref::DOUBLE / size)) * exp(avg(ln((CASE WHEN hit = 0 THEN 0.5 ** h ELSE hit END)::DOUBLE / total))) END AS bleu
        FROM l LEFT JOIN p ON l.g = p.g AND l.r = p.r GROUP BY l.g, l.r, size, ref)"""


@query("f28_self_bleu", f"{_BLEU} SELECT k.g AS conv_id, count(*) AS n, round(avg(bleu), 6) AS self_bleu FROM k LEFT JOIN f ON k.g = f.g AND k.r = f.r GROUP BY k.g")
def f28(spark, d):
    return D.self_bleu(V.table(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query("f28_sentence_bleu", f"{_BLEU} SELECT k.g AS conv_id, k.r AS turn, round(bleu, 6) AS bleu FROM k LEFT JOIN f ON k.g = f.g AND k.r = f.r")
def f28_rows(spark, d):
    return D.sentence_scores(V.table(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query("f28_prompt_bleu")
def f28_prompts(spark, d):
    """All responses of a prompt against each other; groups here are hundreds of rows and one of them holds many more."""
    return D.self_bleu(V.responses(spark, d).select("prompt_id", F.col("doc_id"), "response"), ["prompt_id"], "doc_id", "response")
