"""Queries on training datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import texts as X
from tallyloom.sources import datasets as D
from tallyloom.sources import views as V

from .algebra import _pass
from .registry import query

_ROWS = "SELECT text, row_number() OVER () - 1 AS i FROM benchmark UNION ALL SELECT text, row_number() OVER () - 1 + (SELECT count(*) FROM benchmark) FROM documents"
_SHORT = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 300"


def _files(d):
    return [f"{d}/benchmark.parquet", f"{d}/documents.parquet"]


@query("s24_first_rows", f"SELECT i AS ordinal, md5(text) AS text FROM ({_ROWS}) WHERE i < 500 AND {_SHORT}")
def s24(spark, d):
    """The first 500 rows of two tables in the order of their files, then without those of more than 300 pieces."""
    rows = D.scan(spark, _files(d), ["text"], most=500, length=F.size(X.pieces(F.col("text"))), longest=300)
    return rows.select("ordinal", F.md5("text").alias("text"))


@query("s24_drawn_rows", f"""WITH RECURSIVE r AS ({_ROWS}), s AS (SELECT i, i AS x, n, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b, 11::BIGINT AS key FROM (SELECT i, count(*) OVER () AS n FROM r)),
    w AS (({_pass('s', 'x')}) UNION ALL ({_pass('(SELECT * FROM w WHERE x >= n)', 'x')})) SELECT i AS ordinal, md5(text) AS text FROM w JOIN r USING (i) WHERE x < n AND x < 100 AND {_SHORT}""")
def s24_drawn(spark, d):
    rows = D.scan(spark, _files(d), ["text"], most=100, shuffle=True, seed=11, length=F.size(X.pieces(F.col("text"))), longest=300)
    return rows.select("ordinal", F.md5("text").alias("text"))


_IDS = "list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w))"


@query("s26_preference_pairs", f"""WITH p AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS q, max(CASE WHEN turn = 1 THEN text END) AS c, max(CASE WHEN turn = 3 THEN text END) AS r FROM conversations GROUP BY conv_id),
    x AS (SELECT conv_id, k, coalesce({_IDS.format('q')}, []) || coalesce(CASE WHEN k = 0 THEN {_IDS.format('c')} ELSE {_IDS.format('r')} END, []) || [2] AS ids FROM p, (VALUES (0), (1)) v(k))
    SELECT conv_id, k AS row, least(len(ids), 64) AS valid, list_sum(ids[1:64])::BIGINT AS total, CASE WHEN len(ids) >= 64 THEN ids[64] ELSE 0 END AS last FROM x""")
def s26(spark, d):
    """A conversation's first answer against its second one, words standing for tokens by their lengths."""
    turn = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    talks = V.table(spark, d, "conversations").groupBy("conv_id").agg(turn(0).alias("q"), turn(1).alias("c"), turn(3).alias("r"))
    ids = lambda c: F.transform(X.words(F.col(c)), lambda w: F.length(w))
    pairs = D.preference_pairs(talks, ids("q"), ids("c"), ids("r"), 64, end_id=2)
    both = pairs.select("conv_id", F.posexplode(F.arrays_zip("input_ids", "attention_mask")).alias("row", "z"))
    add = lambda a, x: a + x
    return both.select("conv_id", "row", F.aggregate("z.attention_mask", F.lit(0), add).alias("valid"), F.aggregate("z.input_ids", F.lit(0), add).alias("total"), F.element_at("z.input_ids", 64).alias("last"))
