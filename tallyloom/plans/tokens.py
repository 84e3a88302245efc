"""Queries on token-level estimators and means."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import estimators as E
from tallyloom.sources import views as V

from .registry import query, scaled_round


@query("g10_plus_plus", """WITH RECURSIVE x AS (SELECT sequence, t, reward, mask, row_number() OVER (PARTITION BY sequence ORDER BY t DESC) AS i FROM v_tokens), r AS (SELECT sequence, t, i, mask, reward AS ret, reward * mask::INT AS carry FROM x WHERE i = 1
    UNION ALL SELECT x.sequence, x.t, x.i, x.mask, x.reward + 0.9 * r.carry, (x.reward + 0.9 * r.carry) * x.mask::INT FROM r JOIN x ON x.sequence = r.sequence AND x.i = r.i + 1)
    SELECT sequence, t, round(ret, 5) AS returns, round(CASE WHEN mask THEN (ret - (SELECT avg(ret) FROM r WHERE mask)) / sqrt((SELECT var_samp(ret) FROM r WHERE mask) + 1e-8) ELSE 0 END, 5) AS advantage FROM r""")
def g10(spark, d):
    got = E.plus_plus(V.tokens(spark, d), "reward", "sequence", "t", "mask", gamma=0.9)
    return got.select("sequence", "t", scaled_round("returns", 5).alias("returns"), scaled_round("advantage", 5).alias("advantage"))


@query("g11_remax", """SELECT v.sequence, t, round(sum(CASE WHEN mask THEN reward ELSE 0 END) OVER w, 6) AS returns, round(sum(CASE WHEN mask THEN reward ELSE 0 END) OVER w - CASE WHEN mask THEN coalesce(b, 0) ELSE 0 END, 6) AS advantage
    FROM v_tokens v LEFT JOIN (SELECT o_orderkey AS sequence, o_custkey % 100 / 1000.0 AS b FROM orders WHERE o_orderstatus <> 'P') o ON v.sequence = o.sequence WINDOW w AS (PARTITION BY v.sequence ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", exact=True)
def g11(spark, d):
    baselines = V.table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("sequence"), (F.col("o_custkey") % 100 / 1000).alias("b"))
    return E.remax(V.tokens(spark, d), "reward", baselines, "b", "sequence", "t", "mask").select("sequence", "t", "returns", "advantage")


@query("a64_position_means", "SELECT t, count(*) AS n, round(avg(js), 6) AS js, round(avg(value), 6) AS value FROM v_tokens WHERE mask GROUP BY t", exact=True)
def a64(spark, d):
    return E.position_means(V.tokens(spark, d), "t", "mask", ["js", "value"])


@query("f53_rewards", "SELECT sequence, t, round(reward - 0.2 * (logp_a - logp_b), 6) AS reward FROM v_tokens", exact=True)
def f53_f51(spark, d):
    return V.tokens(spark, d).select("sequence", "t", (F.col("reward") - 0.2 * (F.col("logp_a") - F.col("logp_b"))).alias("reward"))
