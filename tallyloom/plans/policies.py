"""Queries on policy losses by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import policy as P
from tallyloom.sources import views as V

from .registry import query

_T = "SELECT *, logp_a - logp_b AS d, reward - 0.05 AS a FROM v_tokens"
_D = "greatest(-a * exp(d), -a * least(greatest(exp(d), 0.8), 1.2))"
_LOSSES = {
    "vanilla": f"CASE WHEN a < 0 THEN least(-a * 3, {_D}) ELSE {_D} END", "gspo": "greatest(-a * r, -a * least(greatest(r, 0.8), 1.2))", "gpg": "-logp_a * a", "geo_mean": "-a * exp(g)",
    "clip_cov": f"CASE WHEN ck THEN 0 ELSE {_D} END", "kl_cov": "-a * exp(d) + CASE WHEN kk THEN abs(d) ELSE 0 END",
}


@query("d05_policy_losses", f"""WITH x AS ({_T}), m AS (SELECT avg(logp_a) FILTER (mask) AS mn, avg(a) FILTER (mask) AS ma, count(*) FILTER (mask) AS n FROM x),
    c AS (SELECT x.*, n, CASE WHEN mask THEN round((logp_a - mn) * (a - ma), 9) END AS cov FROM x, m),
    q AS (SELECT *, mask AND cov > 0.0001 AND cov < 0.01 AND NOT (-a * least(greatest(exp(d), 0.8), 1.2) > -a * exp(d)) AS able FROM c),
    k AS (SELECT *, able AND row_number() OVER (PARTITION BY able ORDER BY ('0x' || substr(md5('0:' || sequence || ':' || t), 1, 12))::BIGINT, sequence, t) <= greatest(floor(0.05 * n), 1) AS ck,
        mask AND row_number() OVER (PARTITION BY mask ORDER BY cov DESC, sequence, t) <= greatest(floor(0.05 * n), 1) AS kk, exp(least(avg(d) FILTER (mask) OVER w, 10)) AS r,
        avg(CASE WHEN a > 0 THEN least(d, least(greatest(d, -0.4), 0.4)) WHEN a < 0 THEN greatest(d, least(greatest(d, -0.4), 0.4)) ELSE 0 END) FILTER (mask) OVER w AS g FROM q WINDOW w AS (PARTITION BY sequence))
    """ + " UNION ALL ".join(f"SELECT '{n}' AS name, sequence, round(avg({sql}) FILTER (mask), 6) AS loss, count(*) FILTER (mask AND {'ck' if n == 'clip_cov' else 'kk' if n == 'kl_cov' else 'false'}) AS marked FROM k GROUP BY sequence" for n, sql in _LOSSES.items()))
def d05(spark, d):
    """Every registered loss; `marked` says how many tokens of a sequence the covariance singled out."""
    s = P.Settings(new="logp_a", old="logp_b", advantage="a", cov_ratio=0.05, cov_low=0.0001, cov_high=0.01)
    tokens = V.tokens(spark, d).withColumn("a", F.col("reward") - 0.05)
    rows = P.policy_losses(list(_LOSSES), tokens, s)
    count = lambda name: F.count_if(F.col(f"singled_{name}") & F.col("mask")) if f"singled_{name}" in rows.columns else F.lit(0).cast("long")
    each = rows.groupBy("sequence").agg(*[F.struct(F.lit(n).alias("name"), F.avg(f"loss_{n}").alias("loss"), count(n).alias("marked")).alias(n) for n in _LOSSES])
    return each.select("sequence", F.explode(F.array(*_LOSSES)).alias("r")).select("r.name", "sequence", "r.loss", "r.marked")
