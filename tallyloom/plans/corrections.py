"""Queries on weights between the sampled and the trained policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import correction as C
from tallyloom.sources import views as V

from .registry import query


def _sql(level: str, upper: float, lower: float, most: str) -> str:
    log = {"token": "d", "sequence": "coalesce(sum(d) FILTER (mask) OVER (PARTITION BY sequence), 0)", "geometric": "coalesce(avg(d) FILTER (mask) OVER (PARTITION BY sequence), 0)"}[level]
    if level == "token":
        outside = f"sum(h) / (sum(n) + 1e-8) AS fraction_high, sum(l) / (sum(n) + 1e-8) AS fraction_low, max(x) AS max, min(m) AS min"
    else:
        outside = f"avg((r > ln({upper}))::INT) AS fraction_high, avg((r < ln({lower}))::INT) AS fraction_low, exp(least(max(r), 20)) AS max, exp(min(r)) AS min"
    names = ("mean", "std", "eff_sample_size", "fraction_high", "fraction_low", "max", "min", "seq_mean", "seq_std", "seq_max", "seq_min", "seq_max_deviation", "seq_fraction_high", "seq_fraction_low")
    return f"""SELECT '{level}' AS level, g, {', '.join(f'round({c}, 6) AS {c}' for c in names)} FROM (SELECT g, sum(w) / (sum(n) + 1e-8) AS mean, CASE WHEN sum(n) > 1 THEN sqrt(greatest(sum(q) / (sum(n) + 1e-8) - pow(sum(c) / (sum(n) + 1e-8), 2), 0)) ELSE 0 END AS std,
        pow(sum(c) / (sum(n) + 1e-8) + 1e-8, 2) / (sum(q) / (sum(n) + 1e-8)) AS eff_sample_size, {outside}, avg(s) AS seq_mean, coalesce(stddev_samp(s), 0) AS seq_std, max(s) AS seq_max, min(s) AS seq_min, max(abs(s - 1)) AS seq_max_deviation,
        avg((s > {upper})::INT) AS seq_fraction_high, avg((s < {lower})::INT) AS seq_fraction_low
        FROM (SELECT *, coalesce(w, 0) / (n + 1e-8) AS s FROM (SELECT g, sequence, count(*) FILTER (mask) AS n, sum(e) FILTER (mask) AS w, sum(k) FILTER (mask) AS c, sum(k * k) FILTER (mask) AS q, max(e) FILTER (mask) AS x, min(e) FILTER (mask) AS m,
        count(*) FILTER (mask AND e > {upper}) AS h, count(*) FILTER (mask AND e < {lower}) AS l, max(r) AS r FROM (SELECT *, least(greatest(e, {lower}), {upper}) AS k FROM (SELECT *, {most} AS e FROM (SELECT *, {log} AS r FROM (SELECT *, sequence % 5 AS g, logp_a - logp_b AS d FROM v_tokens)))) GROUP BY g, sequence)) GROUP BY g)"""


def _metrics(spark, d, levels, upper, lower, most):
    tokens, out = V.tokens(spark, d).withColumn("g", F.col("sequence") % 5), None
    for level in levels:
        rows = C.weighted(tokens, F.col("logp_a") - F.col("logp_b"), "mask", "sequence", level=level, most=most)
        one = C.weight_metrics(rows, ["g"], "mask", "sequence", level=level, upper=upper, lower=lower).withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out


@query("a67_weight_metrics", " UNION ALL ".join(_sql(x, 1.5, 1 / 1.5, "least(exp(least(greatest(r, -20), 20)), 1.5)") for x in ("token", "sequence")), exact=True)
def a67_f56(spark, d):
    return _metrics(spark, d, ("token", "sequence"), 1.5, None, 1.5)


@query("a68_rejection_metrics", " UNION ALL ".join(_sql(x, 1.2, 0.9, "exp(least(greatest(r, -20), 20))") for x in C.LEVELS), exact=True)
def a68_f57(spark, d):
    return _metrics(spark, d, C.LEVELS, 1.2, 0.9, None)
