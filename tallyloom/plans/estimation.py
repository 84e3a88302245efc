"""Estimators, divergences, windows and losses as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import divergence as D
from tallyloom.functions import losses as L
from tallyloom.operators import estimators as E
from tallyloom.sources import views as V

from .registry import query

_KEYS = "prompt_id, sample_id"
_STATS = "SELECT *, count(*) OVER (PARTITION BY prompt_id) AS n, avg(score) OVER (PARTITION BY prompt_id) AS m, stddev_samp(score) OVER (PARTITION BY prompt_id) AS sd, sum(score) OVER (PARTITION BY prompt_id) AS s FROM v_rollouts"


def _advantage(spark, d, column):
    return V.rollouts(spark, d).select("prompt_id", "sample_id", column.alias("advantage"))


@query("g02_grpo", f"SELECT {_KEYS}, round((score - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6), 4) AS advantage FROM ({_STATS})")
def g02(spark, d):
    return _advantage(spark, d, F.round(E.grpo("score", "prompt_id"), 4))


@query("g02_grpo_centred", f"SELECT {_KEYS}, round(score - CASE WHEN n = 1 THEN 0 ELSE m END, 6) AS advantage FROM ({_STATS})")
def g02c_g06(spark, d):
    return _advantage(spark, d, E.grpo("score", "prompt_id", by_std=False))


@query("g05_grpo_vectorized", f"SELECT {_KEYS}, round((score - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE sqrt(greatest(sd * sd, 1e-6)) END + 1e-6), 4) AS advantage FROM ({_STATS})")
def g05_a60(spark, d):
    return _advantage(spark, d, F.round(E.grpo_floored("score", "prompt_id"), 4))


@query("g04_grpo_passk", f"""SELECT {_KEYS}, round(CASE WHEN r = 1 THEN score - nxt ELSE 0 END, 6) AS advantage FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, sample_id) AS r,
    lead(score) OVER (PARTITION BY prompt_id ORDER BY score DESC, sample_id) AS nxt FROM ({_STATS})) WHERE n >= 2""")
def g04_o12(spark, d):
    w = Window.partitionBy("prompt_id")
    several = V.rollouts(spark, d).withColumn("_n", F.count("*").over(w)).where("_n >= 2")
    return several.select("prompt_id", "sample_id", E.grpo_passk("score", "prompt_id", "sample_id").alias("advantage"))


@query("g07_rloo", f"SELECT {_KEYS}, round(CASE WHEN n > 1 THEN n / (n - 1) * (score - m) ELSE score END, 6) AS advantage FROM ({_STATS})")
def g07(spark, d):
    return _advantage(spark, d, E.rloo("score", "prompt_id"))


@query("g08_rloo_vectorized", f"SELECT {_KEYS}, round((n * score - s) / greatest(n - 1, 1), 6) AS advantage FROM ({_STATS})")
def g08_g15(spark, d):
    return _advantage(spark, d, E.rloo_zero("score", "prompt_id"))


@query("g09_opo", f"SELECT {_KEYS}, round(score - CASE WHEN n > 1 THEN sum(score * length) OVER (PARTITION BY prompt_id) / sum(length) OVER (PARTITION BY prompt_id) ELSE 0 END, 6) AS advantage FROM ({_STATS})", exact=True)
def g09(spark, d):
    return _advantage(spark, d, E.opo("score", "prompt_id", "length"))


@query("g12_gpg", f"SELECT {_KEYS}, round((SELECT count(*)::DOUBLE / greatest(count(*) FILTER (score <> 0), 1) FROM v_rollouts) * (score - CASE WHEN n > 1 THEN m ELSE 0 END), 6) AS advantage FROM ({_STATS})")
def g12(spark, d):
    return E.gpg(V.rollouts(spark, d), "score", "prompt_id").select("prompt_id", "sample_id", "advantage")


@query("g06_whitened", f"""WITH c AS (SELECT {_KEYS}, score - CASE WHEN n > 1 THEN m ELSE 0 END AS a FROM ({_STATS})) SELECT {_KEYS}, round((a - (SELECT avg(a) FROM c)) / sqrt((SELECT var_samp(a) FROM c) + 1e-8), 6) AS a FROM c""")
def g06_a59(spark, d):
    return E.whiten(V.rollouts(spark, d).select("prompt_id", "sample_id", E.centred("score", "prompt_id").alias("a")), "a")


@query("w05_returns_to_go", "SELECT sequence, t, round(sum(reward) OVER (PARTITION BY sequence ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS returns FROM v_tokens")
def w05_g11(spark, d):
    return V.tokens(spark, d).select("sequence", "t", E.returns_to_go("reward", "sequence", "t").alias("returns"))


@query("g03_token_grpo", """WITH s AS (SELECT *, sequence // 8 AS g FROM v_tokens), z AS (SELECT *, CASE WHEN mask THEN (reward - CASE WHEN count(CASE WHEN mask THEN 1 END) OVER w <= 1 THEN 0 ELSE avg(CASE WHEN mask THEN reward END) OVER w END) /
    (CASE WHEN count(CASE WHEN mask THEN 1 END) OVER w <= 1 THEN 1 ELSE stddev_samp(CASE WHEN mask THEN reward END) OVER w END + 1e-6) ELSE 0 END AS z FROM s WINDOW w AS (PARTITION BY g))
    SELECT sequence, t, round(sum(z) OVER (PARTITION BY sequence ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5) AS advantage FROM z""")
def g03(spark, d):
    t = V.tokens(spark, d).withColumn("g", F.floor(F.col("sequence") / 8))
    return E.token_grpo(t, "reward", "g", "sequence", "t", "mask").select("sequence", "t", F.round("advantage", 5).alias("advantage"))


@query("w06_discounted", """WITH RECURSIVE x AS (SELECT sequence, t, reward, mask, row_number() OVER (PARTITION BY sequence ORDER BY t DESC) AS i FROM v_tokens), r AS (SELECT sequence, t, i, reward AS ret, reward * mask::INT AS carry FROM x WHERE i = 1
    UNION ALL SELECT x.sequence, x.t, x.i, x.reward + 0.9 * r.carry, (x.reward + 0.9 * r.carry) * x.mask::INT FROM r JOIN x ON x.sequence = r.sequence AND x.i = r.i + 1) SELECT sequence, t, round(ret, 6) AS ret FROM r""")
def w06_g10(spark, d):
    v = E.vectors(V.tokens(spark, d), "sequence", "t", "reward", "mask")
    return v.select("sequence", F.posexplode(E.discounted(F.col("reward"), F.col("mask"), 0.9)).alias("t", "ret")).withColumn("t", F.col("t") + 1)


@query("g01_gae", """WITH RECURSIVE x AS (SELECT sequence, t, reward, value, mask, row_number() OVER (PARTITION BY sequence ORDER BY t DESC) AS i FROM v_tokens), r AS (
    SELECT sequence, t, i, CASE WHEN mask THEN value ELSE 0.0 END AS v, CASE WHEN mask THEN reward - value ELSE 0.0 END AS a FROM x WHERE i = 1
    UNION ALL SELECT x.sequence, x.t, x.i, CASE WHEN x.mask THEN x.value ELSE r.v END, CASE WHEN x.mask THEN x.reward + 0.99 * r.v - x.value + 0.99 * 0.95 * r.a ELSE r.a END FROM r JOIN x ON x.sequence = r.sequence AND x.i = r.i + 1)
    SELECT sequence, t, round(a, 6) AS advantage FROM r""")
def w07_g01(spark, d):
    v = E.vectors(V.tokens(spark, d), "sequence", "t", "reward", "value", "mask")
    out = E.gae(F.col("reward"), F.col("value"), F.col("mask"), 0.99, 0.95)
    return v.select("sequence", F.posexplode(out).alias("t", "advantage")).withColumn("t", F.col("t") + 1)


@query("g16_filter_groups", "SELECT run_name, count(*) AS n, count(DISTINCT prompt_id) AS n_prompts FROM (SELECT *, stddev_pop(acc::INT) OVER (PARTITION BY prompt_id) AS sd, count(*) OVER (PARTITION BY prompt_id) AS n FROM v_rollouts) WHERE sd > 0 OR n = 1 GROUP BY run_name")
def g16(spark, d):
    kept = E.filter_groups(V.rollouts(spark, d).withColumn("a", F.col("acc").cast("double")), "prompt_id", "a")
    return kept.groupBy("run_name").agg(F.count("*").alias("n"), F.count_distinct("prompt_id").alias("n_prompts"))


@query("g17_kl_in_reward", "SELECT sequence, round(sum(CASE WHEN mask THEN reward - 0.05 * (logp_a - logp_b) ELSE reward END), 6) AS reward, round(avg(CASE WHEN mask THEN logp_a - logp_b END), 6) AS kl FROM v_tokens GROUP BY sequence")
def g13_g14_g17_f53(spark, d):
    k = L.kl_penalty(F.col("logp_a"), F.col("logp_b"), "k1")
    t = V.tokens(spark, d).withColumn("k", F.when(F.col("mask"), k))
    return t.groupBy("sequence").agg(F.sum(F.col("reward") - 0.05 * F.coalesce("k", F.lit(0.0))).alias("reward"), F.avg("k").alias("kl"))


@query("a61_losses", """WITH s AS (SELECT sequence, sum(js) AS s, count(*) AS n FROM v_tokens WHERE mask GROUP BY sequence) SELECT 'token-mean' AS mode, round(sum(s) / sum(n), 6) AS loss FROM s UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) FROM s
    UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / n), 6) FROM s UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / 100, 6) FROM s""")
def a61(spark, d):
    t, out = V.tokens(spark, d), None
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        one = E.loss(t, "js", "mask", "sequence", mode, norm=100.0).select(F.lit(mode).alias("mode"), "loss")
        out = one if out is None else out.union(one)
    return out


@query("f52_kl_penalties", """SELECT sequence, t, round(logp_a - logp_b, 6) AS k1, round(abs(logp_a - logp_b), 6) AS abs, round(0.5 * pow(logp_a - logp_b, 2), 6) AS k2,
    round(least(greatest(exp(logp_b - logp_a) - (logp_b - logp_a) - 1, -10), 10), 6) AS k3 FROM v_tokens""")
def f52(spark, d):
    return V.tokens(spark, d).select("sequence", "t", *[L.kl_penalty(F.col("logp_a"), F.col("logp_b"), k).alias(k) for k in ("k1", "abs", "k2", "k3")])


@query("f56_importance_weights", """SELECT sequence, round(avg(w), 6) AS mean, round(max(w), 6) AS max, round(min(w), 6) AS min, round(pow(sum(w), 2) / sum(w * w) / count(*), 6) AS ess, round(avg((w >= 2)::INT), 6) AS high, round(avg((w < 0.5 OR w > 2)::INT), 6) AS rejected
    FROM (SELECT sequence, least(exp(logp_a - logp_b), 2) AS w FROM v_tokens WHERE mask) GROUP BY sequence""")
def f56_f57_f58_a67_a68(spark, d):
    t = V.tokens(spark, d).where("mask").withColumn("w", L.importance_weight(F.col("logp_a"), F.col("logp_b")))
    w = F.col("w")
    return t.groupBy("sequence").agg(
        F.avg(w).alias("mean"), F.max(w).alias("max"), F.min(w).alias("min"), (F.pow(F.sum(w), 2) / F.sum(w * w) / F.count("*")).alias("ess"), F.avg((w >= 2).cast("double")).alias("high"), F.avg(L.rejected(w, 2.0).cast("double")).alias("rejected")
    )


@query("a66_off_policy", """SELECT round(avg(kl), 6) AS kl, round(avg(k3), 6) AS k3, round(avg(exp(-a)), 4) AS ppl_a, round(avg(exp(-b)), 4) AS ppl_b, round(max(a - b), 6) AS gap_max FROM (SELECT sequence, avg(logp_a - logp_b) AS kl, avg(exp(logp_b - logp_a) - (logp_b - logp_a) - 1) AS k3,
    avg(logp_a) AS a, avg(logp_b) AS b FROM v_tokens WHERE mask GROUP BY sequence)""")
def a62_a66(spark, d):
    own = V.tokens(spark, d).where("mask").groupBy("sequence").agg(F.avg(F.col("logp_a") - F.col("logp_b")).alias("kl"), F.avg(L.kl_penalty(F.col("logp_a"), F.col("logp_b"), "k3")).alias("k3"), F.avg("logp_a").alias("a"), F.avg("logp_b").alias("b"))
    return own.agg(F.avg("kl").alias("kl"), F.avg("k3").alias("k3"), F.round(F.avg(F.exp(-F.col("a"))), 4).alias("ppl_a"), F.round(F.avg(F.exp(-F.col("b"))), 4).alias("ppl_b"), F.max(F.col("a") - F.col("b")).alias("gap_max"))


@query("f59_policy_loss", """SELECT sequence, round(avg(CASE WHEN a < 0 THEN least(-a * 3, w) ELSE w END), 6) AS loss FROM (SELECT sequence, a, greatest(-a * r, -a * least(greatest(r, 0.8), 1.2)) AS w FROM (SELECT sequence, reward - 0.05 AS a, exp(logp_a - logp_b) AS r FROM v_tokens)) GROUP BY sequence""")
def f59(spark, d):
    t = V.tokens(spark, d)
    return t.groupBy("sequence").agg(F.avg(L.policy_loss(F.col("logp_a"), F.col("logp_b"), F.col("reward") - 0.05)).alias("loss"))


@query("f61_value_loss", "SELECT sequence, round(avg(0.5 * greatest(pow(value - reward, 2), pow(least(greatest(value, js - 0.02), js + 0.02) - reward, 2))), 6) AS loss FROM v_tokens GROUP BY sequence")
def f61(spark, d):
    return V.tokens(spark, d).groupBy("sequence").agg(F.avg(L.value_loss(F.col("value"), F.col("js"), F.col("reward"), 0.02)).alias("loss"))


@query("f21_overlong_penalty", "SELECT prompt_id, sample_id, round(score + least(-(length - 30) / 20.0, 0), 6) AS score, 24576 * length + length * length AS workload FROM v_rollouts")
def f21_f55(spark, d):
    return V.rollouts(spark, d).select("prompt_id", "sample_id", (F.col("score") + L.overlong_penalty(F.col("length"), 50, 20, 1.0)).alias("score"), L.workload(F.col("length")).alias("workload"))


@query("f39_signed_log", "SELECT sequence, t, round(CASE WHEN logp_a - logp_b <> 0 THEN sign(logp_a - logp_b) * log10(abs(logp_a - logp_b)) END, 4) AS x FROM v_tokens")
def f39_f51(spark, d):
    return V.tokens(spark, d).select("sequence", "t", F.round(L.signed_log10(F.col("logp_a") - F.col("logp_b")), 4).alias("x"))


_BUCKET = "CASE WHEN t = 1 THEN '1' WHEN t <= 4 THEN '2-4' WHEN t <= 16 THEN '5-16' WHEN t <= 63 THEN '17-63' WHEN t > 0.95 * n THEN 'last 5%' ELSE 'interior' END"


@query("a20_position_buckets", f"SELECT mode, bucket, count(*) AS n, count(DISTINCT sequence) AS n_sequences, round(avg(js), 6) AS mean, round(median(js), 6) AS median FROM (SELECT *, {_BUCKET} AS bucket FROM (SELECT *, max(t) OVER (PARTITION BY sequence) AS n FROM v_user_tokens)) GROUP BY mode, bucket", exact=True)
def a20_a21_f34_w04_j07(spark, d):
    w = Window.partitionBy("sequence")
    t = V.user_tokens(spark, d).withColumn("n", F.max("t").over(w)).withColumn("bucket", D.position_bucket(F.col("t"), F.col("n")))
    return t.groupBy("mode", "bucket").agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("n_sequences"), F.avg("js").alias("mean"), F.median("js").alias("median"))


@query("a23_routing", """SELECT round(avg(js) FILTER (t = 1), 6) AS pos1_mean, round(median(js) FILTER (t = 1), 6) AS pos1_median, round(stddev_samp(js) FILTER (t = 1), 6) AS pos1_std, round(avg(js) FILTER (t = 2), 6) AS pos2_mean, round(avg(js) FILTER (t = 5), 6) AS pos5_mean,
    round(avg(js) FILTER (t >= 5 AND t < 0.9 * n), 6) AS interior_mean, round(avg(js) FILTER (t = 1) / nullif(avg(js) FILTER (t >= 5 AND t < 0.9 * n), 0), 6) AS ratio, count(*) FILTER (t = 1) AS n_pos1, count(*) FILTER (t >= 5 AND t < 0.9 * n) AS n_interior FROM (SELECT *, max(t) OVER (PARTITION BY sequence) AS n FROM v_user_tokens)""")
def a23_p18(spark, d):
    t = V.user_tokens(spark, d).withColumn("n", F.max("t").over(Window.partitionBy("sequence")))
    at = lambda k: F.when(F.col("t") == k, F.col("js"))
    inner = F.when((F.col("t") >= 5) & (F.col("t") < 0.9 * F.col("n")), F.col("js"))
    return t.agg(
        F.avg(at(1)).alias("pos1_mean"), F.median(at(1)).alias("pos1_median"), F.stddev_samp(at(1)).alias("pos1_std"), F.avg(at(2)).alias("pos2_mean"), F.avg(at(5)).alias("pos5_mean"), F.avg(inner).alias("interior_mean"),
        F.try_divide(F.avg(at(1)), F.nullif(F.avg(inner), F.lit(0.0))).alias("ratio"), F.count(at(1)).alias("n_pos1"), F.count(inner).alias("n_interior"),
    )


@query("a24_position_percentiles", "SELECT t, count(*) AS n, round(avg(js), 6) AS mean, round(quantile_cont(js, 0.5), 6) AS p50, round(quantile_cont(js, 0.9), 6) AS p90 FROM v_user_tokens GROUP BY t")
def a24_a64(spark, d):
    return V.user_tokens(spark, d).groupBy("t").agg(F.count("*").alias("n"), F.avg("js").alias("mean"), F.percentile("js", 0.5).alias("p50"), F.percentile("js", 0.9).alias("p90"))


@query("p19_high_js", "SELECT sequence, t, round(js, 6) AS js FROM v_user_tokens WHERE js >= (SELECT quantile_cont(js, 0.9) FROM v_user_tokens)")
def p19(spark, d):
    t = V.user_tokens(spark, d)
    return t.crossJoin(F.broadcast(t.agg(F.percentile("js", 0.9).alias("cut")))).where("js >= cut").select("sequence", "t", "js")


_TOP = "SELECT vec_id, list_transform(range(1, 11), lambda i: list_sort(list_transform(range(len(embedding)), lambda j: {'neg': -embedding[j + 1]::DOUBLE, 'id': j}))[i]) AS top FROM embeddings"
_PAIR = f"""WITH v AS ({_TOP}), p AS (SELECT a.vec_id, list_transform(a.top, lambda x: x.id) AS ia, list_transform(b.top, lambda x: x.id) AS ib, list_transform(a.top, lambda x: -x.neg) AS la, list_transform(b.top, lambda x: -x.neg) AS lb FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
    u AS (SELECT vec_id, unnest(list_distinct(ia || ib)) AS id, ia, ib, la, lb FROM p), e AS (SELECT vec_id, coalesce(exp(la[list_position(ia, id)]), 0) AS x, coalesce(exp(lb[list_position(ib, id)]), 0) AS y FROM u),
    n AS (SELECT vec_id, x / sum(x) OVER (PARTITION BY vec_id) AS p, y / sum(y) OVER (PARTITION BY vec_id) AS q FROM e)"""


@query("f37_topk_divergence", _PAIR + """ SELECT vec_id, round(sum(p * (ln(p + 1e-12) - ln(q + 1e-12))), 5) AS kl_pq, round(sum(q * (ln(q + 1e-12) - ln(p + 1e-12))), 5) AS kl_qp,
    round(sum(p * (ln(p + 1e-12) - ln((p + q) / 2 + 1e-12)) + q * (ln(q + 1e-12) - ln((p + q) / 2 + 1e-12))) / 2, 6) AS js FROM n GROUP BY vec_id""")
def f35_f36_f37_j04(spark, d):
    v = V.top_k(spark, d).withColumn("u", F.array_union("ids_b", "ids_rl"))
    pq = v.select("vec_id", D.over_union(F.col("ids_b"), F.col("logits_b"), F.col("u")).alias("p"), D.over_union(F.col("ids_rl"), F.col("logits_rl"), F.col("u")).alias("q"))
    p, q = F.col("p"), F.col("q")
    return pq.select("vec_id", F.round(D.kl(p, q), 5).alias("kl_pq"), F.round(D.kl(q, p), 5).alias("kl_qp"), D.js(p, q).alias("js"))


@query("f38_topk_overlap", _PAIR + """ SELECT vec_id, round(len(list_intersect(ia[1:5], ib[1:5]))::DOUBLE / len(list_distinct(ia[1:5] || ib[1:5])), 6) AS jaccard_5, round(len(list_intersect(ia, ib))::DOUBLE / len(list_distinct(ia || ib)), 6) AS jaccard_10,
    CASE WHEN list_contains(ia, ib[1]) THEN list_position(ia, ib[1]) ELSE 11 END AS rank FROM p""")
def f38_a22(spark, d):
    v = V.top_k(spark, d)
    at = F.array_position("ids_b", F.get("ids_rl", F.lit(0)))
    cut = lambda c, k: F.slice(c, 1, k)
    return v.select("vec_id", *[D.jaccard(cut("ids_b", k), cut("ids_rl", k)).alias(f"jaccard_{k}") for k in (5, 10)], F.when(at > 0, at).otherwise(11).alias("rank"))


@query("j05_three_way_tokens", """SELECT a.sequence, a.t, round(a.js, 6) AS js_a, round(b.js, 6) AS js_b, round(c.js, 6) AS js_c FROM v_tokens a JOIN (SELECT * FROM v_tokens WHERE mask) b ON a.sequence = b.sequence AND a.t = b.t JOIN (SELECT * FROM v_tokens WHERE reward > 0.03) c ON a.sequence = c.sequence AND a.t = c.t""")
def j04_j05_j06(spark, d):
    t = V.tokens(spark, d)
    a, b, c = t.select("sequence", "t", F.col("js").alias("js_a")), t.where("mask").select("sequence", "t", F.col("js").alias("js_b")), t.where("reward > 0.03").select("sequence", "t", F.col("js").alias("js_c"))
    return a.join(b, ["sequence", "t"]).join(c, ["sequence", "t"])
