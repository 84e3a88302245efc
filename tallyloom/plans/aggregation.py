"""Aggregation queries over rollouts, tokens and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import aggregates as A
from tallyloom.sources import views as V

from .registry import query

PROMPT = ["run_name", "checkpoint_step", "prompt_id"]
STEP = ["run_name", "checkpoint_step"]

_PER_PROMPT = """SELECT run_name, checkpoint_step, prompt_id, count(*) AS n, CAST(sum(CASE WHEN acc THEN 1 ELSE 0 END) AS BIGINT) AS pass_count, avg(CASE WHEN acc THEN 1.0::DOUBLE ELSE 0 END) AS pass_at_1,
    max(CASE WHEN acc THEN 1.0::DOUBLE ELSE 0 END) AS best_at_n, avg(CASE WHEN score >= 1 THEN 1.0::DOUBLE ELSE 0 END) AS strict_rate, max(CASE WHEN score >= 1 THEN 1.0::DOUBLE ELSE 0 END) AS strict_any,
    avg(score) AS score_mean, max(score) AS score_max, min(score) AS score_min, avg(length) AS length_mean, stddev_pop(length) AS length_std
    FROM v_rollouts GROUP BY ALL"""


@query("a10_prompt_rollup", f"SELECT run_name, checkpoint_step, prompt_id, n, pass_count, round(pass_at_1, 6) AS pass_at_1, best_at_n, round(strict_rate, 6) AS strict_rate, strict_any, round(score_mean, 6) AS score_mean, round(score_max, 6) AS score_max, round(score_min, 6) AS score_min, round(length_mean, 6) AS length_mean, round(length_std, 6) AS length_std FROM ({_PER_PROMPT})")
def a10(spark, d):
    return A.prompt_rollup(V.rollouts(spark, d), PROMPT)


@query("a12_step_rollup", f"SELECT run_name, checkpoint_step, count(*) AS n_prompts, CAST(sum(n) AS BIGINT) AS n_rollouts, round(avg(pass_at_1), 6) AS pass_at_1, round(avg(best_at_n), 6) AS best_at_n, round(avg(strict_rate), 6) AS strict_mean, round(avg(strict_any), 6) AS strict_any, round(avg(score_mean), 6) AS score_mean, round(avg(score_max), 6) AS score_best, round(avg(length_mean), 6) AS length_mean FROM ({_PER_PROMPT}) GROUP BY ALL")
def a12_a13(spark, d):
    p = A.prompt_rollup(V.rollouts(spark, d), PROMPT)
    return p.groupBy(*STEP).agg(
        F.count("*").alias("n_prompts"), F.sum("n").alias("n_rollouts"), F.avg("pass_at_1").alias("pass_at_1"), F.avg("best_at_n").alias("best_at_n"), F.avg("strict_rate").alias("strict_mean"),
        F.avg("strict_any").alias("strict_any"), F.avg("score_mean").alias("score_mean"), F.avg("score_max").alias("score_best"), F.avg("length_mean").alias("length_mean"),
    )


_VOTES = "SELECT run_name, checkpoint_step, prompt_id, gold, pred, count(*) AS n, min(sample_id) AS first, max(CASE WHEN acc THEN 1 ELSE 0 END) AS any_acc, arg_min(CASE WHEN acc THEN 1.0::DOUBLE ELSE 0 END, sample_id) AS first_acc FROM v_rollouts GROUP BY ALL"
_MODAL = f"""SELECT *, row_number() OVER (PARTITION BY run_name, checkpoint_step, prompt_id ORDER BY (pred IS NOT NULL) DESC, n DESC, first) AS r,
    sum(CASE WHEN pred IS NOT NULL THEN n END) OVER (PARTITION BY run_name, checkpoint_step, prompt_id) AS total FROM ({_VOTES})"""


@query("a11_majority_vote", f"""SELECT run_name, checkpoint_step, prompt_id, gold, max(CASE WHEN r = 1 THEN pred END) AS modal, CAST(max(CASE WHEN r = 1 THEN any_acc END) AS DOUBLE) AS maj_any,
    max(CASE WHEN r = 1 THEN first_acc END) AS maj_first, max(CASE WHEN r = 1 AND pred = gold THEN 1.0::DOUBLE ELSE 0 END) AS maj_gold, count(pred) AS n_unique,
    round(abs(sum(CASE WHEN pred IS NOT NULL THEN -(n / total) * log2(n / total) END)), 6) AS entropy,
    round(abs(sum(CASE WHEN pred IS NOT NULL THEN -(n / total) * log2(n / total) END)) / log2(greatest(2, count(pred))), 6) AS entropy_share FROM ({_MODAL}) GROUP BY run_name, checkpoint_step, prompt_id, gold""")
def a01_a11(spark, d):
    return A.majority(V.rollouts(spark, d), PROMPT, gold="gold")


@query("a06_prefix_concentration", """SELECT run_name, round(CAST(sum(CASE WHEN r <= 3 THEN n END) AS DOUBLE) / sum(n), 6) AS concentration FROM (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY n DESC, length) AS r
    FROM (SELECT run_name, length, count(*) AS n FROM v_rollouts GROUP BY ALL)) GROUP BY run_name""")
def a06(spark, d):
    return A.concentration(V.rollouts(spark, d), ["run_name"], "length", 3)


@query("a07_value_entropy", """SELECT run_name, round(sum(-(n / total) * log2(n / total)), 6) AS entropy, count(*) AS n_values FROM (SELECT *, sum(n) OVER (PARTITION BY run_name) AS total
    FROM (SELECT run_name, length, count(*) AS n FROM v_rollouts GROUP BY ALL)) GROUP BY run_name""")
def a07(spark, d):
    return A.entropy_of(V.rollouts(spark, d), ["run_name"], "length")


def _best(k):
    return f"CASE WHEN n < {k} THEN CAST(pass_count > 0 AS INT) WHEN pass_count = 0 THEN 0.0 ELSE 1 - list_reduce([1.0::DOUBLE] || list_transform(range({k}), lambda i: greatest(n - pass_count - i, 0)::DOUBLE / greatest(n - i, 1)), lambda a, b: a * b) END"


@query("a16_unbiased_best_at_k", f"SELECT run_name, checkpoint_step, " + ", ".join(f"round(avg({_best(k)}), 6) AS best_at_{k}" for k in (1, 2, 4, 8)) + f" FROM ({_PER_PROMPT}) GROUP BY ALL")
def a16(spark, d):
    p = A.prompt_rollup(V.rollouts(spark, d), PROMPT)
    return p.groupBy(*STEP).agg(*[F.avg(A.best_at_k(F.col("n"), F.col("pass_count"), k)).alias(f"best_at_{k}") for k in (1, 2, 4, 8)])


@query("a17_condition_summary", """SELECT family, count(*) AS n, round(avg(acc::INT), 6) AS mean_acc, round(avg(bypass::INT), 6) AS bypass_rate, round(avg(length), 6) AS mean_length,
    round(avg(CASE WHEN acc THEN length END), 6) AS mean_length_correct FROM v_rollouts GROUP BY ALL""")
def a17_a18_a19(spark, d):
    return V.rollouts(spark, d).groupBy("family").agg(
        F.count("*").alias("n"), A.rate("acc").alias("mean_acc"), A.rate("bypass").alias("bypass_rate"), F.avg("length").alias("mean_length"), F.avg(F.when(F.col("acc"), F.col("length"))).alias("mean_length_correct")
    )


@query("a19_mode_shares", "SELECT mode, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT mode, count(*) AS n FROM v_user_tokens GROUP BY ALL)")
def a19(spark, d):
    return A.shares(V.user_tokens(spark, d), [], "mode")


@query("a26_trajectory", """SELECT run_name, """ + ", ".join(f"round(max(CASE WHEN checkpoint_step = {s} THEN v END), 6) AS at_{s}" for s in (1995, 1996, 1997)) + """, round(regr_slope(v, checkpoint_step), 6) AS slope,
    round(((max(CASE WHEN checkpoint_step = 1995 THEN v END) + max(CASE WHEN checkpoint_step = 1996 THEN v END)) / 2 + (max(CASE WHEN checkpoint_step = 1996 THEN v END) + max(CASE WHEN checkpoint_step = 1997 THEN v END)) / 2) / 2, 6) AS trapezoid,
    min(CASE WHEN v > 0.25 THEN checkpoint_step END) AS first_over FROM (SELECT run_name, checkpoint_step, avg(acc::INT) AS v FROM v_rollouts GROUP BY ALL) GROUP BY run_name""")
def a25_a26_a27(spark, d):
    steps = V.rollouts(spark, d).groupBy(*STEP).agg(A.rate("acc").alias("v"))
    return A.trajectory(steps, ["run_name"], "checkpoint_step", "v", [1995, 1996, 1997])


@query("a28_geometric_gap", """SELECT sequence, round(avg(log10(p / i)), 6) AS g, round(pow(10, avg(log10(p / i))), 6) AS geomean FROM (SELECT sequence, sum(CASE WHEN t = 1 THEN js END) AS p, avg(CASE WHEN t >= 5 THEN js END) AS i
    FROM v_user_tokens GROUP BY ALL) WHERE p > 0 AND i > 0 GROUP BY ALL""")
def a28(spark, d):
    own = V.user_tokens(spark, d).groupBy("sequence").agg(F.sum(F.when(F.col("t") == 1, F.col("js"))).alias("p"), F.avg(F.when(F.col("t") >= 5, F.col("js"))).alias("i"))
    g = F.avg(F.log10(F.col("p") / F.col("i")))
    return own.where("p > 0 and i > 0").groupBy("sequence").agg(g.alias("g"), F.pow(F.lit(10.0), g).alias("geomean"))


_RANKS = "SELECT *, rank() OVER (PARTITION BY run_name ORDER BY a) + (count(*) OVER (PARTITION BY run_name, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY run_name ORDER BY b) + (count(*) OVER (PARTITION BY run_name, b) - 1) / 2.0 AS rb FROM (SELECT run_name, checkpoint_step, avg(length) AS a, avg(score) AS b FROM v_rollouts GROUP BY ALL)"


@query("a29_spearman", f"SELECT run_name, count(*) AS n, round(CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END, 6) AS rho FROM ({_RANKS}) GROUP BY ALL")
def a29(spark, d):
    steps = V.rollouts(spark, d).groupBy(*STEP).agg(F.avg("length").alias("a"), F.avg("score").alias("b"))
    return A.spearman(steps, ["run_name"], "a", "b")


@query("a29_kendall", """WITH s AS (SELECT run_name, checkpoint_step, avg(length) AS a, avg(score) AS b FROM v_rollouts GROUP BY ALL) SELECT x.run_name,
    round(sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(sum(abs(sign(x.a - y.a))) * sum(abs(sign(x.b - y.b)))), 6) AS tau FROM s x JOIN s y ON x.run_name = y.run_name AND x.checkpoint_step < y.checkpoint_step GROUP BY ALL""")
def a29k(spark, d):
    steps = V.rollouts(spark, d).groupBy(*STEP).agg(F.avg("length").alias("a"), F.avg("score").alias("b"))
    return A.kendall(steps, ["run_name"], "a", "b", "checkpoint_step")


@query("a33_checkpoint_behaviour", """SELECT run_name, checkpoint_step, family, bypass, count(*) AS n, round(avg(acc::INT), 6) AS acc, round(avg(score), 6) AS score, round(avg(length), 6) AS length,
    round(avg((acc AND score >= 0.5)::INT), 6) AS joint, round(avg((sample_id < 2 AND NOT acc)::INT), 6) AS early_miss, round(avg((sample_id >= 2 AND NOT acc)::INT), 6) AS late_miss FROM v_rollouts GROUP BY ALL""")
def a30_a33_a36(spark, d):
    late = F.col("sample_id") >= 2
    return V.rollouts(spark, d).groupBy(*STEP, "family", "bypass").agg(
        F.count("*").alias("n"), A.rate("acc").alias("acc"), F.avg("score").alias("score"), F.avg("length").alias("length"), A.rate(F.col("acc") & (F.col("score") >= 0.5)).alias("joint"),
        A.rate(~late & ~F.col("acc")).alias("early_miss"), A.rate(late & ~F.col("acc")).alias("late_miss"),
    )


@query("a35_support_bins", f"""SELECT run_name, checkpoint_step, count(*) AS n_prompts, count(*) FILTER (pass_count = 0) AS zero_count, count(*) FILTER (pass_count > 0 AND pass_count < n) AS partial_count,
    count(*) FILTER (pass_count = n) AS all_count, round(avg((pass_count = 0)::INT), 6) AS zero_rate, round(avg((pass_count > 0 AND pass_count < n)::INT), 6) AS partial_rate, round(avg((pass_count = n)::INT), 6) AS all_rate FROM ({_PER_PROMPT}) GROUP BY ALL""")
def a34_a35_a50(spark, d):
    return A.support_bins(A.prompt_rollup(V.rollouts(spark, d), PROMPT), STEP)


@query("a38_grouping_sets", """SELECT coalesce(run_name, '*') AS run_name, coalesce(family, '*') AS family, count(*) AS n, round(avg(acc::INT), 6) AS sacc, round(avg(bypass::INT), 6) AS ifacc, round(avg((acc AND bypass)::INT), 6) AS hacc,
    round(avg(acc::INT) - avg((acc AND bypass)::INT), 6) AS gap FROM v_rollouts GROUP BY GROUPING SETS ((run_name), (run_name, family), (family), ())""")
def a38_a39_a46(spark, d):
    V.rollouts(spark, d).createOrReplaceTempView("_rollouts")
    g = V.rollouts(spark, d).groupingSets([["run_name"], ["run_name", "family"], ["family"], []], "run_name", "family")
    both = A.rate(F.col("acc") & F.col("bypass"))
    out = g.agg(F.count("*").alias("n"), A.rate("acc").alias("sacc"), A.rate("bypass").alias("ifacc"), both.alias("hacc"), (A.rate("acc") - both).alias("gap"))
    return out.select(F.coalesce("run_name", F.lit("*")).alias("run_name"), F.coalesce("family", F.lit("*")).alias("family"), "n", "sacc", "ifacc", "hacc", "gap")


@query("a40_coupling", """WITH c AS (SELECT run_name, count(*) FILTER (acc AND bypass)::DOUBLE AS a, count(*) FILTER (acc AND NOT bypass)::DOUBLE AS b, count(*) FILTER (NOT acc AND bypass)::DOUBLE AS c, count(*) FILTER (NOT acc AND NOT bypass)::DOUBLE AS d
    FROM v_rollouts GROUP BY ALL) SELECT run_name, round(a / nullif(a + c, 0), 6) AS p_a_given_b, round(b / nullif(b + d, 0), 6) AS p_a_given_not_b, round(a / nullif(a + b, 0), 6) AS p_b_given_a,
    round((a * d - b * c) / nullif(sqrt((a + b) * (c + d) * (a + c) * (b + d)), 0), 6) AS phi FROM c""")
def a40(spark, d):
    return A.coupling(V.rollouts(spark, d), ["run_name"], "acc", "bypass")


@query("a41_length_deciles", """WITH e AS (SELECT run_name, list_distinct(quantile_cont(length, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e FROM v_rollouts GROUP BY ALL)
    SELECT r.run_name, greatest(1, len(list_filter(e, lambda x: x < r.length))) AS bin, count(*) AS n, round(avg(acc::INT), 6) AS acc, min(length) AS least, max(length) AS most FROM v_rollouts r JOIN e ON r.run_name = e.run_name GROUP BY ALL""")
def a41(spark, d):
    b = A.quantile_bins(V.rollouts(spark, d), ["run_name"], "length", 10)
    return b.groupBy("run_name", "bin").agg(F.count("*").alias("n"), A.rate("acc").alias("acc"), F.min("length").alias("least"), F.max("length").alias("most"))


@query("a42_pass_best_majority", """SELECT run_name, count(*) AS n_prompts, round(avg(m), 6) AS mean, round(avg(b), 6) AS best, round(avg(w), 6) AS worst, round(avg((m > 0.5)::INT), 6) AS majority
    FROM (SELECT run_name, prompt_id, avg(acc::INT) AS m, max(acc::INT) AS b, min(acc::INT) AS w FROM v_rollouts GROUP BY ALL) GROUP BY ALL""")
def a42_a48_a49(spark, d):
    return A.two_level(V.rollouts(spark, d), ["prompt_id"], ["run_name"], F.col("acc").cast("double"))


@query("a43_composition_decay", """SELECT run_name, k, round(avg(s), 6) AS strict, round(pow(avg(s), 1.0 / k), 6) AS implied FROM (SELECT run_name, prompt_id, least(count(*), 3) AS k, min(acc::INT) AS s FROM v_rollouts GROUP BY run_name, prompt_id) GROUP BY run_name, k""")
def a43(spark, d):
    own = V.rollouts(spark, d).groupBy("run_name", "prompt_id").agg(F.least(F.count("*"), F.lit(3)).alias("k"), F.min(F.col("acc").cast("double")).alias("s"))
    return own.groupBy("run_name", "k").agg(F.avg("s").alias("strict"), F.pow(F.avg("s"), 1.0 / F.col("k")).alias("implied"))


@query("a44_failure_taxonomy", """SELECT run_name, label, n, round(n / sum(n) OVER (PARTITION BY run_name), 6) AS share FROM (SELECT run_name, CASE WHEN bypass AND acc THEN 'bypass' WHEN acc THEN 'follow' WHEN pred IS NULL THEN 'invalid' ELSE 'wrong' END AS label, count(*) AS n FROM v_rollouts GROUP BY ALL)""")
def a44_a47_w10(spark, d):
    label = F.when(F.col("bypass") & F.col("acc"), "bypass").when(F.col("acc"), "follow").when(F.col("pred").isNull(), "invalid").otherwise("wrong")
    return A.shares(V.rollouts(spark, d).withColumn("label", label), ["run_name"], "label")


@query("a51_source_mean", "SELECT source, round(avg(m), 6) AS mean FROM (SELECT source, lang, avg(n_chars) AS m FROM documents GROUP BY ALL) GROUP BY ALL")
def a51(spark, d):
    return V.table(spark, d, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("m")).groupBy("source").agg(F.avg("m").alias("mean"))


_V = "SELECT run_name, prompt_id, score, count(*) OVER (PARTITION BY run_name, prompt_id) AS n, row_number() OVER (PARTITION BY run_name, prompt_id ORDER BY score)::DOUBLE AS i FROM v_rollouts"
_GRID = f"SELECT *, unnest(CASE WHEN n > 1 THEN list_distinct(list_filter([2, 4, 8, 16, 32], lambda x: x < n) || [n]) ELSE [NULL] END) AS k FROM ({_V})"


@query("a52_validation_metrics", f"""SELECT run_name, n, k, count(*) AS n_prompts, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std, round(avg(best), 6) AS best, round(avg(worst), 6) AS worst FROM (
    SELECT run_name, prompt_id, n, k, avg(score) AS mean, stddev_pop(score) AS std, sum(score * (pow(i / n, k) - pow((i - 1) / n, k))) AS best, sum(score * (pow((n - i + 1) / n, k) - pow((n - i) / n, k))) AS worst
    FROM ({_GRID}) GROUP BY ALL) GROUP BY ALL""", exact=True)
def a52_a53(spark, d):
    return A.validation(V.rollouts(spark, d), source="run_name", uid="prompt_id", value="score")


@query("a54_majority_value", f"SELECT run_name, checkpoint_step, round(avg(first_acc), 6) AS majority FROM ({_MODAL}) WHERE r = 1 GROUP BY ALL")
def a54(spark, d):
    return A.majority(V.rollouts(spark, d), PROMPT).groupBy(*STEP).agg(F.avg("maj_first").alias("majority"))


@query("a55_data_metrics", """SELECT round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max, round(min(score), 6) AS score_min, round(avg(length), 6) AS length_mean, max(length) AS length_max, min(length) AS length_min,
    round(avg((length >= 50)::INT), 6) AS clip_ratio, round(avg((pred IS NULL)::INT), 6) AS aborted_ratio, round(avg(CASE WHEN pred IS NOT NULL THEN score END), 6) AS true_score_mean,
    round(1 - var_samp(score - length / 50.0) / var_samp(score), 6) AS explained FROM v_rollouts""")
def a55_a56(spark, d):
    error = F.col("score") - F.col("length") / 50.0
    return V.rollouts(spark, d).agg(
        F.avg("score").alias("score_mean"), F.max("score").alias("score_max"), F.min("score").alias("score_min"), F.avg("length").alias("length_mean"), F.max("length").alias("length_max"), F.min("length").alias("length_min"),
        A.rate(F.col("length") >= 50).alias("clip_ratio"), A.rate(F.col("pred").isNull()).alias("aborted_ratio"), F.avg(F.when(F.col("pred").isNotNull(), F.col("score"))).alias("true_score_mean"),
        (1 - F.var_samp(error) / F.var_samp("score")).alias("explained"),
    )


_LONG = "SELECT CASE event_type WHEN 'click' THEN 'critic/max_score' WHEN 'view' THEN 'min_error' ELSE event_type END AS metric, value, event_id AS seq, 1 + event_id % 3 AS weight FROM events"


def _long(spark, d):
    e = F.col("event_type")
    return V.table(spark, d, "events").select(F.when(e == "click", "critic/max_score").when(e == "view", "min_error").otherwise(e).alias("metric"), "value", F.col("event_id").alias("seq"), (1 + F.col("event_id") % 3).alias("weight"))


@query("a57_reduce_metrics", f"SELECT metric, round(CASE WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM ({_LONG}) GROUP BY metric")
def a57(spark, d):
    return A.reduce_by_name(_long(spark, d))


@query("a58_aggregate_by_rule", f"""SELECT metric, round(CASE WHEN metric LIKE '%/last' THEN arg_max(value, seq) WHEN metric LIKE 'timing_s%' THEN sum(value) WHEN contains(metric, 'sum') THEN sum(value) WHEN contains(metric, 'weighted') THEN sum(value * weight) / sum(weight) ELSE avg(value) END, 4) AS value
    FROM (SELECT CASE event_type WHEN 'click' THEN 'lr/last' WHEN 'view' THEN 'timing_s/gen' WHEN 'purchase' THEN 'reward/weighted' ELSE event_type END AS metric, value, event_id AS seq, 1 + event_id % 3 AS weight FROM events) GROUP BY metric""")
def a58(spark, d):
    e = F.col("event_type")
    long = V.table(spark, d, "events").select(F.when(e == "click", "lr/last").when(e == "view", "timing_s/gen").when(e == "purchase", "reward/weighted").otherwise(e).alias("metric"), "value", F.col("event_id").alias("seq"), (1 + F.col("event_id") % 3).alias("weight"))
    return A.aggregate_by_rule(long).withColumn("value", F.round("value", 4))


@query("a08_pattern_z", """WITH m AS (SELECT run_name, unnest(['acc', 'score', 'length']) AS metric, unnest([a, s, l]) AS value FROM (SELECT run_name, avg(acc::INT) AS a, avg(score) AS s, avg(length) AS l FROM v_rollouts GROUP BY run_name))
    SELECT run_name, metric, round(value, 6) AS value, round((value - avg(value) OVER (PARTITION BY metric)) / coalesce(nullif(stddev_pop(value) OVER (PARTITION BY metric), 0), 1), 6) AS z FROM m""")
def a08(spark, d):
    wide = V.rollouts(spark, d).groupBy("run_name").agg(A.rate("acc").alias("acc"), F.avg("score").alias("score"), F.avg("length").alias("length"))
    return A.z_scores(wide.unpivot("run_name", ["acc", "score", "length"], "metric", "value"))


@query("a69_pivot_counts", "SELECT family, count(*) FILTER (run_name = 'F') AS f, count(*) FILTER (run_name = 'O') AS o, count(*) FILTER (run_name = 'P') AS p FROM v_rollouts GROUP BY ALL")
def a69_a70(spark, d):
    return V.rollouts(spark, d).groupBy("family").pivot("run_name", ["F", "O", "P"]).count().na.fill(0).toDF("family", "f", "o", "p")


@query("a71_retention", """WITH m AS (SELECT checkpoint_step, avg(CASE WHEN run_name = 'F' THEN score END) AS base, avg(CASE WHEN run_name = 'O' THEN score END) AS stage, avg(CASE WHEN run_name = 'P' THEN score END) AS seq FROM v_rollouts GROUP BY ALL)
    SELECT checkpoint_step, round(CASE WHEN abs(stage - base) >= 1e-9 THEN (seq - base) / (stage - base) END, 6) AS retention, CASE WHEN abs(stage - base) < 1e-9 OR stage IS NULL OR base IS NULL OR seq IS NULL THEN NULL WHEN (seq - base) / (stage - base) >= 0.7 THEN 'retained' WHEN (seq - base) / (stage - base) >= 0.3 THEN 'partial' ELSE 'lost' END AS label FROM m""")
def a71(spark, d):
    m = V.rollouts(spark, d).groupBy("checkpoint_step").pivot("run_name", ["F", "O", "P"]).agg(F.avg("score"))
    gain = F.col("O") - F.col("F")
    r = F.when(F.abs(gain) >= 1e-9, (F.col("P") - F.col("F")) / gain)
    return m.select("checkpoint_step", r.alias("retention"), F.when(r >= 0.7, "retained").when(r >= 0.3, "partial").when(r.isNotNull(), "lost").alias("label"))


@query("a72_style_distance", """WITH m AS (SELECT run_name, avg(acc::INT) AS a, avg(score) AS s, avg(length) AS l FROM v_rollouts GROUP BY ALL), w AS (SELECT max(CASE WHEN run_name = 'F' THEN a END) AS fa, max(CASE WHEN run_name = 'O' THEN a END) AS oa, max(CASE WHEN run_name = 'P' THEN a END) AS pa,
    max(CASE WHEN run_name = 'F' THEN s END) AS fs, max(CASE WHEN run_name = 'O' THEN s END) AS os, max(CASE WHEN run_name = 'P' THEN s END) AS ps, max(CASE WHEN run_name = 'F' THEN l END) AS fl, max(CASE WHEN run_name = 'O' THEN l END) AS ol, max(CASE WHEN run_name = 'P' THEN l END) AS pl FROM m)
    SELECT round((abs(pa - fa) / greatest(abs(fa - oa), 1e-9) + abs(ps - fs) / greatest(abs(fs - os), 1e-9) + abs(pl - fl) / greatest(abs(fl - ol), 1e-9)) / 3, 5) AS distance FROM w""")
def a72(spark, d):
    m = V.rollouts(spark, d).groupBy("run_name").agg(A.rate("acc").alias("a"), F.avg("score").alias("s"), F.avg("length").alias("l")).unpivot("run_name", ["a", "s", "l"], "metric", "value")
    p = m.groupBy("metric").pivot("run_name", ["F", "O", "P"]).agg(F.first("value"))
    return p.agg(F.round(F.avg(F.abs(F.col("P") - F.col("F")) / F.greatest(F.abs(F.col("F") - F.col("O")), F.lit(1e-9))), 5).alias("distance"))


@query("a73_family_distribution", """WITH f AS (SELECT family, count(*) AS full_n FROM v_rollouts GROUP BY ALL), s AS (SELECT family, count(*) AS subset_n FROM v_rollouts WHERE sample_id = 0 AND length > 45 GROUP BY ALL)
    SELECT coalesce(f.family, s.family) AS family, coalesce(full_n, 0) AS full_n, coalesce(subset_n, 0) AS subset_n, round(100.0 * coalesce(full_n, 0) / sum(full_n) OVER (), 6) AS full_pct, round(100.0 * coalesce(subset_n, 0) / sum(subset_n) OVER (), 6) AS subset_pct FROM f FULL JOIN s ON f.family = s.family""")
def a73(spark, d):
    r = V.rollouts(spark, d)
    f, s = r.groupBy("family").agg(F.count("*").alias("full_n")), r.where("sample_id = 0 and length > 45").groupBy("family").agg(F.count("*").alias("subset_n"))
    w = Window.partitionBy()
    j = f.join(s, "family", "full").na.fill(0)
    return j.select("family", "full_n", "subset_n", (100.0 * F.col("full_n") / F.sum("full_n").over(w)).alias("full_pct"), (100.0 * F.col("subset_n") / F.sum("subset_n").over(w)).alias("subset_pct"))
