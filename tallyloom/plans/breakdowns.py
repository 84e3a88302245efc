"""Queries on tables of evaluation runs and on estimators over several rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import breakdowns as T
from tallyloom.operators import estimators as E
from tallyloom.sources import views as V

from .registry import query

_STEP = ["run_name", "checkpoint_step"]


@query("a01_over_samples", """WITH v AS (SELECT run_name, prompt_id, pred, count(*) AS n, min(sample_id) AS first FROM v_rollouts WHERE coalesce(pred, '') <> '' GROUP BY ALL),
    m AS (SELECT run_name, prompt_id, arg_max(pred, n * 1000000 - first) AS modal, count(*) AS u, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY run_name, prompt_id)::DOUBLE AS t FROM v) GROUP BY ALL),
    p AS (SELECT run_name, prompt_id, count(*) AS k, avg(acc::INT) AS pass_at_1, max(acc::INT)::DOUBLE AS best_at_k, arg_min(gold, sample_id) AS gold FROM v_rollouts GROUP BY ALL)
    SELECT run_name, prompt_id, k, round(pass_at_1, 6) AS pass_at_1, best_at_k, coalesce(modal = gold AND gold <> '', false)::INT::DOUBLE AS maj_at_k, round(best_at_k - pass_at_1, 6) AS best_minus_pass,
    round(coalesce(modal = gold AND gold <> '', false)::INT - pass_at_1, 6) AS maj_minus_pass, round(CASE WHEN u > 1 THEN e ELSE 0 END, 6) AS answer_entropy, round(CASE WHEN u > 1 THEN e / log2(u) ELSE 0 END, 6) AS normalized_answer_entropy, coalesce(u, 0) AS n_unique
    FROM p LEFT JOIN m USING (run_name, prompt_id)""", exact=True)
def a01(spark, d):
    return T.over_samples(V.rollouts(spark, d), ["run_name", "prompt_id"], answer="pred", acc="acc", order="sample_id", gold="gold")


@query("a13_instruction_steps", """SELECT run_name, checkpoint_step, family, count(*) AS n_prompts, sum(n)::BIGINT AS n_rollouts, round(avg(m), 6) AS pass_at_1, round(avg(b), 6) AS best_at_n, round(avg(sm), 6) AS strict_pass_at_1, round(avg(sb), 6) AS strict_best_at_n, round(sum(l) / sum(n), 6) AS mean_len
    FROM (SELECT run_name, checkpoint_step, family, prompt_id, count(*) AS n, avg(score) AS m, max(score) AS b, avg((score >= 1)::INT) AS sm, max((score >= 1)::INT) AS sb, sum(length)::DOUBLE AS l FROM v_rollouts GROUP BY ALL) GROUP BY ALL""", exact=True)
def a13(spark, d):
    return T.instruction_steps(V.rollouts(spark, d), [*_STEP, "family"], "prompt_id", score="score", length="length")


def _support(metric: str, column: str) -> str:
    count = f"count(*) FILTER ({column})"
    return f"{count} AS {metric}_count, round(avg({column}::INT), 6) AS {metric}_pass_at_1, CASE WHEN count({column}) > 0 THEN ({count} > 0)::INT::DOUBLE END AS {metric}_best_at_k, CASE WHEN {count} = count(*) THEN 'all' WHEN {count} = 0 THEN 'zero' ELSE 'partial' END AS {metric}_bin"


_METRICS = {"acc": "acc", "follow": "follow", "joint": "joint"}


@query("a34_prompt_support", f"SELECT model, prompt_id, count(*) AS k, {', '.join(_support(m, c) for m, c in _METRICS.items())} FROM v_evaluations GROUP BY ALL")
def a34(spark, d):
    return T.prompt_support(V.evaluations(spark, d), ["model", "prompt_id"], _METRICS)


@query("a36_by_mode", "SELECT dataset, model, mode, count(*) AS n, round(any_value(w), 6) AS fraction, round(avg(acc::INT), 6) AS acc, round(avg(follow::INT), 6) AS follow, round(avg(joint::INT), 6) AS joint, round(avg(length), 6) AS mean_len FROM (SELECT *, count(*) OVER (PARTITION BY dataset, model, mode)::DOUBLE / count(*) OVER (PARTITION BY dataset, model) AS w FROM v_evaluations) GROUP BY dataset, model, mode", exact=True)
def a36_a47(spark, d):
    return T.by_mode(V.evaluations(spark, d), ["dataset", "model"], "mode", {"acc": "acc", "follow": "follow", "joint": "joint", "mean_len": "length"})


_CONSTRAINTS = """SELECT model, source, bypass, acc, length, c.family AS family, c.name AS instruction, coalesce(c.passed, false)::INT AS passed, coalesce(response_passed[i], false)::INT AS other_passed,
    CASE c.family WHEN 'length_constraint_checkers' THEN 'length' WHEN 'keywords' THEN 'lexical' WHEN 'language' THEN 'lexical' WHEN 'punctuation' THEN 'lexical' WHEN 'change_case' THEN 'format' WHEN 'detectable_format' THEN 'format' WHEN 'combination' THEN 'format' WHEN 'startend' THEN 'affix' ELSE 'other' END AS macro
    FROM (SELECT *, unnest(reasoning) AS c, generate_subscripts(reasoning, 1) AS i FROM v_evaluations) WHERE c.supported"""
_LEVEL = "SELECT '{0}' AS level, {0} AS name, model, count(*) AS n, round(avg(passed), 6) AS if_acc, round(avg(acc::INT), 6) AS s_acc, round(avg(length), 6) AS len_words FROM c GROUP BY {0}, model"


@query("a39_constraint_rates", f"WITH c AS ({_CONSTRAINTS}) " + " UNION ALL ".join(_LEVEL.format(x) for x in ("macro", "family", "instruction")), exact=True)
def a39(spark, d):
    rows = T.constraints(V.evaluations(spark, d), "reasoning", "model", "acc", "length")
    return T.constraint_rates(rows, "model", acc="acc", length="length")


_GENUINE = "SELECT *, coalesce(follow, false) AS raw, coalesce(follow, false) AND NOT bypass AS genuine, reasoning[1].family AS family FROM v_evaluations"
_RATES = "count(*) AS n, round(avg(acc::INT), 6) AS acc, round(avg(raw::INT), 6) AS reasoning_follow_raw, round(avg(bypass::INT), 6) AS bypass_rate, round(avg(genuine::INT), 6) AS reasoning_follow_genuine, round(avg((genuine AND acc)::INT), 6) AS joint_reason_correct, round(avg(response_follow::INT), 6) AS response_follow_strict, round(avg(response_follow::INT) - avg(raw::INT), 6) AS shortcut_gap, round(avg(length), 6) AS mean_words"


@query("a46_genuine_following", f"WITH g AS ({_GENUINE}) SELECT 'overall' AS level, '' AS name, model, {_RATES} FROM g GROUP BY model UNION ALL SELECT 'family', family, model, {_RATES} FROM g GROUP BY family, model UNION ALL SELECT 'source', source, model, {_RATES} FROM g GROUP BY source, model", exact=True)
def a46(spark, d):
    rows = T.genuine(V.evaluations(spark, d), reasoning="follow", response="response_follow", bypass="bypass", acc="acc")
    levels = (("overall", F.lit("")), ("family", F.col("reasoning")[0]["family"]), ("source", F.col("source")))
    tables = [T.genuine_rates(rows, [F.lit(level).alias("level"), name.alias("name"), F.col("model")], "length") for level, name in levels]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


_FINE = "count(*) AS n, round(avg(passed), 6) AS reasoning_pass_rate, round(avg(other_passed), 6) AS response_pass_rate, round(avg(bypass::INT), 6) AS bypass_rate, round(avg(acc::INT), 6) AS acc"


@query("a47_fine_grained", f"WITH c AS ({_CONSTRAINTS}) " + " UNION ALL ".join(f"SELECT '{x}' AS level, {x}::VARCHAR AS name, model, {_FINE} FROM c GROUP BY {x}, model" for x in ("family", "bypass", "source")), exact=True)
def a47(spark, d):
    rows = T.constraints(V.evaluations(spark, d), "reasoning", "model", "source", "bypass", "acc", other="response")
    aggs = [F.count("*").alias("n"), F.avg("passed").alias("reasoning_pass_rate"), F.avg("other_passed").alias("response_pass_rate"), F.avg(F.col("bypass").cast("int")).alias("bypass_rate"), F.avg(F.col("acc").cast("int")).alias("acc")]
    tables = [rows.groupBy(F.lit(x).alias("level"), F.col(x).cast("string").alias("name"), "model").agg(*aggs) for x in ("family", "bypass", "source")]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("a49_checkpoint_summary", """SELECT run_name, checkpoint_step, count(*) AS n_prompts, sum(n)::BIGINT AS n, round(avg(p), 6) AS pass_at_1, round(avg(b), 6) AS best_at_n, round(avg(l), 6) AS mean_len, round(avg(i), 6) AS invalid_frac, round(avg(t), 6) AS truncated_frac
    FROM (SELECT run_name, checkpoint_step, prompt_id, count(*) AS n, avg(acc::INT) AS p, max(acc::INT) AS b, avg(length) AS l, avg((pred IS NULL)::INT) AS i, avg((length >= 48)::INT) AS t FROM v_rollouts GROUP BY ALL) GROUP BY ALL""", exact=True)
def a49(spark, d):
    return T.checkpoint_summary(V.rollouts(spark, d), _STEP, "prompt_id", acc="acc", pred="pred", length="length", limit=16)


_TOKENS = "SELECT *, sequence // 8 AS g, t = max(t) OVER (PARTITION BY sequence) AS last FROM v_tokens"


def _tokens(spark, d):
    ends = V.tokens(spark, d).groupBy("sequence").agg(F.max("t").alias("_e"))
    t = V.tokens(spark, d).join(ends, "sequence").withColumn("last", F.col("t") == F.col("_e")).drop("_e")
    return t.withColumn("g", F.floor(F.col("sequence") / 8))


@query("g13_direct", "SELECT sequence, t, round(CASE WHEN mask THEN reward ELSE 0 END, 6) AS advantage FROM v_tokens")
def g13(spark, d):
    return V.tokens(spark, d).select("sequence", "t", E.direct("reward", "mask").alias("advantage"))


@query("g14_direct_plus_grpo", f"""WITH k AS ({_TOKENS}), s AS (SELECT g, sequence, sum(js) AS s FROM k GROUP BY ALL),
    a AS (SELECT sequence, (s - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(s) OVER w END) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(s) OVER w END + 1e-6) AS a FROM s WINDOW w AS (PARTITION BY g))
    SELECT k.sequence, t, round(CASE WHEN mask THEN reward + 0.5 * a ELSE 0 END, 5) AS advantage FROM k JOIN a ON k.sequence = a.sequence""")
def g14(spark, d):
    got = E.direct_plus_grpo(_tokens(spark, d), "reward", "js", "g", "sequence", "mask", weight=0.5)
    return got.select("sequence", "t", F.round("advantage", 5).alias("advantage"))


@query("g15_rloo_of_sources", f"""WITH k AS ({_TOKENS}), m AS (SELECT g, sequence, avg(CASE WHEN mask THEN reward END) AS a, avg(CASE WHEN last THEN value END) AS b FROM k GROUP BY ALL),
    s AS (SELECT g, count(*) AS n, sum(a) AS a, sum(b) AS b FROM m GROUP BY g HAVING count(*) > 1),
    r AS (SELECT k.*, CASE WHEN mask THEN 2 * CASE WHEN mask THEN (reward * n - s.a) / (n - 1) ELSE 0 END + 5 * CASE WHEN last THEN (value * n - s.b) / (n - 1) ELSE 0 END ELSE 0 END AS r FROM k JOIN s ON k.g = s.g),
    x AS (SELECT sequence, t, mask, sum(r) OVER (PARTITION BY sequence ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS returns FROM r)
    SELECT sequence, t, round(returns, 5) AS returns, round((returns - (SELECT avg(returns) FROM x WHERE mask)) / sqrt((SELECT var_samp(returns) FROM x WHERE mask) + 1e-8), 5) AS advantage FROM x""")
def g15(spark, d):
    t = _tokens(spark, d)
    several = t.groupBy("g").agg(F.count_distinct("sequence").alias("_n")).where("_n > 1").drop("_n")
    got = E.rloo_of_sources(t.join(several, "g"), {"model": ("reward", "mask", 2.0), "truth": ("value", "last", 5.0)}, "g", "sequence", "t", "mask")
    return got.select("sequence", "t", F.round("returns", 5).alias("returns"), F.round("advantage", 5).alias("advantage"))
