"""Queries that attach what another table knows, and summaries of sweeps, buckets, scopes and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import breakdowns as T
from tallyloom.operators import joins as J
from tallyloom.sources import views as V

from .registry import query


@query("j02_parsed_lookup", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber NOT IN (2, 3)")
def j02(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    keys = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 2, F.concat(k, F.lit(".0"))).when(n == 3, F.lit(None)).when(n == 4, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(k).alias("key"))
    return J.parsed_lookup(keys, "key", V.table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").drop("key")


@query("j03_by_text", "SELECT d.doc_id, s.pid FROM documents d JOIN (SELECT trim(text) AS t, min(doc_id) AS pid FROM documents JOIN labels USING (doc_id) GROUP BY 1) s ON trim(d.text) = s.t")
def j03(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    subset = docs.join(V.table(spark, d, "labels").select("doc_id").distinct(), "doc_id").select(F.col("doc_id").alias("pid"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("t"))
    return J.by_text(docs, F.col("text"), subset, F.col("t"), "pid").select("doc_id", "pid")


@query("j07_relative_position", "SELECT sequence, t, max(t) OVER (PARTITION BY sequence) AS n, round(t::DOUBLE / max(t) OVER (PARTITION BY sequence), 6) AS rel_pos FROM v_tokens")
def j07(spark, d):
    n, share = J.share_of_length("t", "sequence")
    return V.tokens(spark, d).select("sequence", "t", n.alias("n"), share.alias("rel_pos"))


@query("j09_modes_of_tokens", "SELECT sequence, t, o_orderpriority AS mode FROM v_tokens LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') ON sequence = o_orderkey")
def j09(spark, d):
    modes = V.table(spark, d, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("sequence"), F.col("o_orderpriority").alias("mode"))
    return V.tokens(spark, d).select("sequence", "t").join(modes, "sequence", "left")


@query("j10_attached", "SELECT k.sequence, k.t, round(a.logp_a, 6) AS a, round(b.logp_b, 6) AS b FROM v_tokens k JOIN v_tokens a USING (sequence, t) JOIN v_tokens b USING (sequence, t) WHERE k.js > 0.05 AND k.mask AND k.reward > 0")
def j10(spark, d):
    t = V.tokens(spark, d)
    sides = [t.where("mask").select("sequence", "t", F.col("logp_a").alias("a")), t.where("reward > 0").select("sequence", "t", F.col("logp_b").alias("b"))]
    return J.attached(t.where("js > 0.05").select("sequence", "t"), sides, ["sequence", "t"])


@query("j11_prefixed_lookup", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE p_name END AS p_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def j11(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 1, F.concat(F.lit("mathif_"), k)).when(n == 2, k).when(n == 3, F.concat(F.lit("other_"), k)).otherwise(F.concat(F.lit("mathif_"), k)).alias("id"))
    build = V.table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("mathif_"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string")).alias("key"), "p_name")
    both = build.unionByName(build.where("key LIKE 'mathif%'").withColumn("key", F.regexp_replace("key", "^mathif_", "")))
    return J.prefixed_lookup(rows, "id", both, "key", "p_name", "mathif_").drop("id")


@query("j14_cached_labels", "SELECT prompt_id, sample_id, CASE WHEN family <> 'R' THEN family ELSE 'MISSING' END AS label, CASE WHEN family <> 'R' THEN 'r' || sample_id ELSE '' END AS reason FROM v_rollouts")
def j14(spark, d):
    r = V.rollouts(spark, d)
    cache = r.where("family <> 'R'").select("prompt_id", "sample_id", F.col("family").alias("label"), F.concat(F.lit("r"), F.col("sample_id").cast("string")).alias("reason"))
    return J.cached_labels(r.select("prompt_id", "sample_id"), cache, ["prompt_id", "sample_id"])


@query("a18_position_sweep", """WITH e AS (SELECT *, length % 5 AS position FROM v_evaluations) SELECT model, position, count(*) AS n_rows, count(DISTINCT prompt_id) AS n_prompts, round(any_value(b), 6) AS best_at_n, round(avg(acc::INT), 6) AS avg_at_n,
    round(avg((mode = 'DRI')::INT), 6) AS dri_rate, round(avg((mode = 'DAI')::INT), 6) AS dai_rate, round(avg((mode = 'CSI')::INT), 6) AS csi_rate, round(avg((mode = 'Other')::INT), 6) AS other_rate, round(avg(length), 6) AS mean_len
    FROM e JOIN (SELECT model, position, avg(m) AS b FROM (SELECT model, position, prompt_id, max(acc::INT) AS m FROM e GROUP BY ALL) GROUP BY ALL) USING (model, position) GROUP BY model, position""", exact=True)
def a18(spark, d):
    return T.sweep(V.evaluations(spark, d).withColumn("position", F.col("length") % 5), ["model", "position"], "prompt_id", acc="acc", mode="mode", length="length")


@query("a21_triangle_buckets", """SELECT least(t, 5) AS bucket, count(*) AS n_tokens, round(avg(js), 6) AS mean_js, round(median(js), 6) AS median_js, round(avg(logp_a - logp_b), 6) AS mean_d, round(median(logp_a - logp_b), 6) AS median_d FROM v_tokens GROUP BY 1""", exact=True)
def a21(spark, d):
    return T.bucket_summary(V.tokens(spark, d).withColumn("bucket", F.least("t", F.lit(5))), ["bucket"], {"js": F.col("js"), "d": F.col("logp_a") - F.col("logp_b")})


@query("a22_scopes", "SELECT scope, count(*) AS n_rows, round(avg(reward), 6) AS mean_reward, round(avg(mask::INT), 6) AS mean_mask, round(median(t), 6) AS median_t FROM v_tokens JOIN (VALUES ('high'), ('high_first')) s(scope) ON js >= 0.06 AND (scope = 'high' OR t = 1) GROUP BY scope", exact=True)
def a22(spark, d):
    high = F.col("js") >= 0.06
    return T.scoped_summary(V.tokens(spark, d), {"high": high, "high_first": high & (F.col("t") == 1)}, ["reward", "mask"], ["t"], [])


@query("a25_trajectory_features", """WITH s AS (SELECT run_name, checkpoint_step AS step, avg((length >= 25)::INT) AS v FROM v_rollouts GROUP BY ALL), f AS (SELECT run_name, max(v) FILTER (step = 1993) AS at_1993, max(v) FILTER (step = 1995) AS at_1995, max(v) FILTER (step = 2020) AS at_2020,
    string_agg(step::VARCHAR, ',' ORDER BY step) AS steps_available, count(*) AS n_steps, min(step) FILTER (v > 0.5) AS first_over, (max(v) FILTER (step = 1995) - max(v) FILTER (step = 1993)) / 2 AS sl, (max(v) FILTER (step = 1995) + max(v) FILTER (step = 1993)) / 2 AS em FROM s GROUP BY run_name)
    SELECT run_name, round(at_1993, 6) AS at_1993, round(at_1995, 6) AS at_1995, round(at_2020, 6) AS at_2020, steps_available, n_steps, first_over, round(sl, 6) AS early_slope, round(CASE WHEN sl <> 0 THEN sign(sl) * log10(abs(sl)) END, 4) AS log_early_slope, round(em, 6) AS early_mean FROM f""")
def a25_a27(spark, d):
    steps = V.rollouts(spark, d).groupBy("run_name", F.col("checkpoint_step").alias("step")).agg(F.avg((F.col("length") >= 25).cast("double")).alias("v"))
    got = T.trajectory_features(steps, ["run_name"], "step", "v", [1993, 1995, 2020], (1993, 1995), over=0.5)
    return got.withColumn("log_early_slope", F.round("log_early_slope", 4))
